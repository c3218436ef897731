"""Links and components of vectors against all pairs."""

import math

import numpy as np
import pytest

from chainspark.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, v int, h1 string"


def some_vectors(rng, groups, each, width=16, spread=0.02):
    centres = rng.standard_normal((groups, width))
    return [(c + spread * rng.standard_normal(width)).astype(np.float32).tolist() for c in centres for _ in range(each)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vectors = some_vectors(rng, 12, 9) + some_vectors(rng, 60, 1) + some_vectors(rng, 3, 8, spread=0.06)
    out = [(int(i * 7 % 1009), v, int(i % 2)) for i, v in enumerate(vectors)]
    copy = out[4]
    out += [(2000 + k, copy[1], copy[2]) for k in range(5)] + [copy, copy]  # equal vectors under other ids and under their own
    out += [(3000, [2.5 * x for x in copy[1]], copy[2]), (3001, copy[1], 1 - copy[2]), (3002, copy[1], None), (3003, None, 0), (3004, [0.0] * 16, 0), (3005, [math.nan] * 16, 0)]
    out += [(3006, [math.inf] + [0.0] * 15, 0), (3007, [1.0, None], 0), (3008, [], 0), (3009, [1.0, 0.0], 0), (3010, [1.0], 0), (3011, [1e-30], 0), (None, copy[1], copy[2]), (None, None, None)]
    return [(*r, "x", 1, "y") for r in out]


def by_hand(rows, least=0.98):
    n, edges = [0] * len(rows), []
    usable = [i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, label, *_ in rows]
    width = 16
    x = np.array([(list(v) + [0.0] * width)[:width] if u else [1.0] * width for (_, v, *_), u in zip(rows, usable)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and x[a] @ x[b] >= least:
                n[a] += 1
                n[b] += 1
                edges.append((rows[a][0], rows[b][0]))
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted(((r[0], k, root[r[0]], r[0] is None or r[0] == root[r[0]]) for r, k in zip(rows, n)), key=str)


def test_equal_to_all_pairs(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = pivots.op13_pivots(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)


def test_long_lists_are_dealt_over_tiles(spark, monkeypatch):
    """One dense group of 700 vectors, in tiles of 256 rows: each pair counts once."""
    monkeypatch.setattr(pivots, "TILE", 1)
    rng = np.random.default_rng(8)
    rows = [(i, v, 0, None, None, None) for i, v in enumerate(some_vectors(rng, 1, 700, spread=0.001))]
    got = pivots.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id} == {(699, 0, False)} and len(got) == 700


def test_hooking_joins_classes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        root, links = np.arange(n), []
        for _ in range(3):
            p, q = rng.integers(0, n, 6), rng.integers(0, n, 6)
            links += list(zip(p, q))
            root = pivots.hooked(root, p, q)
        want = list(range(n))
        for _ in range(n):
            for p, q in links:
                want[p] = want[q] = min(want[p], want[q])
        assert root.tolist() == want


def test_recall_decides_on_pivots():
    x = pivots.unit(np.random.default_rng(5).standard_normal((4000, 64)))
    kept = pivots.enough(pivots.thinned(x), x[:256], 0.98, 1)
    assert 4 * pivots.NEAREST <= len(kept) <= len(x)
    close = pivots.thinned(pivots.unit(np.ones((50, 8)) + 1e-3 * x[:50, :8]))
    assert len(close) == 1


def test_empty_and_useless_tables(spark):
    assert pivots.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 0, None, None, None), (2, [1.0], None, None, None, None)]
    assert sorted(tuple(r) for r in pivots.linked(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
