"""Runs of periodic words against a plain search, and the query's digests against the rule."""

import hashlib
import zlib

import numpy as np
import pytest

from chainspark.llm import periodic


def runs_by_hand(words, least=12):
    """For each period, the longest stretches of words that stand again so far on; of equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                best.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def some_words(rng, n, kinds):
    words = rng.integers(0, kinds, n)
    if n > 20 and rng.random() < 0.6:
        a = int(rng.integers(0, n))
        p = 1 + (n - a) // int(rng.integers(2, 9))
        words[a:] = np.resize(words[a : a + p], n - a)
    return words


def test_runs_equal_plain_search(monkeypatch):
    rng = np.random.default_rng(11)
    for chunk in (periodic.CHUNK, 200):
        monkeypatch.setattr(periodic, "CHUNK", chunk)
        for _ in range(60):
            texts = [some_words(rng, int(rng.integers(0, 300)), int(rng.integers(1, 6))) for _ in range(rng.integers(1, 6))]
            offsets = np.append(0, np.cumsum([len(t) for t in texts]))
            text, start, end, period = periodic.runs_of(np.concatenate(texts), offsets)
            for i, words in enumerate(texts):
                own = text == i
                assert sorted(zip(start[own], (end - start)[own], period[own])) == runs_by_hand(words.tolist())


def test_common_prefixes_of_cover_suffixes():
    rng = np.random.default_rng(2)
    for kinds, n in ((1, 700), (2, 900), (50, 500)):
        words = np.append(some_words(rng, n, kinds) + 2, 1)
        suffixes = periodic.Suffixes(words)
        at = np.flatnonzero(np.isin(np.arange(len(words)) % periodic.STEP, periodic.COVER))
        i, j = rng.choice(at, 400), rng.choice(at, 400)
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(words)) if a + k == len(words) or b + k == len(words) or words[a + k] != words[b + k]) for a, b in zip(i, j)]
        assert suffixes.common(i, j).tolist() == want
    assert (periodic.SHIFTS < periodic.STEP).all()


def test_very_long_and_constant_texts():
    words = np.zeros(120_000, np.int64)
    words[60_000] = 1
    text, start, end, period = periodic.runs_of(words, np.array([0, 0, len(words), len(words)]))
    # Both halves, and the stretches around the one other word are shorter than two periods.
    assert list(zip(text, start, end, period)) == [(1, 0, 60_000, 1), (1, 60_001, 120_000, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(i - 5, " ".join(f"w{x}" for x in some_words(rng, int(rng.integers(0, 160)), int(rng.integers(1, 40)))), "r") for i in range(90)]
    rows += [(200, None, None), (201, "", "r"), (None, "a b " * 20, "r"), (202, " \t\n", "r"), (203, "\x0b" + "é ü\r\n" * 30 + "é", "r"), (204, "x " * 3000, "r"), rows[7], (None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, runs string")


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_hand(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_the_rule(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op12_periods(spark, str(tmp_path)).collect()]
    want = [expected(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 20


def test_empty_table_and_other_columns(docs):
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    assert periodic.periodic_runs(docs).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
