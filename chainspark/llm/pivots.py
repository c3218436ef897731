"""Near-duplicate vectors by an index of pivot permutations.

A vector is described by its NEAREST reference points (pivots), nearest first; near vectors share most of them. Pivots
are numbered from rare to frequent. A pair that shares SHARED of NEAREST pivots also shares one among the
NEAREST - SHARED + 1 rarest of each, so the inverted lists of these alone hold every such pair, and the pair belongs to
the list of the rarest pivot that both have. In a list, vectors' other pivots are counted over lists of their own; pairs
that share enough are verified by their exact cosine. Links are counted, and joined to components, where they are
found: only a row a vector leaves a list, however many links it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, stored
from .components import components
from .superkmers import most_frequent, spread_join
from .vectors import matrix, width_of

LEAST = 0.98
NEAREST, SHARED = 8, 4
#: At most so many reference points, drawn by a hash of the id from a sample of PER_ROOT times the root of the number of
#: vectors; one that has a cosine of APART or more with an earlier one is left out, so a dense group has few of them.
PIVOTS, PER_ROOT, APART = 1 << 15, 8, 0.9
#: Their number is halved until this share of PROBES vectors finds a neighbour made at just the least cosine.
RECALL, PROBES = 0.995, 512
#: Components of vectors in one tile of a list, and counts or products held at once.
TILE, BLOCK = 1 << 21, 1 << 21
LINKS = "h1 bigint, h2 bigint, node bigint, root bigint, links bigint"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` pivots of largest cosine of each row (unit vectors), nearest first."""
    k = min(k, len(pivots))
    out = np.empty((len(x), k), np.int32)
    step = max(1, BLOCK // len(pivots))
    for a in range(0, len(x), step):
        score = x[a : a + step] @ pivots.T
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        out[a : a + step] = np.take_along_axis(top, order, 1)
    return out


def thinned(sample: np.ndarray) -> np.ndarray:
    """Those of a sample of unit vectors that have a cosine under APART with every one kept before."""
    kept = np.empty_like(sample)
    n = 0
    for a in range(0, len(sample), 256):
        some = sample[a : a + 256]
        far = (some @ kept[:n].T).max(1, initial=-1.0) < APART
        among = some @ some.T
        mine: list[int] = []
        for i in np.flatnonzero(far):
            if not mine or among[i, mine].max() < APART:
                mine.append(i)
        kept[n : n + len(mine)] = some[mine]
        n += len(mine)
    return kept[:n]


def enough(pivots: np.ndarray, probes: np.ndarray, least: float, seed: int) -> np.ndarray:
    """The first pivots, as many as let RECALL of the probes share SHARED pivots with a neighbour at the least cosine."""
    noise = np.random.default_rng(seed).standard_normal(probes.shape)
    noise -= (noise * probes).sum(1, keepdims=True) * probes
    other = least * probes + np.sqrt(1 - least * least) * unit(noise) if probes.shape[1] > 1 else probes
    while len(pivots) > 4 * NEAREST:
        a, b = nearest(probes, pivots, NEAREST), nearest(other, pivots, NEAREST)
        if ((a[:, :, None] == b[:, None, :]).sum((1, 2)) >= SHARED).mean() >= RECALL:
            break
        pivots = pivots[: len(pivots) // 2]
    return pivots


@dataclass(frozen=True)
class Index:
    """The pivots, from rare to frequent once counted, and how many parts the longest lists are dealt over."""

    pivots: np.ndarray
    parts: dict[tuple[str, int], int]

    @property
    def shared(self) -> int:
        return min(SHARED, len(self.pivots))

    @property
    def listed(self) -> int:
        return min(NEAREST, len(self.pivots)) - self.shared + 1


def fitted(nodes: DataFrame, n: int, width: int, least: float, seed: int) -> np.ndarray:
    """Reference points from a sample bounded by PIVOTS and by the root of the number of vectors."""
    size = min(PIVOTS, max(4 * NEAREST, int(PER_ROOT * n**0.5)), (1 << 24) // width + 1)
    rows = nodes.orderBy(F.xxhash64("h1", F.lit(seed)), "h1", "h2").select("v").limit(size).toArrow()
    sample = unit(matrix(rows.column("v").combine_chunks(), width))
    return enough(thinned(sample), sample[:PROBES], least, seed)


def descriptions(index: Index, width: int):
    """Rows (``label, h1, h2, node, copies, v``) with ``near``: their nearest pivots as sorted numbers."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.sort(nearest(unit(matrix(batch.column("v"), width)), index.pivots, NEAREST), 1)
                cuts = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
                yield batch.append_column("near", pa.ListArray.from_arrays(cuts, pa.array(near.ravel())))

    return run


def tiles(index: Index):
    """Described rows to ``c, x, y, b``: once for each list, and in a long list once for each tile that needs its part b."""

    def run(batches):
        for batch in batches:
            near = matrix(batch.column("near"), width_of(batch.column("near"))).astype(np.int64)[:, : index.listed]
            row, c = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
            b, parts = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
            if index.parts:
                labels, part = batch.column("label").to_pylist(), batch.column("h2").to_numpy().view(np.uint64) >> np.uint64(20)
                parts = np.array([index.parts.get((labels[r], k), 1) for r, k in zip(row.tolist(), c.tolist())], np.int64)
                b = (part[row] % parts.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(row)), parts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            x, y = np.minimum(b[again], other), np.maximum(b[again], other)
            columns = [pa.array(v.astype(np.int32)) for v in (c[again], x, y, b[again])]
            for a in range(0, len(again), 4096):
                some = pa.array(row[again[a : a + 4096]])
                yield pa.RecordBatch.from_arrays([*(v.take(some) for v in batch.columns), *(v.slice(a, 4096) for v in columns)], names=[*batch.schema.names, "c", "x", "y", "b"])

    return run


def counted_pairs(near: np.ndarray, left: np.ndarray, right: np.ndarray, shared: int):
    """Pairs of rows of ``left`` and ``right`` that share so many pivots, by lists of the right rows, some rows at a time."""
    order = np.argsort(near[right].ravel(), kind="stable")
    pivot, member = near[right].ravel()[order], order // near.shape[1]
    step = max(1, BLOCK // max(len(right), 1))
    for a in range(0, len(left), step):
        own = near[left[a : a + step]]
        begin, end = np.searchsorted(pivot, own.ravel()), np.searchsorted(pivot, own.ravel(), "right")
        hits = np.zeros(len(own) * len(right), np.int32)
        for k in range(near.shape[1]):  # one pivot of each row at a time: what is held stays near BLOCK
            lo, size = begin[k :: near.shape[1]], (end - begin)[k :: near.shape[1]]
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            hits[np.repeat(np.arange(len(own)) * len(right), size) + member[at]] += 1
        pair = np.flatnonzero(hits >= shared)
        yield left[a + pair // max(len(right), 1)], right[pair % max(len(right), 1)]


def links_of(least: float, shared: int):
    """The links of one tile: each vector that has any, with their number and the smallest vector that they reach."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c, x, y = (k.as_py() for k in key[1:])
        table = table.combine_chunks()
        v, near = table.column("v").combine_chunks(), table.column("near").combine_chunks()
        rows, near = matrix(v, width_of(v)), matrix(near, width_of(near)).astype(np.int32)
        copies, node, b = (table.column(k).to_numpy() for k in ("copies", "node", "b"))
        length = np.sqrt((rows * rows).sum(1))
        links, root = np.zeros(len(rows), np.int64), np.argsort(np.lexsort((np.arange(len(rows)), node)))
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        for i, j in counted_pairs(near, left, right, shared):
            if x == y:
                i, j = i[i < j], j[i < j]
            # Sorted numbers: the first common one is the rarest, and its list owns the pair.
            for a in range(0, len(i), 1 << 14):
                p, q = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                cosine = (rows[p] * rows[q]).sum(1) / (length[p] * length[q])
                near_enough = cosine >= least
                p, q = p[near_enough], q[near_enough]
                common = (near[p][:, :, None] == near[q][:, None, :]).any(2)
                own = near[p, common.argmax(1)] == c
                p, q = p[own], q[own]
                links += np.bincount(p, copies[q], len(rows)).astype(np.int64) + np.bincount(q, copies[p], len(rows)).astype(np.int64)
                root = hooked(root, p, q)
        has = np.flatnonzero(links)
        smallest = np.sort(node)  # place in the order of ids to id
        return pa.table([table.column("h1").take(has), table.column("h2").take(has), pa.array(node[has]), pa.array(smallest[root[has]]), pa.array(links[has])], names=["h1", "h2", "node", "root", "links"])

    return run


def hooked(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels after the classes of p and q are joined: each label is a place in the order of ids, and leads to a smaller one."""
    parent = np.arange(len(root))
    a, b = root[p], root[q]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (next_ := parent[parent]).tolist() != parent.tolist():
            parent = next_
        a, b = parent[a], parent[b]
    return parent[root]


def linked(embeddings: DataFrame, least: float = LEAST, seed: int = 13) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row: links to rows of the same label with a cosine of ``least`` or more.

    Links need SHARED common pivots; README gives the measured recall. No link below ``least`` is reported. Equal vectors of
    a label are one node of the search and count each other as links. Rows whose id, label or vector is null, and zero
    vectors and such with null or non-finite parts, link with nothing. Vectors shorter than others are filled up with
    zeros. Repeated ids are vectors of their own that share a component; a row without id is kept, without component.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(fit, F.col("label").cast("string")).alias("label"), F.when(fit, v).alias("v"))
    keyed = rows.where("label is not null").withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label")})
    nodes = keyed.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    nodes = stored(nodes)
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()  # two numbers
    narrow = rows.where("label is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n.n:
        found = links_between(nodes, n.n, n.width, least, seed)
        sums = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = nodes.select("h1", "h2", "node", "copies").join(sums, ["h1", "h2"], "left").join(roots, "node", "left")
        facts = known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
        often = most_frequent(nodes, "h1", "copies")
        spread = spread_join(keyed.select("vec_id", "h1", "h2"), facts, ["h1", "h2"], often, ["vec_id"])
        narrow = narrow.unionByName(spread.select("vec_id", "n_links", "component_id"))
    return narrow.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def links_between(nodes: DataFrame, n: int, width: int, least: float, seed: int) -> DataFrame:
    """``h1, h2, node, root, links`` of different vectors, a row for each and tile in which it has links."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", near array<int>"
    pivots = fitted(nodes, n, width, least, seed)
    near = nodes.mapInArrow(descriptions(Index(pivots, {}), width), schema).select(F.explode("near").alias("c"))
    times = np.zeros(len(pivots), np.int64)
    for r in near.groupBy("c").count().collect():  # one row a pivot
        times[r.c] = r["count"]
    index = Index(pivots[np.argsort(times, kind="stable")], {})
    described = stored(nodes.mapInArrow(descriptions(index, width), schema))
    size = max(256, TILE // width)
    lists = described.select("label", F.explode(F.slice("near", 1, index.listed)).alias("c")).groupBy("label", "c").count()
    long = lists.where(F.col("count") > size).collect()  # at most one for each `size` rows of lists
    index = Index(index.pivots, {(r.label, r.c): -(-r["count"] // size) for r in long})
    dealt = described.mapInArrow(tiles(index), schema + ", c int, x int, y int, b int")
    return cut(dealt.groupBy("label", "c", "x", "y").applyInArrow(links_of(least, index.shared), LINKS))


def op13_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``; rows that can't link (see ``linked``) have none and are kept."""
    return linked(read(spark, sf_dir, "embeddings"))
