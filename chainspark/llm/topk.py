"""Exact top-k by inner product, term at a time.

Queries and candidates are cut into blocks; each pair of blocks meets in one task. There the candidates become
postings by component; every non-zero query weight scatters its weighted postings into dense arrays of scores,
and partition selection keeps k of each block. The partial lists are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import best, matrix, merged, usable, width_of

QUERY_BLOCK, ROW_BLOCK, GROUP = 4096, 16384, 64
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scores(queries: np.ndarray, postings: list[tuple[np.ndarray | slice, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores of some queries: one posting list after another. Full lists need no row numbers."""
    out = np.zeros((len(queries), n), np.int64)
    for term, (at, weight) in enumerate(postings):
        some = np.flatnonzero(queries[:, term])
        if not len(some) or not len(weight):
            continue
        if len(some) == len(queries):
            some = slice(None)
        q = queries[some, term][:, None]
        if isinstance(at, slice):
            out[some] += q * weight
        elif isinstance(some, slice):
            out[:, at] += q * weight
        else:
            out[np.ix_(some, at)] += q * weight
    return out


def block_top(k: int):
    """A task gets all rows of its pairs of blocks: ``is_query, vec_id, v``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        width = width_of(v)
        values = np.floor(matrix(v, width)).astype(np.int64)
        ids = table.column("vec_id").to_numpy()
        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(ids[~is_query], kind="stable")
        rows, row_ids = values[~is_query][order], ids[~is_query][order]
        queries, query_ids = values[is_query], ids[is_query]
        postings = []
        for term in range(width):
            at = np.flatnonzero(rows[:, term])
            full = 2 * len(at) > len(rows)  # zeros in a nearly full list add nothing
            postings.append((slice(None), np.ascontiguousarray(rows[:, term])) if full else (at, rows[at, term]))
        out = []
        for a in range(0, len(queries), GROUP):
            block = scores(queries[a : a + GROUP], postings, len(rows))
            for own, score in zip(query_ids[a : a + GROUP], block):
                left, right = np.searchsorted(row_ids, [own, own + 1])
                score[left:right] = np.iinfo(np.int64).min  # the query's own row
                at = best(score, row_ids, k)
                at = at[score[at] > np.iinfo(np.int64).min]
                out.append((np.full(len(at), own), row_ids[at], score[at]))
        parts = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(SCHEMA.names, parts)), schema=SCHEMA)

    return run


def top_inner_products(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of floor(scale * x) vectors.

    Queries are rows whose id is divisible by ``every``; rows that share a query's id count as its own and are not
    its candidates. Rows with a null or non-finite part take no part; missing last components count as 0. Blocks
    follow from two counts of rows, and rows go to blocks by hash.
    """
    rows = usable(embeddings).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    is_query = F.col("vec_id") % every == 0
    n = embeddings.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()  # two numbers
    q_blocks, r_blocks = max(1, -(-(n.q or 0) // query_block)), max(1, -(-n.n // row_block))
    q_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int")
    r_block = F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(r_blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).distinct().select(q_block.alias("qb"), each(r_blocks).alias("rb"), "vec_id", "v", F.lit(True).alias("is_query"))
    candidates = rows.select(each(q_blocks).alias("qb"), r_block.alias("rb"), "vec_id", "v", F.lit(False).alias("is_query"))
    pairs = queries.unionByName(candidates)
    found = pairs.groupBy("qb", "rb").applyInArrow(block_top(k), "query_id bigint, vec_id bigint, score bigint")
    return merged(found, k)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best inner products in all ``embeddings``; ties go to the smaller id, vectors that are null or hold null or non-finite
    components take no part, and an empty table gives no rows."""
    return top_inner_products(read(spark, sf_dir, "embeddings"))
