"""Approximate nearest neighbours by cross-polytope hashing.

Each table has its own pseudo-rotation: three rounds of random signs and a fast Hadamard transform. A unit vector
hashes to the signed axis that it is nearest to after rotation. Rows stand in one bucket of every table; a query
probes the buckets of its largest rotated components. In a bucket the candidates are ranked by exact cosine, and
the best of all probed buckets are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import best, matrix, merged, usable, width_of

TABLES, PROBES = 10, 8
#: Queries of a larger bucket are dealt over parts of about QUERIES, its rows over parts of about ROWS.
QUERIES, ROWS, GROUP = 8192, 65536, 256
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three times random signs and a fast Hadamard transform over a width of a power of two."""
    width = x.shape[1]
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = x * s
        half = 1
        while half < width:
            x = x.reshape(len(x), -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
            half *= 2
        x = x.reshape(len(x), width) / np.sqrt(width)
    return x


def hashed(seed: int, tables: int, probes: int, every: int, width: int):
    """Rows to ``table, bucket, is_query, vec_id, v``: one bucket of each table as a candidate, ``probes`` as a query."""
    power = 1 << max(1, (width - 1).bit_length())

    def run(batches):
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("v")
            x = matrix(column, power)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            query = ids % every == 0
            for table in range(tables):
                y = rotate(x, table, seed)
                signed = np.concatenate([y, -y], 1)
                bucket = signed.argmax(1)
                p = min(probes, 2 * power)
                probed = np.argpartition(-signed[query], p - 1, axis=1)[:, :p]
                rows = np.concatenate([np.arange(len(ids)), np.repeat(np.flatnonzero(query), p)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), table, np.int32)),
                        pa.array(np.concatenate([bucket, probed.ravel()]).astype(np.int32)),
                        pa.array(np.arange(len(rows)) >= len(ids)),
                        pa.array(ids[rows]),
                        column.take(pa.array(rows)),
                    ],
                    names=["t", "bucket", "is_query", "vec_id", "v"],
                )

    return run


def bucket_top(k: int):
    """Exact cosines of one part of a bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        x = matrix(v, width_of(v))
        ids = table.column("vec_id").to_numpy()
        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(ids[~is_query], kind="stable")
        rows, row_ids = x[~is_query][order], ids[~is_query][order]
        row_norm = np.sqrt((rows * rows).sum(1))
        out = []
        if len(rows):
            for a in range(0, is_query.sum(), GROUP):
                some, own_ids = x[is_query][a : a + GROUP], ids[is_query][a : a + GROUP]
                cosine = some @ rows.T / np.sqrt((some * some).sum(1))[:, None] / row_norm
                for q, own, score in zip(some, own_ids, cosine):
                    left, right = np.searchsorted(row_ids, [own, own + 1])
                    score[left:right] = -np.inf
                    # Sums in a fixed order for those that may count, so that equal vectors tie in every bucket.
                    near = best(score, row_ids, 4 * k)
                    if len(near) == 4 * k:
                        near = np.flatnonzero(score >= score[near[k - 1]] - 1e-9)
                    near = near[score[near] > -np.inf]
                    exact = (rows[near] * q).sum(1) / (np.sqrt((q * q).sum()) * row_norm[near])
                    at = best(exact, row_ids[near], k)
                    out.append((np.full(len(at), own), row_ids[near][at], exact[at]))
        parts = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0)] * 3
        return pa.table(dict(zip(SCHEMA.names, parts)), schema=SCHEMA)

    return run


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, probes: int = PROBES, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest rows found, by exact cosine of the original vectors.

    Queries are rows whose id is divisible by ``every``; rows that share a query's id count as its own. Null or zero
    vectors and such with null or non-finite parts take no part. Vectors shorter than the longest are filled up with
    zeros. A row that shares no probed bucket with a query is missed; README gives the measured recall.
    """
    length = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = usable(embeddings).where(length > 0)
    n = rows.agg(F.max(F.size("v")).alias("width")).first()  # one number
    dealt = rows.mapInArrow(hashed(seed, tables, probes, every, n.width or 1), "t int, bucket int, is_query boolean, vec_id bigint, v array<double>")
    sizes = dealt.groupBy("t", "bucket").agg(F.count_if("is_query").alias("q"), F.count_if(~F.col("is_query")).alias("r")).where((F.col("q") > QUERIES) | (F.col("r") > ROWS))
    # Only buckets that are larger than a part are dealt over parts: at most tables x 2 x width rows come to the driver.
    large = [(x.t, x.bucket, -(-x.q // QUERIES) or 1, -(-x.r // ROWS) or 1) for x in sizes.collect()]
    parts = embeddings.sparkSession.createDataFrame(large, "t int, bucket int, q_parts int, r_parts int")
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    dealt = dealt.join(F.broadcast(parts), ["t", "bucket"], "left").select(*dealt.columns, one("q_parts"), one("r_parts"))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    queries = dealt.where("is_query").select("t", "bucket", own(F.col("q_parts"), 1).alias("qp"), each(F.col("r_parts")).alias("rp"), "is_query", "vec_id", "v")
    candidates = dealt.where("not is_query").select("t", "bucket", each(F.col("q_parts")).alias("qp"), own(F.col("r_parts"), 2).alias("rp"), "is_query", "vec_id", "v")
    groups = queries.unionByName(candidates).groupBy("t", "bucket", "qp", "rp")
    found = groups.applyInArrow(bucket_top(k), "query_id bigint, vec_id bigint, score double")
    return merged(found.distinct(), k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in all ``embeddings``; which vectors take part, ties and repeated ids: see ``nearest``. An empty table gives no rows."""
    return nearest(read(spark, sf_dir, "embeddings"))
