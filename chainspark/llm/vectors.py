"""Vectors of an ``embeddings`` table: usable rows only, and exact top-k helpers shared by both searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` (array<double>) of rows with an id and a vector, without null or non-finite components."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros, which change no inner product."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    size, values = np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
    return out


def width_of(column: pa.Array) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id. Partition selection, then a sort of what is left."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def merged(found: DataFrame, k: int, keep: tuple[Column, ...] = ()) -> DataFrame:
    """The k best of partial results (``query_id, vec_id, score``) of each query, ranked from 1."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
