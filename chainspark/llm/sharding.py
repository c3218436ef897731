"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, of global row numbers.

Only DataFrame functions are used. A row's shard and slot follow from its global number and the number of
rows alone, so a reader can compute where any row went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read

ROUNDS, WALKS, PRIME = 6, 96, 2147483647


def number_rows(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """Columns ``r`` (the row as a struct), ``rn`` (global number from 0) and ``total``.

    Numbers depend on the rows' values only, not on partitions. Equal rows are counted before the shuffle and
    then get consecutive numbers, so copies of one row never pile up in a task before they are numbered. Rows
    go to ``buckets`` hash buckets that are numbered apart; only the bucket sizes are summed up in one place.
    """
    r = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r")
    groups = rows.select(r).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("b", F.pmod(F.xxhash64("r"), F.lit(buckets)))
    sizes = groups.groupBy("b").agg(F.sum("n").alias("size"))
    every = W.orderBy("b")
    offsets = sizes.select(
        "b",
        F.coalesce(F.sum("size").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    before = W.partitionBy("b").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(before), F.lit(0))
    return (
        groups.join(F.broadcast(offsets), "b")  # at most one row for each bucket
        .select("r", "n", "total", first.alias("first"))
        .select("r", "total", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rn"))
    )


def permuted(number: Column, total: Column, seed: int = 7) -> Column:
    """The place of ``number`` in a pseudo-random order of 0 .. total-1.

    The Feistel network permutes 0 .. 2^bits-1 with 2^bits < 2 * total; places beyond the end are walked on, each
    step ending with probability over 1/2, and the last of ``WALKS`` raises an error rather than give a wrong place.
    """
    bits = F.greatest(F.lit(2), F.length(F.bin(total - 1)))
    right_bits = F.call_function("div", bits + 1, F.lit(2)).cast("int")
    left_size = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bits - right_bits).cast("int"))
    right_size = F.call_function("shiftleft", F.lit(1).cast("bigint"), right_bits)
    keys = F.array(*[F.lit((seed * 2654435761 + 40503 * (i + 1) * (i + 7)) % PRIME).cast("bigint") for i in range(ROUNDS)])

    def round_(state: Column, key: Column) -> Column:
        mixed = F.pmod((F.pmod(state.r + key, F.lit(PRIME))) * F.pmod(state.r + key * 3 + 1, F.lit(PRIME)), F.lit(PRIME))
        new = F.pmod(state.l.bitwiseXOR(F.call_function("div", mixed, F.lit(64))), state.ls)
        return F.struct(state.r.alias("l"), new.alias("r"), state.rs.alias("ls"), state.ls.alias("rs"))

    def network(x: Column) -> Column:
        start = F.struct(
            F.call_function("div", x, right_size).alias("l"), F.pmod(x, right_size).alias("r"), left_size.alias("ls"), right_size.alias("rs")
        )
        return F.aggregate(keys, start, round_, lambda s: s.l * right_size + s.r)

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), network(number), lambda x, _: F.when(x < total, x).otherwise(network(x))
    )
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("bigint"))


def shard_rows(rows: DataFrame, n_shards: int = 8, seed: int = 7) -> DataFrame:
    """Every row of ``rows`` with ``shard`` and ``slot``; shards differ by one row at most, slots have no gaps.

    Nulls and empty texts are values like others, repeated rows get a place each, an empty table stays empty.
    Columns called shard or slot are replaced; map columns can't be compared and are not accepted.
    """
    placed = number_rows(rows).select("r", permuted(F.col("rn"), F.col("total"), seed).alias("place"))
    kept = [F.col("r").getField(c).alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return placed.select(
        *kept,
        F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(n_shards)).cast("bigint").alias("slot"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all ``documents`` under the law of equal counts: null and empty texts have size 1 and crc 0; equal and
    repeated rows are rows of their own; an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
