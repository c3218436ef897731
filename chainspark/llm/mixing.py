"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents stand in a shuffled order and are cut into blocks of equally many words (``block``, or fewer
where a source's target is small). Slot i of the schedule holds the golden-ratio point frac(i * phi); the cumulative
shares of the sources, in blocks, map it to a source, the slots of a source are ranked, and rank r takes block r of
the source, starting again after the last one. Any prefix of the schedule is thus mixed in nearly the target
proportions. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, key_of, read

GOLDEN = 0.6180339887498949
CELLS, HASH_BUCKETS, CHUNK = 4096, 1024, 1 << 16
#: A source gets blocks so small that its target is at least so many of them, as far as words allow.
LEAST_BLOCKS = 256


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def source_key(source: Column) -> Column:
    """Never null, and different for null and every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: float, block: int) -> DataFrame:
    """One row per source (``skey, source, source_size`` in): its number, target words, words a block and blocks.

    The k-th source in code point order (null last) weighs ``weights[k mod n]``. Targets are min(repeat * size,
    level * weight), the point where sharing out the excess again and again ends; the level comes from sources
    sorted by the level at which each is full. The windows run over one row per source, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("no", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("double"))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    full = W.orderBy(F.col("cap") / F.col("weight"), "no")
    whole = full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    levels = listed.withColumn("level", level).withColumn("at", F.row_number().over(full))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))
    levels = levels.withColumn("first", F.min(fits).over(whole))
    target = F.least("cap", F.coalesce(F.col("first.level") * F.col("weight"), F.col("cap")))
    targets = levels.select("skey", "no", "source_size", target.alias("target"))
    words = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("target") / LEAST_BLOCKS))).cast("bigint")
    return targets.withColumn("block_size", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_size")))


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """One row per slot: ``slot, skey, rank, blocks`` and ``block`` of the source's shuffled stream.

    A source without words gets no slot. Its share of the slots is its target in blocks of its mean block size.
    """
    some = targets.where("source_size > 0").withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))
    total = some.agg(F.sum("slots")).first()[0] or 0.0  # one number
    upto = W.orderBy("no")
    high = F.sum("slots").over(upto) / F.lit(total or 1.0)
    low = F.coalesce(F.sum("slots").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / F.lit(total or 1.0)
    spans = some.select("skey", "no", "blocks", low.alias("low"), F.when(F.col("no") == F.max("no").over(W.partitionBy(F.lit(1))), F.lit(2.0)).otherwise(high).alias("high"))
    # A point meets the few sources of its cell only: an even equi-join for any number of sources.
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = spark.range(round(total)).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("x")).withColumn("cell", cell(F.col("x")))
    hit = points.join(spans, "cell").where("low <= x and x < high").select("slot", "skey", "blocks", div(F.col("slot"), CHUNK).alias("chunk"))
    counts = hit.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("skey", "chunk").orderBy("slot")
    ranked = hit.withColumn("rn", F.row_number().over(within) - 1).join(counts, ["skey", "chunk"])
    return ranked.select("slot", "skey", (F.col("before") + F.col("rn")).alias("rank"), "blocks").withColumn("block", F.col("rank") % F.col("blocks"))


def streams(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (skey, key, size and more) with ``start``: where a document begins in its source's shuffled stream.

    Two levels: hash buckets of a source are summed first, then running sums stay within a bucket, so a source
    with a third of all rows is dealt over many tasks.
    """
    placed = docs.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(HASH_BUCKETS)))
    sizes = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("skey", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("skey", "bucket").orderBy("h", "key").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sizes, ["skey", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("h", "bucket", "before", "inside")


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeat: float = 2.0, block: int = 128, seed: int = 11) -> DataFrame:
    """``doc_id, key, size, source_size, target, taken`` for every row: the words that the mix takes of it.

    Null texts have size 0; documents without words, and sources of such documents only, are taken 0 times.
    Rows that repeat are taken one by one. At most ``repeat`` passes go over a source. ``key`` is the 64-bit
    hash of id and text, for joining back. An empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    rows = cut(docs.select("doc_id", key_of(F.col("doc_id"), F.col("text")).alias("key"), F.col("source").cast("string").alias("source"), source_key(F.col("source")).alias("skey"), size.alias("size")))
    targets = source_targets(rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, share, repeat, block)
    targets = cut(targets)  # one row per source
    slots = schedule(rows.sparkSession, targets)
    takes = slots.where(F.col("rank") < F.col("blocks") * int(repeat)).groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = streams(rows.where("size > 0").select("doc_id", "key", "skey", "size"), seed).join(targets.select("skey", "block_size"), "skey")
    end, b = F.col("start") + F.col("size"), F.col("block_size")
    pieces = placed.withColumn("block", F.explode(F.sequence(div(F.col("start"), b), div(end - 1, b))))
    words = F.least(end, (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b)
    got = pieces.withColumn("words", words).join(takes, ["skey", "block"], "left")
    taken = got.groupBy("skey", "start", "doc_id", "key", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
    empty = rows.where("size = 0").select("skey", "doc_id", "key", "size", F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(empty).join(targets, "skey").select("doc_id", "key", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: every row as many times as the mix takes it, to the nearest whole (0, 1 or 2).

    Documents without words (null, empty or white space only) add nothing to a mix measured in words and are in it no
    times. Rows of equal id and text are taken equally often. The columns are those of ``docs``, whatever their names.
    """
    plan = mix_documents(docs, **options).where("size > 0").groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = plan.select("key", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    rest = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kept = docs.select(key_of(docs["doc_id"], docs["text"]).alias("key"), rest).join(copies, "key")
    repeats = kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeats.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all ``documents``; see ``mix_documents`` for nulls, empty texts, repeated rows and empty tables."""
    return mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
