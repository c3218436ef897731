"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are runs of five words; a shingle weighs its count times the mean inverse document frequency of
its words. Each of BANDS * ROWS samples picks a shingle and a quantised weight so that two texts agree with the
probability of their weighted Jaccard similarity. Texts that agree in all samples of a band are candidates, and
candidates are verified by the exact weighted Jaccard similarity. Equal texts are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash64, key_of, look_up, mix, read, slices, split_words, stored, word_codes
from .components import components, joined

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Words in fewer than this share of the documents all get the largest weight, so the table of the others is bounded
#: by the mean number of distinct words of a document divided by it, whatever the number of documents.
RARE = 0.002
#: A bucket is never expanded into all its pairs. All its texts are first compared with its best connected one; then, turn
#: by turn, texts outside its largest class are compared with all texts of other classes, up to GROWTH, GROWTH ** 2, ...
#: of them a bucket, until each text outside the largest class has been compared. So no link between two classes is lost.
GROWTH = 32
SALT = 16
#: A text's mass is dealt over PARTS by shingle hash, in units of 1/UNIT of it, rounded up. What two texts share is at most
#: the sum of the smaller masses of each part, so most pairs that don't link are told apart without their texts.
PARTS, UNIT = 128, 8192


def node_of(text: Column) -> Column:
    """128-bit identity of a text; null and empty texts are the same."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Weights:
    """Inverse document frequencies of the words that are not rare; all others share the largest."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.idf = np.log(n / df[order]) + 1
        self.most = float(np.log(1 / RARE) + 1)

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of all texts, sorted within each: hashes, weights, and where each text's begin.

        A text of one to four words is one shingle; a text without words has none.
        """
        flat, offsets = split_words(texts)
        n = np.diff(offsets)
        if not len(flat):
            return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(len(n) + 1, np.int64)
        codes, distinct = word_codes(flat)
        hashed = hash64(distinct)
        at, known = look_up(self.hashes, hashed)
        idf = np.where(known, self.idf[at] if len(self.idf) else 0.0, self.most)[codes]
        hashed = mix(hashed.view(np.uint64))[codes]
        count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[text]
        width = np.minimum(n, SHINGLE)[text]
        key, weight = np.zeros(len(text), np.uint64), np.zeros(len(text))
        for i in range(SHINGLE):
            use = i < width
            place = np.where(use, start + i, 0)
            key = np.where(use, mix(key + hashed[place]), key)
            weight += np.where(use, idf[place], 0.0)
        weight /= width
        # Text number and the upper bits of the shingle in one number sort faster than one after the other; the shingle's
        # own bits decide where the upper ones are equal.
        bits = np.uint64(max(int(len(n)).bit_length(), 1))
        packed = text.astype(np.uint64) << (np.uint64(64) - bits) | key >> bits
        order = np.argsort(packed)
        packed, key, text, weight = packed[order], key[order], text[order], weight[order]
        tied = np.flatnonzero((packed[1:] == packed[:-1]) & (key[1:] != key[:-1]))
        if len(tied):
            order = np.lexsort((key, text))
            key, text, weight = key[order], text[order], weight[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        return key[head], np.add.reduceat(weight, head).astype(np.float32), np.searchsorted(text[head], np.arange(len(n) + 1))


def gamma_table() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution."""
    x = np.concatenate([np.linspace(0, 1, 20_001), np.linspace(1, 30, 60_001)[1:]])
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)


GAMMA = gamma_table().astype(np.float32)
LOG_GAMMA = np.log(gamma_table()).astype(np.float32)


def band_hashes(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each text with shingles (rows) and band (columns)."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    size = np.diff([*begin, len(keys)])
    log_w = np.log(weights)
    out = np.zeros((len(begin), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        x = mix(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = GAMMA[(x & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w / r + beta)
        a = LOG_GAMMA[(x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begin), size))
        first = least[np.searchsorted(least, begin)]
        sample = keys[first] ^ mix(t[first].astype(np.int64).view(np.uint64))
        out[:, k // ROWS] = mix(out[:, k // ROWS] + sample)
    return out.view(np.int64)


def part_masses(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mass of each text with shingles, and an upper bound of its share in each part (rows: texts, columns: parts)."""
    has = np.diff(offsets) > 0
    text = np.repeat(np.arange(has.sum()), np.diff(offsets)[has])
    place = text * PARTS + (mix(keys) % np.uint64(PARTS)).astype(np.int64)
    parts = np.bincount(place, weights.astype(np.float64), minlength=has.sum() * PARTS).reshape(-1, PARTS)
    mass = parts.sum(1)
    return mass, np.ceil(parts / mass[:, None] * UNIT - 1e-6).astype(np.int16)


def word_weights(docs: DataFrame) -> Weights:
    """Document frequencies over all documents; only those of words that are not rare come to the driver."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = split_words(part.column("text"))
                if len(flat):
                    codes, distinct = word_codes(flat)
                    pairs = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * len(distinct) + codes)
                    df = np.bincount(pairs % len(distinct), minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([pa.array(hash64(distinct)), pa.array(df)], names=["word", "df"])

    n = docs.count()
    counted = docs.select("text").mapInArrow(count, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    common = counted.where(F.col("df") > RARE * n).toPandas()
    return Weights(common.word.to_numpy(np.int64), common.df.to_numpy(float), n)


def candidates(placed: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of a hub and a text of another class in its bucket, each pair once.

    A text that has been a hub in this bucket has met them all. Pairs whose masses, or the masses of their parts, are
    too different for a similarity of ``least`` leave inside the join, and so does a pair in all but the first of the
    buckets in which the hub meets the text.
    """
    x, h = placed.where("not done").alias("x"), hubs.alias("h")
    close = F.least("x.mass", "h.ma") >= F.greatest("x.mass", "h.ma") * (least - 1e-4)
    smaller = F.zip_with("x.parts", "h.pa", lambda p, q: F.least(p * F.col("x.mass"), q * F.col("h.ma")))
    shared = F.aggregate(smaller, F.lit(0.0), lambda total, v: total + v) / UNIT
    enough = shared * (1 + least) >= (F.col("x.mass") + F.col("h.ma")) * (least - 1e-4)
    first = F.array_min(F.array_intersect("x.buckets", "h.places")) == F.col("x.bucket")
    met = x.join(h, (F.col("x.bucket") == F.col("h.bucket")) & (F.col("x.root") != F.col("h.ra")) & F.when(close, F.when(enough, first)).otherwise(False))
    lo, hi = F.least("node", "a"), F.greatest("node", "a")
    pairs = met.select(lo.alias("lo"), hi.alias("hi"), "a").groupBy("lo", "hi").agg(F.max("a").alias("a"))
    return pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, weights, least: float) -> DataFrame:
    """The pairs ``a, b`` whose weighted Jaccard similarity is at least ``least``. Pairs of a hub are dealt over parts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)))
    hubs = salted.select("a", "salt").distinct().join(texts.withColumnsRenamed({"node": "a"}), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    members = salted.join(texts.withColumnsRenamed({"node": "b"}), "b").select("a", "salt", "b", "text")

    def run(batches):
        hub, keys, mass = None, None, None
        for batch in batches:
            for part in slices(batch, "text"):
                key, weight, offsets = weights.value.shingles(part.column("text"))
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                found = []
                for i in range(len(a)):
                    own, mine = key[offsets[i] : offsets[i + 1]], weight[offsets[i] : offsets[i + 1]]
                    if b[i] is None:
                        hub, keys, mass = a[i], own, mine
                        continue
                    if a[i] != hub or not len(own) or not len(keys):
                        continue
                    at, there = look_up(keys, own)
                    shared = float(np.minimum(mine[there], mass[at[there]]).sum())
                    found.append((a[i], b[i])) if shared >= least * (float(mine.sum()) + float(mass.sum()) - shared) - 1e-6 else None
                x = list(zip(*found)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.binary()), pa.array(x[1], pa.binary())], names=["a", "b"])

    dealt = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``did, rid, node, class_id`` for each row: equal texts, and texts linked by candidates of similarity >= ``least``.

    ``class_id`` is the smallest id of the class (null ids don't count). Texts without words are only classed with
    equal texts. Which rows repeat, or have ids in common, changes nothing about a text's class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("did"), key_of(F.col("doc_id"), F.col("text")).alias("rid"), node_of(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(word_weights(rows))

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                key, weight, offsets = weights.value.shingles(part.column("text"))
                has = np.diff(offsets) > 0
                if has.any():
                    bands = band_hashes(key, weight, offsets)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                    mass, parts = part_masses(key, weight, offsets)
                    parts = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), PARTS).cast(pa.list_(pa.int16()))
                    yield pa.RecordBatch.from_arrays([part.column("node").filter(pa.array(has)), lists, pa.array(mass), parts], names=["node", "bands", "mass", "parts"])

    bands = rows.select("node", "text").mapInArrow(sketch, "node binary, bands array<bigint>, mass double, parts array<smallint>").dropDuplicates(["node"])
    bands = stored(bands)  # a few hundred bytes a text, instead of sketching twice
    members = bands.select("node", F.posexplode("bands").alias("band", "hash"))
    sizes = members.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = members.join(sizes, ["band", "hash"])
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    buckets = F.transform("bands", lambda h, i: F.xxhash64(i, h))
    members = members.join(degree, "node").join(bands.select("node", "mass", "parts", buckets.alias("buckets")), "node")
    members = stored(members.select(F.xxhash64("band", "hash").alias("bucket"), "node", "mass", "degree", "parts", "buckets"))
    texts = stored(rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))

    best = members.groupBy("bucket").agg(F.max(F.struct("degree", "node", "mass", "parts")).alias("m"))
    places = F.collect_list("bucket").over(W.partitionBy("a")).alias("places")  # no more than bands
    hubs = best.select("bucket", F.col("m.node").alias("a"), F.col("m.node").alias("ra"), F.col("m.mass").alias("ma"), F.col("m.parts").alias("pa")).select("*", places)
    placed = members.withColumn("root", F.col("node")).withColumn("done", F.lit(False))
    roots, turn = None, 0
    while True:
        new = verified(candidates(placed, hubs, least), texts, weights, least)
        roots = components(new) if roots is None else joined(roots, new)
        met = hubs.select("bucket", F.col("a").alias("node"), F.lit(True).alias("now"))
        placed = placed.drop("root").join(met, ["bucket", "node"], "left").withColumn("done", F.col("done") | F.col("now").isNotNull()).drop("now")
        placed = stored(placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        classes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("done")).alias("todo"))
        main = classes.groupBy("bucket").agg(F.max(F.struct("k", "root", "todo")).alias("m"), F.sum("todo").alias("todo"))
        # Buckets with texts outside their largest class still to compare.
        main = stored(main.where(F.col("todo") > F.col("m.todo")).select("bucket", F.col("m.root").alias("main")))
        if main.isEmpty():
            break
        placed = placed.join(main, "bucket")
        turn += 1
        # The limit on the rank is applied before the shuffle as well, so a large bucket never meets in one task.
        order = W.partitionBy("bucket").orderBy(F.col("degree").desc(), "node")
        others = placed.where("root <> main and not done").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= GROWTH**turn)
        # A text starts with one of its buckets; once linked there, it mostly needs no other.
        others = others.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("bucket"))).where(F.col("place") <= 4 ** (turn - 1))
        hubs = stored(others.select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("mass").alias("ma"), F.col("parts").alias("pa")).select("*", places))
        placed = placed.drop("main")
    labels = rows.select("did", "rid", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = labels.groupBy("root").agg(F.min("did").alias("class_id"))
    return labels.join(ids, "root").select("did", "rid", "node", "root", "class_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id, or any if it repeats."""
    classes = near_classes(docs, **options)
    keep = classes.groupBy("root").agg(F.min(F.struct(F.col("did").isNull(), "did", "rid")).alias("k"))
    keep = keep.select(F.col("k.did").alias("did"), F.col("k.rid").alias("rid")).distinct()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("did"), key_of(F.col("doc_id"), F.col("text")).alias("rid"), rest)
    keep = keep.withColumnsRenamed({"did": "kdid", "rid": "krid"})
    kept = rows.join(keep, (rows.rid == keep.krid) & rows.did.eqNullSafe(keep.kdid)).groupBy("did", "rid").agg(F.first("r").alias("r"))
    return kept.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents``; nulls, texts without words and repeated rows: see ``near_classes``. ``kept`` is null for
    a row without id."""
    classes = near_classes(read(spark, sf_dir, "documents"))
    return classes.select(F.col("did").alias("doc_id"), "class_id", (F.col("did") == F.col("class_id")).alias("kept"))
