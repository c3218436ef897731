"""Toxicity by two class-conditional Kneser-Ney models.

One model is counted on toxic and one on ordinary documents. A word counts, as in Kneser-Ney, as often as it has
different words before it in the documents of a class. Absolute discounting takes a constant from each count, and with it
a multiple of what the other class has, both scaled to one size; all mass that is freed goes to one distribution,
pooled from both classes. So rare expressions, and words that stand in both classes, have nearly the same probability in both models,
and only what one class has far more often tells them apart. A text's two log-likelihoods are normalised by its
length; their difference becomes a probability by a logistic curve, fitted on labelled texts that the scoring models
have not seen (each is scored by a model of the other folds).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash64, look_up, read, remainder, slices, split_words, sums, word_codes

#: Counts are scaled to the class with fewer; from each goes DISCOUNT, and EXPLAINED times the count of the other class.
DISCOUNT, EXPLAINED = 3.0, 5.0
#: At most so many labelled toxic documents, and ORDINARY times as many others, are fitted on, in FOLDS parts.
SAMPLE, ORDINARY, FOLDS = 3000, 4, 4
#: Words added to the length of each text, so that a word of a very short text doesn't decide alone; the least difference.
LENGTH, FLOOR = 20.0, 0.003
THRESHOLD = 0.7
PAIR_SCHEMA = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("m0", pa.int64()), ("m1", pa.int64())])


@dataclass
class Model:
    """Log-likelihood ratios by hashed word, where the classes differ, of all texts and without each fold; sizes follow SAMPLE."""

    words: np.ndarray
    ratios: np.ndarray  # a column for all texts, then one for each fold left out
    curve: tuple[float, float]  # slope and height of the logistic curve

    def difference(self, texts: pa.Array, column: np.ndarray | int = 0) -> np.ndarray:
        """Logarithm of the difference of the two length-normalised log-likelihoods of each text; ``column``: which models."""
        flat, offsets = split_words(texts)
        n, total = np.diff(offsets), np.zeros(len(texts))
        if len(flat) and len(self.words):
            codes, distinct = word_codes(flat)
            at, known = look_up(self.words, hash64(distinct))
            chosen = np.repeat(np.broadcast_to(column, n.shape), n)
            total = sums(np.where(known[codes], self.ratios[at[codes], chosen], 0.0), offsets)
        return np.log(np.maximum(total / (n + LENGTH), 0.0) + FLOOR)

    def score(self, texts: pa.Array) -> np.ndarray:
        slope, height = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * self.difference(texts) + height, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, slightly drawn to 0."""
    beta = np.zeros(x.shape[1])
    ridge = strength * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), slope)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def context_folds(batches):
    """Bigrams of labelled documents (``text, toxic, part``), with the folds in which they occur as bits, by class."""
    for batch in batches:
        for part in slices(batch, "text"):
            flat, offsets = split_words(part.column("text"))
            if not len(flat):
                continue
            codes, distinct = word_codes(flat)
            hashed = hash64(distinct)[codes]
            n = np.diff(offsets)
            before = np.roll(hashed, 1)
            before[offsets[:-1][n > 0]] = 0  # the first word follows the beginning of the text
            toxic, fold = (np.repeat(part.column(c).to_numpy(), n).astype(np.int64) for c in ("toxic", "part"))
            kinds = pd.DataFrame({"v": before, "w": hashed, "toxic": toxic, "bit": np.int64(1) << fold}).drop_duplicates()
            kinds["m0"], kinds["m1"] = kinds.bit.where(kinds.toxic == 0, 0), kinds.bit.where(kinds.toxic == 1, 0)
            out = kinds.groupby(["v", "w"], sort=False)[["m0", "m1"]].sum().reset_index()  # bits are distinct, so sums are unions
            yield pa.RecordBatch.from_pandas(out[["v", "w", "m0", "m1"]], schema=PAIR_SCHEMA, preserve_index=False)


def sample_labels(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` toxic ids outside the held-out part, in hash order, ORDINARY times as many others, and the class sizes."""
    clean = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id"), 3) != 1)
    clean = clean.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in clean.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    order = F.xxhash64("doc_id", F.lit(5))
    parts = [clean.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in ((0, ORDINARY * per_class), (1, per_class))]
    picked = parts[0].unionByName(parts[1]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(FOLDS)))
    return picked, sizes


def word_ratios(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and their log-likelihood ratios, for all folds and without each: those that either class has more often.

    ``pairs``: ``v, w, m0, m1``. What comes to the driver are sums and no more than the words of the sample.
    """
    models = range(FOLDS + 1)
    seen = lambda c, g: F.col(f"m{c}").bitwiseAND(F.lit((1 << FOLDS) - 1 if not g else ((1 << FOLDS) - 1) ^ (1 << (g - 1)))) != 0
    every = pairs.groupBy("w").agg(*[F.count_if(seen(c, g)).cast("double").alias(f"k{c}_{g}") for c in (0, 1) for g in models]).persist()
    t = every.agg(*[F.sum(f"k{c}_{g}").alias(f"t{c}_{g}") for c in (0, 1) for g in models]).first().asDict()  # one row
    t = {k: v or 1.0 for k, v in t.items()}
    both = lambda g: F.col(f"k0_{g}") + F.col(f"k1_{g}")
    pooled = lambda g: both(g) / F.lit(t[f"t0_{g}"] + t[f"t1_{g}"])
    size = [min(t[f"t0_{g}"], t[f"t1_{g}"]) for g in models]
    scaled = lambda c, g: F.col(f"k{c}_{g}") * F.lit(size[g] / t[f"t{c}_{g}"])
    own = every.withColumns({f"e{c}_{g}": F.greatest(scaled(c, g) - DISCOUNT - EXPLAINED * scaled(1 - c, g), F.lit(0.0)) for c in (0, 1) for g in models})
    kept = own.agg(*[F.sum(f"e{c}_{g}").alias(f"e{c}_{g}") for c in (0, 1) for g in models]).first().asDict()  # one row
    free = {k: size[int(k[3:])] - (v or 0.0) for k, v in kept.items()}
    # Over the probability that the class gives a word without counts of its own.
    p = lambda c, g: F.when(F.col(f"e{c}_{g}") > 0, F.col(f"e{c}_{g}") / (F.lit(free[f"e{c}_{g}"]) * pooled(g))).otherwise(0.0) + 1.0
    ratio = [(F.ln(p(1, g)) - F.ln(p(0, g))).alias(f"r{g}") for g in models]
    table = own.where(" or ".join(f"e{c}_{g} > 0" for c in (0, 1) for g in models)).select("w", *ratio).toPandas().sort_values("w")
    every.unpersist()
    return table.w.to_numpy(np.int64), table[[f"r{g}" for g in models]].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Fit on a bounded sample: what comes to the driver are counts of the words of at most (1 + ORDINARY) * per_class texts.

    Rows without id, text or a label 0 or 1 are not learned from; of several labels of an id the larger counts.
    Without both classes the model gives every text the share of toxic labels (0.5 if there are none).
    """
    picked, sizes = sample_labels(labels.select("doc_id", "toxic"), per_class)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # so many ids
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        share = 0.5 if not sizes else float(1 in sizes)
        return Model(np.zeros(0, np.int64), np.zeros((0, FOLDS + 1)), (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    pairs = rows.select("text", "toxic", "part").mapInArrow(context_folds, "v bigint, w bigint, m0 bigint, m1 bigint")
    words, ratios = word_ratios(pairs.groupBy("v", "w").agg(F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1")))
    model = Model(words, ratios, (1.0, 0.0))
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def differences(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = shared_model.value.difference(part.column("text"), part.column("part").to_numpy().astype(np.int64) + 1)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(x)], names=["toxic", "x"])

    held = rows.select("text", "toxic", "part").mapInArrow(differences, "toxic int, x double").toPandas()
    y, x = held.toxic.to_numpy(float), held.x.to_numpy(float)
    if 0 < y.sum() < len(y) and x.std() > 0:
        weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
        order = np.lexsort((y, x))  # sums in one order, whatever the partitions
        middle, spread = x[order].mean(), x[order].std()
        slope, height = logistic(np.stack([(x[order] - middle) / spread, np.ones(len(x))], 1), y[order], (weight * len(y) / weight.sum())[order])
        model.curve = (slope / spread, height - slope * middle / spread)
    return model


def score_documents(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score of the whole text (0 to 1) in column ``name``, replaced if there; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    full = docs.select(*[docs[c] for c in kept])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                score = pa.array(shared.value.score(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*kept, name])

    return full.mapInArrow(run, T.StructType([*full.schema.fields, T.StructField(name, T.DoubleType())]))


def ordinary_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; null and empty texts have no words and get the score of a text without any sign."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = narrow_scores(docs, model)
    held = remainder(F.col("doc_id"), 3) == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def narrow_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` only: the text does not come back from Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
