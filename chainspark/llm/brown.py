"""Language-model scores by Brown classes: class transitions times word emissions.

Exchange clustering assigns the most frequent words (``seeds_of`` says how many) to classes that make their bigrams
likely; every other word joins the class that fits best to all its neighbours that are seeds, over all training texts. Texts are then
written as sequences of final classes, a byte a token; transitions are counted and texts are scored on these. A text's
probability is the product, over its words and its end, of the probability of the word's class after the class before
and of the word in its class. Counts of all words of all training texts stay in tables; what the driver sees is bounded
by MOST_SEEDS and CLASSES.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, hash64, key_of, look_up, raw_bytes, read, remainder, slices, split_words, stored, sums, word_codes

#: Words that are exchanged: the root of the number of tokens by SEED_ROOT, within these bounds. The driver holds their bigrams.
SEEDS, MOST_SEEDS, SEED_ROOT = 1024, 2048, 8
CLASSES, SWEEPS = 48, 6
#: Words that make up this share of all tokens (so at most 1 / HEAD_SHARE words) are sent to every worker; the counts
#: of all others are joined to their texts.
HEAD_SHARE = 4e-6
GROUP_BYTES = 12 << 20  # bytes of texts that look up their words together, in the mean
BACKOFF = 100.0
END = np.int64(-1)  # stands for the end of a text
NONE = CLASSES + 1  # class after an unknown word; CLASSES itself is the class of the end
OWN = 2 * (NONE + 1)  # where counts by neighbour have a seed's own count
CODED = ("n_tokens", "n_known", "base_score", "emission", "classes")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words and ends in order, the hash of each code, and where each text's tokens begin."""
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, distinct = word_codes(flat) if len(flat) else (np.zeros(0, np.int64), pa.array([], pa.string()))
    hashed = np.append(hash64(distinct), END)
    new = offsets + np.arange(len(offsets))
    out = np.full(new[-1], len(hashed) - 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out[np.arange(len(codes)) + text] = codes
    return out, hashed, new


def before(codes: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """The value before each token; ``start`` before the first of a text."""
    out = np.roll(codes, 1)
    out[offsets[:-1]] = start
    return out


def word_counts(batches):
    """``h, n`` of every word of each slice of text."""
    for batch in batches:
        for part in slices(batch, "text", 2 * SLICE_BYTES):
            codes, hashed, _ = tokens(part.column("text"))
            n = np.bincount(codes, minlength=len(hashed))
            yield pa.RecordBatch.from_arrays([pa.array(hashed), pa.array(n)], names=["h", "n"])


def seeds_of(train: DataFrame) -> np.ndarray:
    """The most frequent words of all training texts, every one of them counted, and the end. Ties go to the smaller hash."""
    counts = cut(train.mapInArrow(word_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = min(MOST_SEEDS, max(SEEDS, int(total**0.5) // SEED_ROOT))
    seeds = counts.orderBy(F.col("n").desc(), "h").limit(size).toPandas().h.to_numpy(np.int64)
    return np.unique(np.append(seeds, END))


def seed_bigrams(seeds: np.ndarray):
    def run(batches):
        k = len(seeds)
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                codes, hashed, offsets = tokens(part.column("text"))
                at, known = look_up(seeds, hashed)
                seed = np.where(known, at, -1)[codes]
                ahead = before(seed, offsets, int(np.searchsorted(seeds, END)))
                both = (seed >= 0) & (ahead >= 0)
                pair, n = np.unique(ahead[both] * k + seed[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return run


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words 0 .. words-1 by exchange: each word in turn moves to the class that makes its bigrams likeliest.

    ``a, b, n``: bigram counts. Words start in classes by rank; ties go to the smaller class, so runs agree.
    """
    total = np.bincount(a, n, words) + np.bincount(b, n, words)
    order = np.argsort(-total, kind="stable")
    cls = np.empty(words, np.int64)
    cls[order] = np.arange(words) % classes
    right, left = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    right_cut, left_cut = np.searchsorted(a[right], np.arange(words + 1)), np.searchsorted(b[left], np.arange(words + 1))
    table = np.zeros((classes, classes))
    np.add.at(table, (cls[a], cls[b]), n)

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            r, l = right[right_cut[w] : right_cut[w + 1]], left[left_cut[w] : left_cut[w + 1]]
            own = n[r][b[r] == w].sum()
            after = np.bincount(cls[b[r]], n[r] * (b[r] != w), classes)
            ahead = np.bincount(cls[a[l]], n[l] * (a[l] != w), classes)
            c = cls[w]
            table[c] -= after
            table[:, c] -= ahead
            table[c, c] -= own
            gain = (f(table + after[None, :]) - f(table)).sum(1) + (f(table + ahead[:, None]) - f(table)).sum(0)
            d = np.diagonal(table)
            gain += f(d + after + ahead + own) - f(d + after) - f(d + ahead) + f(d)
            rows, columns = table.sum(1), table.sum(0)
            gain -= f(rows + after.sum() + own) - f(rows) + f(columns + ahead.sum() + own) - f(columns)
            new = int(gain.argmax()) if gain.max() > gain[c] + 1e-9 else c
            moved += new != c
            cls[w] = new
            table[new] += after
            table[:, new] += ahead
            table[new, new] += own
        if not moved:
            break
    return cls


def log_transitions(table: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log probabilities of each class after each class, backing off to the shares; the last row is the shares."""
    rows = (table + BACKOFF * share) / (table.sum(1, keepdims=True) + BACKOFF)
    return np.log(np.maximum(np.vstack([rows, share]), 1e-300))


def neighbour_counts(seeds: np.ndarray, cls: np.ndarray):
    """Per slice, ``h, x, n``: how often a word that is no seed has a neighbour of class x before it (x = NONE: no seed
    either) or of class x - NONE - 1 after it; at x = OWN, how often a seed occurs."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE_BYTES):
                codes, hashed, offsets = tokens(part.column("text"))
                at, known = look_up(seeds, hashed)
                own = np.where(known, cls[at], NONE)[codes]
                rare = own == NONE
                ahead, after = before(own, offsets, CLASSES), np.append(own[1:], CLASSES)
                behind = rare & (after != NONE)
                x = np.concatenate([codes[rare] * (OWN + 1) + ahead[rare], codes[behind] * (OWN + 1) + NONE + 1 + after[behind], codes[~rare] * (OWN + 1) + OWN])
                x, n = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashed[x // (OWN + 1)]), pa.array((x % (OWN + 1)).astype(np.int32)), pa.array(n)], names=["h", "x", "n"])

    return run


def best_classes(seeds: np.ndarray, cls: np.ndarray, log_t: np.ndarray):
    """``h, n, cls``: from all counts of a word, one after another, its count and best class."""
    m = CLASSES + 1
    logs = np.zeros((OWN + 1, CLASSES))
    logs[:m] = log_t[:m, :CLASSES]
    logs[NONE + 1 : NONE + 1 + m] = log_t[:CLASSES, :m].T

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3

        def done(h, x, n):
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
            counts = np.bincount(word * (OWN + 1) + x, n, len(starts) * (OWN + 1)).reshape(-1, OWN + 1)
            at, known = look_up(seeds, h[starts])
            best = np.where(known, cls[at], (counts @ logs).argmax(1))
            total = (counts[:, : NONE + 1].sum(1) + counts[:, OWN]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[starts]), pa.array(total), pa.array(best.astype(np.int32))], names=["h", "n", "cls"])

        for batch in batches:
            held = [np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, ("h", "x", "n"))]
            if len(held[0]):
                last = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
                yield done(*(c[:last] for c in held))
                held = [c[last:] for c in held]
        yield done(*held)

    return run


class Model:
    """What scoring needs besides the table of rarer words: class sizes, the most frequent words and, when learnt, transitions."""

    def __init__(self, size: np.ndarray, types: np.ndarray, head: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.n, self.v = float(size.sum()), float(types.sum())
        self.share = (size + 0.5) / (size + 0.5).sum()
        self.norm = size + 0.5 * (types + 1)
        order = np.argsort(head[0])
        self.head, self.head_n, self.head_class = (x[order] for x in head)

    def learn(self, table: np.ndarray) -> None:
        self.log_t = log_transitions(table, self.share)
        self.unknown = np.log(np.exp(self.log_t) @ (0.5 / self.norm))

    def code(self, texts: pa.Array, extra: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """Of each text its tokens, known tokens, base score, log emissions of known words, and a byte a token: the class
        (NONE: unknown). ``extra``: counts and classes of rarer words, sorted by hash."""
        codes, hashed, offsets = tokens(texts)
        count, cls = np.zeros(len(hashed)), np.full(len(hashed), NONE)
        for keys, n, c in ((self.head, self.head_n, self.head_class), extra):
            at, known = look_up(keys, hashed)
            if known.any():
                count[known], cls[known] = n[at[known]], c[at[known]]
        emission = np.where(cls == NONE, 0.0, np.log((count + 0.5) / self.norm[np.minimum(cls, CLASSES)]))
        base = np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))
        own = pa.py_buffer(cls.astype(np.uint8)[codes].tobytes())
        own = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), own])
        return pa.array(np.diff(offsets)), pa.array(sums(count[codes] > 0, offsets).astype(np.int64)), pa.array(sums(base[codes], offsets)), pa.array(sums(emission[codes], offsets)), own

    def score(self, classes: pa.Array, emission: np.ndarray) -> np.ndarray:
        """Log10 probability of each text from its classes and the log emissions of its known words."""
        own, context, offsets = sequences(classes)
        value = np.where(own == NONE, self.unknown[context], self.log_t[context, np.minimum(own, CLASSES)])
        return (sums(value, offsets) + emission) / np.log(10)


def sequences(classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and class before of each token, and where each text's tokens begin."""
    own, offsets = raw_bytes(classes)
    own = own.astype(np.int64)
    return own, before(own, offsets, CLASSES), offsets


def count_transitions(batches):
    """``pair, n`` of a whole piece: how often each class follows each, unknown words left out."""
    m = CLASSES + 1
    table = np.zeros(m * m, np.int64)
    for batch in batches:
        for part in slices(batch, "classes"):
            own, context, _ = sequences(part.column("classes"))
            both = (own != NONE) & (context != NONE)
            table += np.bincount(context[both] * m + own[both], minlength=m * m)
    pair = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(table[pair])], names=["pair", "n"])


def transitions(coded: DataFrame) -> np.ndarray:
    table = np.zeros((CLASSES + 1) ** 2)
    for r in coded.select("classes").mapInArrow(count_transitions, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most (CLASSES + 1)^2
        table[r.pair] = r.n
    return table.reshape(CLASSES + 1, CLASSES + 1)


def classed_words(train: DataFrame) -> tuple[Model, DataFrame]:
    """The classes of all words of ``train``: a model without transitions yet, and the table ``h, n, cls``.

    Null and empty texts are one end each. An empty table gives a model in which every word is unknown.
    """
    seeds = seeds_of(train)
    pairs = train.mapInArrow(seed_bigrams(seeds), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    a, b, n = pairs.pair.to_numpy(np.int64) // len(seeds), pairs.pair.to_numpy(np.int64) % len(seeds), pairs.n.to_numpy(float)
    cls = exchange(a, b, n, len(seeds), CLASSES)
    cls[np.searchsorted(seeds, END)] = CLASSES
    first = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(first, (cls[a], cls[b]), n)
    log_t = log_transitions(first, (first.sum(0) + 0.5) / (first.sum() + 0.5 * len(first)))

    counts = train.mapInArrow(neighbour_counts(seeds, cls), "h bigint, x int, n bigint").repartition("h").sortWithinPartitions("h")
    words = cut(counts.mapInArrow(best_classes(seeds, cls, log_t), "h bigint, n bigint, cls int"))
    size, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        size[r.cls], types[r.cls] = r.n, r.v
    head = words.where(F.col("n") > HEAD_SHARE * float(size.sum())).toPandas()
    return Model(size, types, tuple(head[c].to_numpy(np.int64) for c in ("h", "n", "cls"))), words


def coded_texts(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens, n_known, base_score, emission, classes`` in place of the text, one row for each.

    Documents are dealt by hash to groups of about GROUP_BYTES; a group asks the word table for its rarer words once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]
    groups = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))  # one number
    group = F.pmod(key_of(F.col("doc_id"), F.col("text")), F.lit(groups)).cast("int")
    dealt = docs.select(group.alias("g"), *kept, F.col("text").cast("string").alias("text"))

    def wanted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        hashed = np.unique(np.concatenate([tokens(texts.slice(i, 1024))[1] for i in range(0, len(texts), 1024)] or [np.zeros(0, np.int64)]))
        hashed = hashed[~look_up(shared.value.head, hashed)[1]]
        return pa.table([pa.array(np.full(len(hashed), key[0].as_py(), np.int32)), pa.array(hashed)], names=["g", "h"])

    def coded(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        extra = [known.column(c).to_numpy() for c in ("h", "n", "cls")]
        order = np.argsort(extra[0])
        extra = tuple(x[order] for x in extra)
        texts = table.column("text").combine_chunks()
        parts = [shared.value.code(texts.slice(i, 1024), extra) for i in range(0, len(texts), 1024)] or [shared.value.code(pa.array([], pa.string()), extra)]
        return pa.table([*[table.column(c) for c in kept], *[pa.chunked_array(list(x)) for x in zip(*parts)]], names=[*kept, *CODED])

    asked = dealt.groupBy("g").applyInArrow(wanted, "g int, h bigint").join(words, "h")
    schema = dealt.select(*kept).schema.simpleString()[7:-1] + ", n_tokens bigint, n_known bigint, base_score double, emission double, classes binary"
    return dealt.groupBy("g").cogroup(asked.select("g", "h", "n", "cls").groupBy("g")).applyInArrow(coded, schema)


def scored(coded: DataFrame, model: Model) -> DataFrame:
    """``coded`` with ``score`` in place of the classes and emissions."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in coded.columns if c not in ("emission", "classes")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "classes"):
                score = shared.value.score(part.column("classes"), part.column("emission").to_numpy())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(score)], names=[*kept, "score"])

    return coded.mapInArrow(run, coded.select(*kept).schema.simpleString()[7:-1] + ", score double")


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of ``train`` and the table of all its words: ``h, n, cls``."""
    model, words = classed_words(train)
    model.learn(transitions(coded_texts(train.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), model, words)))
    return model, words


def score_texts(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each row of ``docs``; null and empty texts are one end each."""
    return scored(coded_texts(docs.select("doc_id", "text"), model, words), model)


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; the texts become classes once, for learning the transitions and for scoring."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 1
    model, words = classed_words(docs.where(~held).select("text"))
    coded = stored(coded_texts(docs, model, words))
    model.learn(transitions(coded.where(~held)))
    return scored(coded, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n)).cast("bigint").alias("train_tokens"), "base_score", "score")
