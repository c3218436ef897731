"""Super-k-mers: runs of consecutive windows of a text that share their minimiser, and the Spark jobs over them.

A window is ``window`` consecutive units (bytes or words) of one text. Its minimiser is its leftmost unit gram of
least hash, so equal windows have equal minimisers, and a run of windows that share one travels as one string.
A run is known by two 64-bit hashes: of its minimiser (``anchor``) and of its whole string (``seg``). Equal runs are
counted before the shuffle; only runs whose anchor has several strings have to be looked at window by window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash64, key_of, mix, raw_bytes, slices, split_words, stored, word_codes

FLOOR, HOT = 1_000, 256  # keys of more rows than this, the most frequent ones, are dealt over several tasks
PIECE = 1 << 20  # units worked on at once; positions fit in 20 bits
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
RUNS = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("did", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("b", pa.int32()), ("len", pa.int32())])


@lru_cache(2)
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    def chain(x: int) -> np.ndarray:
        out = np.full(PIECE + 1, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return chain(base), chain(pow(base, -1, 1 << 64))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of value * base^position, modulo 2^64, before each position."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base)[0][: len(values)])])


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(base)[1][begin] + (end - begin).astype(np.uint64))


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbouring keys, by running minima of blocks from both sides."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs_of(values: np.ndarray, ends: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """``begin, windows, anchor, seg`` of all runs. ``ends``: for each unit, where its text ends."""
    out = []
    for a in range(0, max(len(values) - window + 1, 0), PIECE - window + 1):
        v = values[a : a + PIECE]
        starts = np.arange(len(v) - window + 1)
        sums = prefix(v, BASES[0])
        at = np.arange(len(v) - gram + 1)
        hashed = span_hash(sums, at, at + gram, BASES[0])
        least = window_minima((hashed >> np.uint64(20) << np.uint64(20)) | at.astype(np.uint64), window - gram + 1)
        place = (least & np.uint64(PIECE - 1)).astype(np.int64)
        starts = starts[starts + a + window <= ends[a : a + len(starts)]]
        if not len(starts):
            continue
        place = place[starts]
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        begin, count = starts[new], np.diff([*new, len(starts)])
        sums = prefix(v, BASES[1])
        seg = span_hash(sums, begin, begin + count + window - 1, BASES[1])
        out.append((begin + a, count, hashed[place[new]].view(np.int64), seg.view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


@dataclass(frozen=True)
class Units:
    """Bytes or words of a text, and the size of windows and minimiser grams in them."""

    words: bool
    window: int
    gram: int

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit values of all texts, offsets of the texts in units, and where each unit begins and ends in bytes."""
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
        raw, at = raw_bytes(texts)
        if self.words and pa.types.is_binary(texts.type):
            texts = texts.cast(pa.string(), safe=False)
        if not self.words:
            here = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
            return raw.astype(np.uint64) + np.uint64(1), at, here, here + 1
        flat, offsets = split_words(texts)
        values = np.zeros(0, np.uint64)
        if len(flat):
            codes, distinct = word_codes(flat)
            values = hash64(distinct).view(np.uint64)[codes]
        begins, ends = word_places(raw, at)
        shift = np.repeat(at[:-1], np.diff(offsets))
        return values, offsets, begins - shift, ends - shift

    def runs(self, part: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets, first, last = self.of(part.column("text"))
        ends = np.repeat(offsets[1:], np.diff(offsets))
        begin, count, anchor, seg = runs_of(values, ends, self.window, self.gram)
        row = np.searchsorted(offsets, begin, "right") - 1
        b = first[begin]
        base = part.column("base").to_numpy()[row] if "base" in part.schema.names else 0
        columns = [anchor, seg, part.column("did").to_numpy()[row], part.column("rid").to_numpy()[row], begin - offsets[row] + base, count, b, last[begin + count + self.window - 2] - b]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS)], schema=RUNS)


def word_places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of texts that begin at ``at``."""
    solid = ~SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    before = np.concatenate([[False], solid[:-1]])
    begins = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.concatenate([solid[1:], [False]])
    return begins, np.flatnonzero(solid & (~after | border[1:])) + 1


def identified(docs: DataFrame) -> DataFrame:
    """``did, rid, text``: a missing id counts as the smallest; rows of equal id and text share ``rid``."""
    did = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(did.alias("did"), key_of(F.col("doc_id"), F.col("text")).alias("rid"), F.col("text").cast("string").alias("text"))


def most_frequent(counts: DataFrame, key: str, times: str) -> list[int]:
    """The keys of more than ``FLOOR`` rows, ``HOT`` of them at most: any other key holds less than one row in ``HOT``."""
    top = counts.where(F.col(times) > FLOOR).orderBy(F.desc(times), key).limit(HOT)
    return [row[0] for row in top.select(key).collect()]


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: list[int], by: list[str]) -> DataFrame:
    """Inner join of many rows with one fact per key. Rows whose first key is ``hot`` are dealt by ``by`` over as many parts as
    a shuffle has, and the facts of these keys are repeated for each part; so no key needs one task for all its rows."""
    if not hot:
        return rows.join(facts, keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_hot, zero = F.col(keys[0]).isin(hot), F.lit(0).cast("bigint")
    rows = rows.withColumn("salt", F.when(of_hot, F.pmod(F.xxhash64(*by), F.lit(parts))).otherwise(zero))
    every = F.sequence(zero, F.lit(parts - 1).cast("bigint"))
    facts = facts.withColumn("salt", F.explode(F.when(of_hot, every).otherwise(F.array(zero))))
    return rows.join(facts, [*keys, "salt"]).drop("salt")


def covered(docs: DataFrame, units: Units, first_stays: bool, solve: Callable, largest: int, keep_runs: bool) -> DataFrame:
    """``did, rid, cover``: for each row with repeated windows, arrays of covered runs of units [start, end).

    ``docs`` comes from ``identified``. ``first_stays``: the first of equal windows, by (did, start), is not covered.
    ``solve`` gets the strings of anchors with up to ``largest`` different strings, grouped by anchor, and gives
    ``anchor, seg, begins, ends``. Strings of larger groups are cut again by minimisers of longer grams (``finer``), so that
    no group has to fit into a task. ``keep_runs`` writes all runs once instead of finding them twice.
    """

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                yield units.runs(part)

    schema = "anchor bigint, seg bigint, did bigint, rid bigint, start int, n int, b int, len int"
    runs = docs.mapInArrow(emit, schema)
    if keep_runs:
        runs = cut(runs)
    write = cut if keep_runs else stored  # runs of words are many: compressed, they take less of the disk
    # Most runs stand alone: they leave before anything but their anchor is counted.
    repeated = cut(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    hot = most_frequent(repeated, "anchor", "times")
    runs = write(spread_join(runs, repeated.select("anchor"), ["anchor"], hot, ["did", "rid", "start"]))
    place = F.struct("did", "start", "rid", "b", "len", "n")
    kinds = write(runs.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")))
    several = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1"))

    # The strings of anchors with several of them, cut from the first text that has them.
    need = spread_join(kinds, several, ["anchor"], hot, ["seg"]).select("anchor", "seg", "strings", "first.*")
    text = F.substring(F.col("text").cast("binary"), F.col("b") + 1, F.col("len"))
    packed = stored(need.join(docs, ["did", "rid"]).select("anchor", "seg", "strings", "did", "start", text.alias("packed")))
    small = packed.where(F.col("strings") <= largest).select("anchor", "seg", "did", "start", "packed")
    solved = small.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(in_groups(solve), "anchor bigint, seg bigint, begins array<int>, ends array<int>")
    if not several.where(F.col("strings") > largest).isEmpty():
        large = packed.where(F.col("strings") > largest)
        solved = solved.unionByName(finer(large, units, first_stays, solve, largest))

    whole = (F.array(F.lit(0)), F.array(F.col("first.n") + (units.window - 1)))
    known = kinds.join(solved, ["anchor", "seg"], "left")
    known = known.select("seg", "anchor", "copies", F.col("first.did").alias("fdid"), F.col("first.start").alias("fstart"), F.coalesce("begins", F.array().cast("array<int>")).alias("begins"), F.coalesce("ends", F.array().cast("array<int>")).alias("ends"), whole[1].alias("all"))
    again = (F.col("did") != F.col("fdid")) | (F.col("start") != F.col("fstart")) if first_stays else F.col("copies") > 1
    copied = most_frequent(kinds, "seg", "copies")
    hits = spread_join(runs.select("anchor", "seg", "did", "rid", "start"), known, ["seg", "anchor"], copied, ["did", "rid", "start"])
    begins, ends = F.when(again, whole[0]).otherwise(F.col("begins")), F.when(again, F.col("all")).otherwise(F.col("ends"))
    shifted = lambda x: F.transform(x, lambda v: v + F.col("start"))
    hits = hits.select("did", "rid", F.arrays_zip(shifted(begins).alias("s"), shifted(ends).alias("e")).alias("spans")).where(F.size("spans") > 0)
    # Equal rows have equal spans: a set keeps one of them, before the shuffle as well as after it.
    return hits.groupBy("did", "rid").agg(F.flatten(F.collect_set("spans")).alias("cover"))


def finer(packed: DataFrame, units: Units, first_stays: bool, solve: Callable, largest: int) -> DataFrame:
    """The same answer for groups of any size. Their strings are texts of their own: they are cut by grams that are longer by a
    third of the window, whose minimisers tell apart what has only a common passage in it, and solved like other texts.
    Where a gram can't grow any more, windows are counted one by one (``by_window``)."""
    longer = units.gram + max(units.window // 3, 1)
    if longer >= units.window:
        return by_window(packed, units, first_stays)
    texts = packed.dropDuplicates(["anchor", "seg"]).select("anchor", "seg", "did", F.xxhash64("anchor", "seg").alias("rid"), F.col("start").alias("base"), F.col("packed").alias("text"))
    texts = stored(texts)
    found = covered(texts.select("did", "rid", "base", "text"), Units(units.words, units.window, longer), first_stays, solve, largest, keep_runs=False)
    at = lambda end: F.transform("cover", lambda x: x[end] - F.col("base"))
    return texts.drop("text").join(found, ["did", "rid"]).select("anchor", "seg", at("s").alias("begins"), at("e").alias("ends"))


def in_groups(solve: Callable, limit: int = 1 << 19):
    """Feed ``solve`` with tables of whole groups of one anchor, about ``limit`` bytes at a time. Of several rows with one
    string, which come one after another, it gets the first: equal documents give as many."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        last = None

        def flush(table: pa.Table):
            if table.num_rows:
                yield from solve(table).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch, "packed", limit):
                key = np.stack([part.column("anchor").to_numpy(), part.column("seg").to_numpy()], 1)
                new = np.append([last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(1))
                last = key[-1]
                if not new.all():
                    part = part.filter(pa.array(new))
                held.append(part)
                size += part.column("packed").nbytes
                if size >= limit:
                    table = pa.Table.from_batches(held)
                    anchors = table.column("anchor").to_numpy()
                    border = int(np.searchsorted(anchors, anchors[-1]))
                    if border:
                        yield from flush(table.slice(0, border))
                        held = table.slice(border).combine_chunks().to_batches()
                        size = sum(b.column("packed").nbytes for b in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def by_window(packed: DataFrame, units: Units, first_stays: bool) -> DataFrame:
    """Every window as a row with a 128-bit hash, counted by Spark: for groups that no minimiser takes apart."""

    def emit(batches):
        names = ["anchor", "seg", "did", "at", "off", "h1", "h2"]
        for batch in batches:
            for part in slices(batch, "packed", 1 << 18):
                values, offsets, _, _ = units.of(part.column("packed").cast(pa.string(), safe=False) if units.words else part.column("packed"))
                sizes = np.diff(offsets) - units.window + 1
                row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
                off = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
                at = offsets[row] + off
                h = [span_hash(prefix(values, b), at, at + units.window, b).view(np.int64) for b in BASES]
                column = lambda c: part.column(c).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (column("anchor"), column("seg"), column("did"), column("start") + off.astype(np.int32), off.astype(np.int32), *h)], names=names)

    rows = packed.select("anchor", "seg", "did", "start", "packed").dropDuplicates(["anchor", "seg"])
    windows = rows.mapInArrow(emit, "anchor bigint, seg bigint, did bigint, at int, off int, h1 bigint, h2 bigint")
    counted = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("did", "at")).alias("first")).where("times > 1")
    hit = windows.join(counted, ["h1", "h2"])
    if first_stays:
        hit = hit.where("did <> first.did or at <> first.at")
    found = hit.groupBy("anchor", "seg").agg(F.sort_array(F.collect_list("off")).alias("begins"))
    return found.select("anchor", "seg", "begins", F.transform("begins", lambda x: x + units.window).alias("ends"))


def marked(n: int, spans: list | None) -> np.ndarray:
    """Which of n units are covered."""
    depth = np.zeros(n + 1, np.int32)
    if spans:
        s, e = np.array([(x["s"], x["e"]) for x in spans], np.int64).T
        np.add.at(depth, s, 1)
        np.add.at(depth, e, -1)
    return np.cumsum(depth)[:n] > 0


def doubled(ranks: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks of strings twice as long: by the rank here, then by the rank ``shift`` units on."""
    after = np.zeros(len(ranks), np.int64)
    after[: len(ranks) - shift] = ranks[shift:] + 1
    return dense(ranks * (ranks.max(initial=0) + 2) + after)


def dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    sorted_keys = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.diff(sorted_keys, prepend=sorted_keys[:1]) != 0)
    return out


def cover_table(table: pa.Table, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Table:
    """``anchor, seg, begins, ends`` for the rows of ``table`` that have covered runs (sorted by row)."""
    n = table.num_rows
    cuts = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (begins, ends)]
    out = pa.table([table.column("anchor"), table.column("seg"), *lists], names=["anchor", "seg", "begins", "ends"])
    return out.filter(pa.array(np.diff(cuts.to_numpy()) > 0))
