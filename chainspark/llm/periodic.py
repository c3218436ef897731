"""Runs of words that repeat with a period, by longest common extensions over a difference cover.

A run of period p holds a point of the grid 0, p, 2p, ... whose word stands again p words on, and reaches from there as
far as the extensions of both places agree, forwards and backwards. So all grids together, n/1 + n/2 + ... points, find
all runs. Extensions are worked out for all texts of a slice at once: two places are compared word by word until both
stand on the cover, 64 words at most; most pairs differ before that. Only texts in which a pair comes so far get the
full structure: suffixes that begin on the cover are sorted, by 64 words and then by doubling, and a sparse table of
minima over the common prefixes of neighbours answers the rest of every extension at once.

Everything is row by row: no shuffle, and a task holds one slice of texts, or one text if that is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, slices, split_words, word_codes

LEAST = 12  # words of the shortest run
STEP, SIDE = 64, 8
#: Each difference modulo STEP is one of two residues of the cover: a multiple of SIDE less a number below SIDE.
COVER = np.unique([*range(SIDE), *range(0, STEP, SIDE)])
CHUNK = 1 << 20  # pairs worked on at once
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _shifts() -> np.ndarray:
    """How many words on two places, by their residues, both stand on the cover."""
    on = np.isin(np.arange(STEP), COVER)
    out = np.full((STEP, STEP), STEP)
    for k in range(STEP - 1, -1, -1):
        here = np.roll(on, -k)
        out[here[:, None] & here[None, :]] = k
    return out


SHIFTS = _shifts()


def padded(words: np.ndarray) -> np.ndarray:
    return np.concatenate([words, np.zeros(2 * STEP, words.dtype)])


class Suffixes:
    """Common prefixes of any two suffixes of ``words`` that begin on the cover. Values are positive; the last is unique."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        counts = (n - COVER + STEP - 1) // STEP
        self.base = np.zeros(STEP, np.int64)
        self.base[COVER] = np.cumsum(counts) - counts
        at = np.concatenate([np.arange(c, n, STEP) for c in COVER])
        left = np.concatenate([np.arange(c, 0, -1) for c in counts])  # samples of the same residue from here on
        words = padded(words)
        ranks = [_block_ranks(words, at)]
        while (top := ranks[-1].max()) + 1 < len(at):
            jump = 1 << (len(ranks) - 1)
            after = np.zeros(len(at), np.int64)
            more = np.flatnonzero(left > jump)
            after[more] = ranks[-1][more + jump] + 1
            ranks.append(_dense(ranks[-1] * (top + 2) + after))
        self.place = ranks[-1]
        order = np.empty(len(at), np.int64)
        order[self.place] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        inside = np.ones(len(a), bool)
        length = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 2, -1, -1):  # neighbours differ at the last level
            jump = 1 << level
            same = np.flatnonzero(inside)
            same = same[ranks[level][a[same]] == ranks[level][b[same]]]
            length[same] += STEP * jump
            inside[same] = (left[a[same]] > jump) & (left[b[same]] > jump)
            go = same[inside[same]]
            a[go] += jump
            b[go] += jump
        go = np.flatnonzero(inside)
        for k in range(STEP):
            go = go[words[at[a[go]] + k] == words[at[b[go]] + k]]
            if not len(go):
                break
            length[go] += 1
        self.table = [length.astype(np.int32)]
        while (width := 1 << len(self.table)) <= len(length):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(length) - width + 1], last[width // 2 :]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = (self.place[self.base[k % STEP] + k // STEP] for k in (i, j))
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(y - x)[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][x[at]], self.table[k][y[at] - (1 << k)])
        return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


def _block_ranks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense ranks of the STEP words from each place on: as many words as fit go into one number, and the numbers are
    sorted by from last to first."""
    bits = max(int(words.max()).bit_length(), 1)
    per = 62 // bits

    def key(start: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(start, min(start + per, STEP)):
            out = (out << bits) | words[at + k]
        return out

    order = np.arange(len(at))
    for start in reversed(range(0, STEP, per)):
        order = order[np.argsort(key(start)[order], kind="stable")]
    new = np.zeros(len(at), bool)
    for start in range(0, STEP, per):
        own = key(start)[order]
        new[1:] |= own[1:] != own[:-1]
    ranks = np.empty(len(at), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def extended(words: np.ndarray, i: np.ndarray, j: np.ndarray, deep: Suffixes | None) -> tuple[np.ndarray, np.ndarray]:
    """How far the words from i and from j on agree, and which pairs would have needed ``deep`` where there is none."""
    steps = SHIFTS[i % STEP, j % STEP]
    out, lost = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    live, t = np.arange(len(i)), 0
    while len(live):
        met = steps[live] == t
        at = live[met]
        if deep is None:
            lost[at] = True
        elif len(at):
            out[at] = t + deep.common(i[at] + t, j[at] + t)
        live = live[~met]
        same = words[i[live] + t] == words[j[live] + t]
        out[live[~same]] = t
        live, t = live[same], t + 1
    return out, lost


def grid(sizes: np.ndarray):
    """``text, period, place`` of all points of all grids, CHUNK at a time."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (sizes[text] - 1) // period
    total = np.cumsum(points)
    at = 0
    while at < len(text):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + CHUNK, "right")), at + 1)
        n = points[at:to]
        k = np.arange(total[to - 1] - done) - np.repeat(total[at:to] - n - done, n)
        own = np.repeat(np.arange(at, to), n)
        yield text[own], period[own], k * period[own]
        at = to


def unique_runs(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Each stretch (text, start, end) once, with its smallest period; by text, start, period."""
    text, start, end, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((period, end, start, text))
    text, start, end, period = (x[order] for x in (text, start, end, period))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)
    order = np.flatnonzero(new)
    order = order[np.lexsort((period[order], start[order], text[order]))]
    return text[order], start[order], end[order], period[order]


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """``text, start, end, period`` of all runs of all texts; ``codes`` are numbers of words, from 0."""
    sizes = np.diff(offsets)
    texts = np.flatnonzero(sizes >= least)
    light, heavy = _search(codes, offsets, texts, least, False)
    if not len(heavy):
        return unique_runs([light])
    deep, _ = _search(codes, offsets, heavy, least, True)
    keep = ~np.isin(light[0], heavy)
    return unique_runs([tuple(x[keep] for x in light), deep])


def _search(codes: np.ndarray, offsets: np.ndarray, texts: np.ndarray, least: int, build: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Runs of the chosen texts; without ``build``, also the texts that need the structure, whose runs may lack."""
    sizes = offsets[texts + 1] - offsets[texts]
    begins = np.cumsum(sizes + 1) - sizes  # a border of its own before and after each text
    words = np.empty(int((sizes + 1).sum()) + 1, np.int64)
    inside = np.ones(len(words), bool)
    inside[np.append(begins - 1, len(words) - 1)] = False
    words[~inside] = np.arange(1, len(texts) + 2)
    own = np.repeat(offsets[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    words[inside] = codes[own] + len(texts) + 2
    n = len(words)
    forward, backward = padded(words), padded(words[::-1])
    deep = (Suffixes(words), Suffixes(words[::-1])) if build and len(texts) else (None, None)
    heavy = np.zeros(len(texts), bool)
    longest = np.zeros((3, len(texts)), np.int64)  # of each text so far: where it starts and ends, and its period
    longest[2] = 1
    found = []
    for text, period, place in grid(sizes):
        i = begins[text] + place
        # A pair inside a run whose period divides its own would find this run again.
        start, end, q = longest[:, text]
        same = np.flatnonzero((forward[i] == forward[i + period]) & ~heavy[text] & ~((start <= place) & (place + period < end) & (period % q == 0)))
        text, period, i = text[same], period[same], i[same]
        ahead, lost = extended(forward, i, i + period, deep[0])
        heavy[text[lost]] = True
        need = np.maximum(period, least - period)
        fits = ~lost & (ahead + i - begins[text] >= need)
        text, period, i, ahead, need = (x[fits] for x in (text, period, i, ahead, need))
        behind, lost = extended(backward, n - i, n - i - period, deep[1])
        heavy[text[lost]] = True
        fits = ~lost & (ahead + behind >= need)
        text, period, i, ahead, behind = (x[fits] for x in (text, period, i, ahead, behind))
        start = i - behind - begins[text]
        found.append(unique_runs([(text, start, start + behind + period + ahead, period)]))
        text, start, end, period = found[-1]
        size = end - start
        order = np.lexsort((-period, size))
        longer = order[size[order] > (longest[1] - longest[0])[text[order]]]
        longest[:, text[longer]] = start[longer], end[longer], period[longer]
    text, start, end, period = unique_runs(found)
    return (texts[text], start, end, period), texts[heavy]


def search(part: pa.RecordBatch, least: int) -> list[pa.Array]:
    flat, offsets = split_words(part.column("text"))
    codes = word_codes(flat)[0] if len(flat) else np.zeros(0, np.int64)
    text, start, end, period = runs_of(codes, offsets, least)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, offsets[text] + start + period, 1)
    np.add.at(depth, offsets[text] + end, -1)
    keep = np.cumsum(depth)[: len(flat)] == 0
    left = np.append(0, np.cumsum(keep))[offsets]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep, pa.bool_())) if len(flat) else pa.array([], pa.string()))
    structs = pa.StructArray.from_arrays([pa.array(start), pa.array(end - start), pa.array(period)], fields=list(RUN))
    cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
    return [pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs), pc.binary_join(kept, " ").cast(pa.string())]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (``start, length, period`` in words, by start and period) and ``collapsed``, the
    text without what repeats: of each run its first period stays, and words are joined by one space.

    A run is as long as it can be, has its smallest period q, and at least max(``least``, 2 q) words. Columns of these
    names are replaced. Null and empty texts have no words and no runs; rows are looked at one by one, so repeats agree.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *search(part, least)], names=[*kept, "n_words", "runs", "collapsed"])

    return docs.select(*kept).mapInArrow(run, schema + OUT)


def with_periods(text: Column, doc_id: Column) -> Column:
    """The texts of one id in ten (by crc32) with a period put into them: from a word on, the words from there repeat."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & text.rlike(WORD), changed).otherwise(text)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, one id in ten with a period put in. A null text has no words; without runs there is no longest one."""
    docs = read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
