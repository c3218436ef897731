"""Suffix-array de-duplication of long byte strings.

Texts are cut into super-k-mers of 400-byte windows, and runs that share a minimiser meet in one task. There all of
them together get an enhanced suffix array: suffixes sorted by ranks of doubling length, and the common prefixes of
neighbours read off the same ranks. A stack scan over the prefixes builds the tree of common-prefix intervals; an
interval whose occurrences are not all preceded by the same byte is a maximal repeat, and covers all occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import flat_array, raw_bytes, read, slices
from .superkmers import Units, cover_table, covered, doubled, dense, identified, marked
from .wordrepeats import identified_column

WINDOW, GRAM, LARGEST = 400, 128, 4_000


def suffix_array(text: np.ndarray, starts: np.ndarray, rest: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``starts`` and the common prefix of each with the one before it (0 for the first).

    ``text``: symbols, 0 between strings; ``rest``: length from each start to the end of its string.
    """
    symbols = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    packed = symbols[:-4] << 27 | symbols[1:-3] << 18 | symbols[2:-2] << 9 | symbols[3:-1]
    ranks = dense(packed)
    levels, length = [(1, symbols[:-4].astype(np.int32)), (2, (packed >> 18).astype(np.int32)), (4, ranks.astype(np.int32))], 4
    del symbols, packed
    while length < longest:
        ranks = doubled(ranks, length)
        length *= 2
        levels.append((length, ranks.astype(np.int32)))
    order = np.argsort(ranks[starts], kind="stable")
    sorted_starts = starts[order]
    common = np.zeros(len(starts), np.int64)
    a, b = sorted_starts[:-1], sorted_starts[1:]
    shared = np.zeros(len(a), np.int64)
    for size, ranks in reversed(levels):
        inside = np.maximum(a, b) + shared + size <= len(text)
        at = np.where(inside, shared, 0)
        shared += np.where(inside & (ranks[a + at] == ranks[b + at]), size, 0)
    common[1:] = np.minimum(shared, np.minimum(rest[order][:-1], rest[order][1:]))
    return order, common


def maximal_repeats(common: np.ndarray, before: np.ndarray, least: int):
    """``(length, first, last)`` of every common-prefix interval of at least ``least`` whose left symbols differ.

    ``before``: the symbol left of each sorted suffix, 0 at the beginning of a string (differs from all).
    """
    differs = np.zeros(len(common), bool)
    differs[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    joined = common >= least
    run = np.cumsum(~joined)  # suffixes of one run share ``least`` symbols
    telling = np.bincount(run[joined & differs], minlength=run[-1] + 1)[run] > 0
    for head in np.flatnonzero(telling & ~joined):
        end = head + 1
        stack: list[list] = []  # [length, first, differs]
        while True:
            inside = end < len(common) and joined[end]
            length = int(common[end]) if inside else 0
            first, odd = end - 1, False
            while stack and stack[-1][0] > length:
                top = stack.pop()
                top[2] |= odd
                if top[2]:
                    yield top[0], top[1], end - 1
                first, odd = top[1], top[2]
            if not inside:
                break
            if stack and stack[-1][0] == length:
                stack[-1][2] |= odd | bool(differs[end])
            else:
                stack.append([length, first, odd | bool(differs[end])])
            end += 1


def solver(window: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = flat_array(table.column("packed"))
        raw, at = raw_bytes(packed)
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        text = np.zeros(len(raw) + len(size), np.int64)
        text[np.arange(len(raw)) + row] = raw.astype(np.int64) + 1
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        owner = np.repeat(np.arange(len(size)), np.maximum(size - window + 1, 0))
        starts = np.flatnonzero(np.arange(len(text)) + window <= np.repeat(ends, size + 1))
        order, common = suffix_array(text, starts, ends[owner] - starts, int(size.max()))
        owner, starts = owner[order], starts[order]
        before = np.where(starts == begins[owner], 0, text[starts - 1])
        reach = np.zeros(len(starts), np.int64)
        for length, first, last in maximal_repeats(common, before, window):
            np.maximum(reach[first : last + 1], length, out=reach[first : last + 1])
        hit = np.flatnonzero(reach)
        hit = hit[np.argsort(owner[hit], kind="stable")]
        begin = starts[hit] - begins[owner[hit]]
        return cover_table(table, owner[hit], begin, begin + reach[hit])

    return solve


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """``did, rid, cover``: the bytes of each row that lie in a string of ``window`` bytes which also starts elsewhere.

    All occurrences are covered, also such that overlap and such within one text; repeated rows count as elsewhere.
    Null and empty texts have no strings.
    """
    return covered(identified(docs), Units(False, window, gram), False, solver(window), largest, keep_runs=True)


def kept_bytes(rows: DataFrame, cover: DataFrame, result, schema: str) -> DataFrame:
    """``doc_id`` and ``result(bytes, removed)`` of each text; null texts have no bytes, rows without spans lose none, repeated rows
    each get their own result."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
                out = [result(t, marked(len(t), s)) for t, s in zip(texts, part.column("cover").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(list(x)) for x in zip(*out)]], names=["doc_id", *[x.split()[0] for x in schema.split(", ")]])

    joined = rows.join(cover, ["did", "rid"], "left").select("doc_id", "text", "cover")
    return joined.mapInArrow(run, f"{rows.select('doc_id').schema.simpleString()[7:-1]}, {schema}")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: null and empty texts have no bytes and nothing removed; equal rows are documents of their own, which
    remove each other; a missing id is a value like others."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", *[identified_column(docs, c) for c in ("did", "rid", "text")])

    def result(text, gone):
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
        return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    return kept_bytes(rows, repeated_bytes(docs), result, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
