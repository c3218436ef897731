"""Substring de-duplication by super-k-mer partitioning over words.

Consecutive windows of 20 words that share a minimiser travel as one packed string to their bucket; there the words
become numbers, ranks of doubling length sort all windows of the bucket, and equal ranks count windows exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_array, raw_bytes, read, slices, word_codes
from .superkmers import Units, cover_table, covered, doubled, identified, marked, word_places

WINDOW, GRAM, LARGEST = 20, 6, 20_000


def solver(window: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = flat_array(table.column("packed"))
        raw, at = raw_bytes(packed)
        begins, ends = word_places(raw, at)
        # The words of all strings: bytes between their places, gathered without a loop.
        keep = np.zeros(len(raw) + 1, np.int32)
        np.add.at(keep, begins, 1)
        np.add.at(keep, ends, -1)
        solid = raw[np.cumsum(keep)[:-1] > 0]
        cuts = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(solid.tobytes())])
        codes, _ = word_codes(words)
        offsets = np.searchsorted(begins, at)
        row = np.repeat(np.arange(len(packed)), np.diff(offsets))
        # A string's end is a word of its own, so no run of words goes on into the next string.
        ranks = np.concatenate([codes, [-1]]) + 1
        length = 1
        while length * 2 <= window:
            ranks = doubled(ranks, length)
            length *= 2
        if length < window:
            ranks = doubled(ranks, window - length)
        starts = np.flatnonzero(np.arange(len(codes)) + window <= offsets[1:][row])
        rank, owner = ranks[starts], row[starts]
        did, first = table.column("did").to_numpy()[owner], table.column("start").to_numpy()[owner] + starts - offsets[owner]
        order = np.lexsort((first, did, rank))
        head = np.flatnonzero(np.diff(rank[order], prepend=-1))
        lead = np.repeat(order[head], np.diff([*head, len(order)]))
        late = order[(did[order] != did[lead]) | (first[order] != first[lead])]
        late = np.sort(starts[late])
        begin = late - offsets[row[late]]
        return cover_table(table, row[late], begin, begin + window)

    return solve


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """``did, rid, cover`` of rows that have words covered by a window which starts earlier as well.

    Earlier means a smaller id (missing: smallest), or the same id and a smaller start; so rows with equal id and
    equal text don't count against each other. Null and empty texts have no windows.
    """
    return covered(identified(docs), Units(True, window, gram), True, solver(window), largest, keep_runs=False)


def kept_words(docs: DataFrame, cover: DataFrame, result, schema: str) -> DataFrame:
    """``docs`` (with did, rid, text and more) with ``result(text, words, removed)`` of each text in place of the text. Null texts
    have no words; repeated rows each get their own result; columns named like a result must not be among ``docs``
    (``without_repeats`` packs them away)."""
    joined = docs.join(cover, ["did", "rid"], "left")
    kept = [c for c in docs.columns if c not in ("did", "rid", "text")]
    extra = [x.split()[0] for x in schema.split(", ")]
    names = docs.select(*kept).schema.simpleString()[7:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("cover").to_pylist()):
                    words = (text or b"").split()
                    out.append(result(text, words, marked(len(words), spans)))
                columns = [pa.array(list(x), pa.binary()).cast(pa.string()) if n == "text" else pa.array(list(x)) for n, x in zip(extra, zip(*out))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns], names=[*kept, *extra])

    return joined.select(*kept, "text", "cover").mapInArrow(run, ", ".join(x for x in (names, schema) if x))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text; rows without repeats keep their text unchanged."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("r")
    rows = docs.select(rest, *[identified_column(docs, c) for c in ("did", "rid", "text")])

    def result(text, words, gone):
        return ((b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else text),)

    out = kept_words(rows, repeated_words(docs, **options), result, "text string")
    return out.select(*[F.col("text") if c == "text" else F.col("r").getField(c).alias(c) for c in docs.columns])


def identified_column(docs: DataFrame, name: str):
    from .common import key_of

    did = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(1 << 63)))
    return {"did": did, "rid": key_of(docs["doc_id"], docs["text"]), "text": docs["text"].cast("string")}[name].alias(name)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: null and empty texts have no words; rows of equal id and text are one document, a missing id is the
    smallest, so its windows come first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", *[identified_column(docs, c) for c in ("did", "rid", "text")])

    def result(_, words, gone):
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()

    return kept_words(rows, repeated_words(docs), result, "n_words bigint, n_removed bigint, kept_sha256 string")
