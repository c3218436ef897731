"""Fill-in-the-middle by piece tables.

A text is never moved while it is rearranged. It is one descriptor ``(buffer, begin, end)`` over an immutable buffer of
text; two cuts split it in three, descriptors over a second buffer hold the sentinels, and a form of output is a
permutation of these six. The output is written, and hashed, by streaming over the descriptors. The way back finds the
sentinels in an output, which gives its descriptors, and applies the inverse permutation.

Everything is row by row: no shuffle, and a task holds one slice of texts, or one text if that is longer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import raw_bytes, read, slices

#: The buffer of sentinels, and where each stands in it.
SENTINELS = ("<P>", "<S>", "<M>")
MARKS = "".join(SENTINELS).encode()
TEXT, MARK = 0, 1
#: Descriptors in their first order: mark and prefix, mark and suffix, mark and middle. A form permutes them.
FORMS = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}
ORIGINAL = (1, 5, 3)  # prefix, middle, suffix
PIECE = pa.struct([("buffer", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
ARRANGED = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", pa.list_(PIECE)), ("output", pa.string()), ("output_sha256", pa.string())]
ARRANGED_SQL = "n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces array<struct<buffer: int, begin: bigint, end: bigint>>, output string, output_sha256 string"


def draws(ids: pa.Array, seed: int) -> np.ndarray:
    """Four unsigned numbers a row: the first 32-bit groups of the sha256 of ``seed:id``; a missing id is empty text."""
    texts = (f"{seed}:{'' if i is None else i}".encode() for i in ids.to_pylist())
    return np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), ">u4").reshape(-1, 8)[:, :4].astype(np.int64)


def split(raw: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` lines of each text, and where its three pieces begin and end: four byte positions a row."""
    ends = np.flatnonzero(raw == 10) + 1
    first = np.searchsorted(ends, at, "right")  # an end at a text's begin belongs to the text before
    lines = np.diff(first)
    last = np.append(ends, 0)[np.maximum(first[1:], 1) - 1]
    n = lines + ((np.diff(at) > 0) & ((lines == 0) | (last < at[1:])))

    def after(k: np.ndarray) -> np.ndarray:
        inside = np.append(ends, 0)[np.minimum(first[:-1] + np.maximum(k, 1) - 1, len(ends))]
        return np.where(k == 0, at[:-1], np.where(k > lines, at[1:], inside))

    cuts = np.sort(h[:, :2] % (n + 1)[:, None], 1)
    return n, np.stack([at[:-1], after(cuts[:, 0]), after(cuts[:, 1]), at[1:]], 1)


def descriptors(bounds: np.ndarray, form: str) -> list[tuple[int, int, int]]:
    """The descriptors of one text, cut at ``bounds``, in the order of ``form``."""
    a, b, c, d = bounds.tolist()
    if form == "plain":
        return [(TEXT, a, d)]
    first = [(MARK, 0, 3), (TEXT, a, b), (MARK, 3, 6), (TEXT, c, d), (MARK, 6, 9), (TEXT, b, c)]
    return [first[i] for i in FORMS[form]]


def found(output: bytes, form: str) -> list[tuple[int, int]]:
    """The descriptors of the original text in an output: its sentinels are looked up, then the permutation is undone."""
    if form == "plain":
        return [(0, len(output))]
    marks, at = [MARKS[3 * (i // 2) : 3 * (i // 2) + 3] for i in FORMS[form][::2]], 0
    begins = []
    for mark in marks:
        at = output.index(mark, at) + 3
        begins.append(at)
    ends = [begins[1] - 3, begins[2] - 3, len(output)]
    own = {}
    for place, begin, end in zip(FORMS[form][1::2], begins, ends):
        own[place] = (begin, end)
    return [own[i] for i in ORIGINAL]


def streamed(pieces: list, buffers: list[memoryview]) -> tuple[bytes, str]:
    """The bytes that descriptors stand for, and their sha256."""
    views = [buffers[k][a:b] for k, a, b in pieces]
    digest = hashlib.sha256()
    for view in views:
        digest.update(view)
    return b"".join(views), digest.hexdigest()


def arrange(part: pa.RecordBatch, seed: int, share: int, spm: int) -> list[pa.Array]:
    texts = pc.fill_null(part.column("text"), "")
    marked = np.zeros(len(texts), bool)
    for s in SENTINELS:
        marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    raw, at = raw_bytes(texts)
    h = draws(part.column("doc_id"), seed)
    n, bounds = split(raw, at, h)
    plain = marked | (np.diff(at) == 0) | (h[:, 2] % 100 >= share)
    forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[bounds]
    buffers = [memoryview(raw), memoryview(MARKS)]
    outputs, digests, pieces, cuts = [], [], [], [0]
    for form, own, begin in zip(forms.tolist(), bounds, at.tolist()):
        table = descriptors(own, form)
        output, digest = streamed(table, buffers)
        outputs.append(output)
        digests.append(digest)
        pieces += [(k, a - begin * (k == TEXT), b - begin * (k == TEXT)) for k, a, b in table]
        cuts.append(len(pieces))
    flat = np.array(pieces, np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1]), pa.array(flat[:, 2])], fields=list(PIECE))
    length = lambda i: pa.array(chars[:, i + 1] - chars[:, i], mask=plain)
    return [pa.array(n), pa.array(forms.tolist(), pa.string()), length(0), length(1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]


def rearranged(docs: DataFrame, seed: int = 7, share: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, pieces, output, output_sha256``; columns of these names are replaced.

    ``share`` in a hundred texts are rearranged, ``spm`` in a hundred of these with the suffix first; ``seed`` and
    ``doc_id`` decide, so reruns and repeated rows agree. ``pieces`` are byte ranges of the text (buffer 0) and of the
    sentinels (buffer 1). Texts that are null, empty or hold a sentinel stay as they are (``plain``, no lengths); a null
    text counts as empty, a missing id as empty text.
    """
    kept = [c for c in docs.columns if c not in dict(ARRANGED)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *arrange(part, seed, share, spm)], names=[*kept, *dict(ARRANGED)])

    return docs.select(*kept).mapInArrow(run, _schema(docs, kept) + ARRANGED_SQL)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (``output, form`` and more) with ``restored``, the original text, and ``restored_sha256``.

    Only the output and its form are looked at. Columns of these names are replaced; a null output gives nulls.
    """
    kept = [c for c in outputs.columns if c not in ("restored", "restored_sha256")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "output"):
                texts, digests = [], []
                for output, form in zip(part.column("output").cast(pa.binary()), part.column("form").to_pylist()):
                    own = output.as_py()
                    text, digest = (None, None) if own is None else streamed([(TEXT, a, b) for a, b in found(own, form)], [memoryview(own)])
                    texts.append(text)
                    digests.append(digest)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())], names=[*kept, "restored", "restored_sha256"])

    return outputs.select(*kept).mapInArrow(run, _schema(outputs, kept) + "restored string, restored_sha256 string")


def _schema(df: DataFrame, kept: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of all ``documents``; each output is turned back into its text. Null, empty and repeated texts: see ``rearranged``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = rearranged(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    return restored(made).drop("output", "restored")
