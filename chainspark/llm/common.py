"""Small helpers shared by the operators: checkpoints, bounded slices of Arrow batches, words, 64-bit hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Working memory of a Python task follows this, whatever the length of a batch.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    Where none is set, a temporary folder serves a session that runs in one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in that folder: computed once, compressed, and of a size that planning knows."""
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def key_of(doc_id: Column, text: Column) -> Column:
    """64-bit identity of a row: rows with equal id and text share it and get equal results."""
    return F.xxhash64(doc_id, text)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near ``limit`` bytes; one text is never cut."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Memory that a Python worker no longer uses goes back to the system: a worker outlives its task, and what Arrow and
    the C library hold in reserve would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def flat_array(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words begin (one offset more than texts). Null: no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep, min_count=0).as_py():
        before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        return flat.filter(keep), before[offsets - offsets[0]]
    return flat, offsets - offsets[0]


def word_codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words they stand for."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash64(words: pa.Array) -> np.ndarray:
    """xxh64 of each distinct string, as signed 64-bit numbers."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit numbers (multiply and fold, twice)."""
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted keys, and whether it is there at all."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, whatever stands before and after it; 0 for texts without values."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), offsets[:-1][some])
    return out


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, one after another, and where each value begins."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]
