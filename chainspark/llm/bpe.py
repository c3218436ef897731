"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what merging would give exactly if
every token is stable by itself and every adjacent pair is compatible, and compatibility of a pair follows from
undoing the merges along their border. All pairs of a batch are tested at once; only words with a failing pair
are merged exactly. Work is done per distinct chunk of a batch, so repeated words cost a look-up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, flat_array, look_up, read, slices

#: Fixed values of the public byte-level format: the pattern that cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other white space than single spaces and line ends between words, or with a zero byte.
ODD = r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
BORDER = re.compile(r"(?<=\S) (?=\S)")
NEVER = np.int64(1) << 40


def byte_names() -> dict[str, int]:
    """The format writes bytes as printable characters: these stand for themselves, the others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [begin, end) of ``values`` one after another, and where each begins."""
    cuts = np.concatenate([[0], np.cumsum(end - begin)])
    return values[np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], end - begin)], cuts


class Vocabulary:
    """Tables of one byte-level BPE file (its JSON text)."""

    def __init__(self, file: str):
        spec = json.loads(file)
        names, ids = byte_names(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(names[c] for c in t) for t, i in ids.items()}
        n = max([*self.bytes, *self.special.values()]) + 1
        self.base = np.zeros(256, np.int64)
        for i, b in self.bytes.items():
            if len(b) == 1:
                self.base[b[0]] = i
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = (r, made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, r
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_made = np.array(list(self.merges.values()), np.int64)[order].T
        self.length = np.array([len(self.bytes.get(i, b"")) for i in range(n)], np.int64)
        self.stable = np.zeros(n, bool)
        self.stable[self.base] = True
        made = np.flatnonzero(self.rank >= 0)
        self.stable[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:  # a token is stable if its halves are
            self.stable[t] &= self.stable[self.left[t]] and self.stable[self.right[t]]
        names = {i: s.encode() for s, i in self.special.items()}
        self.text = pa.array([str(i) for i in range(n)])
        self.raw = pa.array([self.bytes.get(i, names.get(i, b"")) for i in range(n)], pa.binary())
        self.matcher = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            self.matcher.add_word(b.decode("latin1"), i)
        self.matcher.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.joined = regex.compile(r"\x00|" + PATTERN.replace(r"[^\s", r"[^\x00\s"))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does merging leave the border between them alone?

        Time runs backwards over the merges that made the two border tokens. At each state, the pair that faces
        each other over the border would have merged if that merge comes before the next one that uses up either
        (for equal ranks the left place goes first). With ``before``, merges from that rank on don't count.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if before is None else 2 * before.astype(np.int64)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at, there = look_up(self.pair_keys, x << 32 | y)
            clash = there & (2 * np.where(there, self.pair_ranks[at], 0) < limit[live])
            good[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            # A junction merge of the same rank comes later than one on the left, and before one on the right.
            limit[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            live = live[~clash & (np.maximum(rx, ry) >= 0)]
        return good

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words side by side: in each round every word merges its pair of lowest rank,
        the leftmost among equals. Returns the tokens one after another and where each word's tokens begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self.facing(tokens, word)
        while len(tokens):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff([*first, len(word)])
            over = np.repeat(best == NEVER, lengths)
            if over.any():
                done.append((word[over], tokens[over]))
                tokens, word, rank, made = tokens[~over], word[~over], rank[~over], made[~over]
                continue
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            at = hits[np.flatnonzero(np.diff(word[hits], prepend=-1))]
            tokens[at] = made[at]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            tokens, word, rank, made = tokens[keep], word[keep], rank[keep], made[keep]
            touched = np.zeros(len(tokens), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            stale = np.flatnonzero(touched)
            after = np.minimum(stale + 1, len(tokens) - 1)
            rank[stale], made[stale] = self.facing_at(tokens[stale], tokens[after], (word[stale] == word[after]) & (after > stale))
        if done:
            word, tokens = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(word, kind="stable")
            word, tokens = word[order], tokens[order]
        return tokens, np.searchsorted(word, np.arange(len(words) + 1))

    def facing_at(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = look_up(self.pair_keys, a << 32 | b)
        there = there & same
        return np.where(there, self.pair_ranks[at], NEVER), np.where(there, self.pair_made[at], -1)

    def facing(self, tokens: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each token's merge with the next one of its word."""
        same = np.append(word[1:] == word[:-1], False)
        return self.facing_at(tokens, np.roll(tokens, -1), same)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and where each word's begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        found = list(self.matcher.iter_long("\u0100".join([w.decode("latin1") for w in words])))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        tokens = np.fromiter((t for _, t in found), np.int64, len(found))
        starts = np.cumsum(size + 1) - size - 1
        word = np.searchsorted(starts, ends, "right") - 1
        right = np.bincount(word, self.length[tokens], len(words)).astype(np.int64) == size
        pairs = np.flatnonzero(word[1:] == word[:-1])
        back, keys = pd.factorize(tokens[pairs] << 32 | tokens[pairs + 1])
        fits = self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]
        right[word[pairs[~fits]]] = False
        right[word[~self.stable[tokens]]] = False
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        begin, end = cuts[:-1].copy(), cuts[1:].copy()
        wrong = np.flatnonzero(~right)
        if len(wrong):
            merged, cuts = self.merge([words[i] for i in wrong])
            begin[wrong], end[wrong] = len(tokens) + cuts[:-1], len(tokens) + cuts[1:]
            tokens = np.concatenate([tokens, merged])
        return gather(tokens, begin, end)

    def encode_chunks(self, chunks: list[str], certain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all chunks one after another. ``certain``: none ends in white space or holds a zero byte."""
        if certain:
            parts = self.joined.findall("\0".join(chunks))
            gap = "\0"
        else:
            parts, gap = [], None
            for c in chunks:
                parts += [(c,)] if c in self.special else self.pattern.findall(c)
                parts.append(gap)
            parts.pop()
        index = {w: i for i, w in enumerate(dict.fromkeys([gap, *parts]))}
        codes = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        words = list(index)[1:]
        tokens, cuts = self.encode_words([b"" if isinstance(w, tuple) else w.encode() for w in words])
        begin, end = cuts[:-1].copy(), cuts[1:].copy()
        for i, w in enumerate(words):
            if not certain and isinstance(w, tuple):
                begin[i], end[i], tokens = len(tokens), len(tokens) + 1, np.append(tokens, self.special[w[0]])
        chunk = np.cumsum(codes == 0)
        own = codes > 0
        flat, word_cuts = gather(tokens, begin[codes[own] - 1], end[codes[own] - 1])
        return flat, word_cuts[np.searchsorted(chunk[own], np.arange(len(chunks) + 1))]

    def split(self, text: str) -> list[str]:
        """Chunks at certain word borders; special tokens stand alone."""
        if not any(s in text for s in self.special):
            return BORDER.sub("\0 ", text).split("\0") if "\0" not in text else [text]
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        return [c for p in parts for c in ([p] if p in self.special else self.split(p)) if p]

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[bytes]]]:
        """Of each group of texts: their positions, token counts, ids one after another, joined ids, decoded bytes."""
        strings = pc.fill_null(texts, "").to_pylist()
        odd = pc.match_substring_regex(pc.fill_null(texts, ""), "|".join([ODD, *map(re.escape, self.special)])).to_numpy(zero_copy_only=False)
        for certain, at in ((True, np.flatnonzero(~odd)), (False, np.flatnonzero(odd))):
            if not len(at):
                continue
            some = [strings[i] for i in at]
            if certain:
                pieces = flat_array(pc.split_pattern(pc.replace_substring(pa.array(some), " ", "\0 "), "\0"))
                flat, cuts = pieces.flatten(), pieces.offsets.to_numpy()
            else:
                lists = [self.split(t) for t in some]
                flat = pa.array([c for x in lists for c in x], pa.string())
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            coded = flat.dictionary_encode()
            ids, begins = self.encode_chunks(coded.dictionary.to_pylist() or [""], certain)
            codes = coded.indices
            which = codes.to_numpy(zero_copy_only=False).astype(np.int64)
            all_ids, ends = gather(ids, begins[:-1][which], begins[1:][which])
            index, begins = pa.array(cuts - cuts[0], pa.int32()), pa.array(begins, pa.int32())
            text = pc.binary_join(pa.ListArray.from_arrays(begins, self.text.take(ids)), ",").take(codes)
            back = pc.binary_join(pa.ListArray.from_arrays(begins, self.raw.take(ids)), b"").take(codes)
            join = lambda x, by, index=index: pc.binary_join(pa.ListArray.from_arrays(index, x), by).to_pylist()
            yield at, ends[cuts - cuts[0]], all_ids, join(text, ","), join(back, b"")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    """One per Python worker and file."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(file)
    return _loaded[key]


def map_tokens(docs: DataFrame, file: str, column: str, schema: str, result, limit: int = 2 * SLICE_BYTES) -> DataFrame:
    """``docs`` without ``column`` plus what ``result(ids, joined, decoded)`` gives for each text (a tuple for ``schema``).

    ``file`` is the JSON text of the vocabulary: a megabyte or two, whatever the corpus. About ``limit`` bytes of texts
    are worked on at once. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file)
    kept = [c for c in docs.columns if c != column]
    extra = [f.split()[0] for f in schema.split(", ")]
    kept = [c for c in kept if c not in extra]
    full = docs.select(*[docs[c] for c in kept]).schema
    names = full.simpleString()[7:-1]

    def run(batches):
        words = vocabulary(shared.value)
        for batch in batches:
            for part in slices(batch, column, limit):
                out: list = [None] * part.num_rows
                for at, ends, ids, joined, back in words.texts(part.column(column)):
                    for i, k, text, raw in zip(at.tolist(), range(len(at)), joined, back):
                        out[i] = result(ids[ends[k] : ends[k + 1]], text, raw)
                columns = [part.column(c) for c in kept] + [pa.array(list(x)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *extra])

    return docs.select(*[docs[c] for c in kept], docs[column]).mapInArrow(run, f"{names}, {schema}" if names else schema)


def encode_documents(docs: DataFrame, file: str, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens`` in place of the text. Null and empty texts: no ids.

    With ``decoded``, a column of that name holds what the ids give when decoded, made in the same pass.
    """

    def result(ids, _, back):
        out = len(ids), ids.astype(np.int32)
        return (*out, back.decode("utf-8", "replace")) if decoded else out

    schema = "n_tokens bigint, ids array<int>" + (f", {decoded} string" if decoded else "")
    return map_tokens(docs, file, "text", schema, result, SLICE_BYTES // 2)


def decode_documents(coded: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with the text that the ids of each row stand for in column ``text``, replaced if there. No shuffle.

    Bytes that form no character become U+FFFD, as the public decoder does. Null and empty lists give empty text.
    """
    shared = coded.sparkSession.sparkContext.broadcast(file)
    kept = [c for c in coded.columns if c != text]
    full = coded.select(*[coded[c] for c in kept])
    schema = T.StructType([*full.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        words = vocabulary(shared.value)
        for batch in batches:
            lists = pc.fill_null(batch.column(ids), [])
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(size) - size) // SLICE_BYTES
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                some = lists.slice(int(a), int(b - a))
                cuts = pa.array(np.concatenate([[0], np.cumsum(size[a:b])]), pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words.raw.take(some.flatten())), b"")
                texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(int(a), int(b - a)).columns, texts], names=[*kept, text])

    return full.mapInArrow(run, schema)


def decode_ids(ids: list[int], file: str) -> str:
    """The text of a list of ids; bytes that form no character become U+FFFD, as the public decoder does."""
    words = vocabulary(file)
    names = {i: s.encode() for s, i in words.special.items()}
    return b"".join(names.get(i) or words.bytes[i] for i in ids).decode("utf-8", "replace")


def digests(docs: DataFrame, file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row's whole text; null texts are empty texts."""

    def result(ids, joined, back):
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_tokens(docs.select("doc_id", "text"), file, "text", schema, result)


def public_file(name: str = "byte_bpe_50k.json") -> str:
    """The JSON text of a public vocabulary, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``documents``: null and empty texts have no tokens; rows are encoded one by one, so repeats agree."""
    return digests(read(spark, sf_dir, "documents"), public_file())
