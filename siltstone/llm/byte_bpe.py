"""Byte-level BPE encoding and decoding by longest matches, backtracking and adjacent-token checks.

The text is split by the tokenizer's pattern. Each piece's bytes, read as Latin-1, go through an
Aho-Corasick automaton of the vocabulary, which gives the longest token at each position. Tokens are
taken from left to right; a token stands only if the merges would also put these two tokens next to
each other (a memoised check); otherwise the next shorter prefix token is tried, then the token before
is taken back. As each prefix has just one valid encoding, a position is given up once at most: the
work is linear in the piece.

Nulls count as empty texts, empty texts give no ids; repeated rows are encoded each for itself; other
columns, whatever their names, pass through unchanged (the output columns must not exist already).
"""

from __future__ import annotations

import base64
import hashlib
import string
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import named_apart, table, take_turn

#: Entries of a worker's piece cache; it starts anew when full.
CACHE_ENTRIES = 800_000
#: Rows handed on at a time, so that a worker's memory follows the texts and not the batch.
SLICE = 256


def read_ranks(path: str) -> bytes:
    """The rank file's content (a fixed vocabulary of about 1 MB), read on the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one vocabulary. ``content``: lines of base64 token and rank."""

    def __init__(self, content: bytes, pattern: str) -> None:
        rows = [line.split() for line in content.splitlines() if line]
        self.bytes_of = {int(rank): base64.b64decode(token) for token, rank in rows}
        self.rank = {token.decode("latin-1"): rank for rank, token in self.bytes_of.items()}
        self.text_of = {rank: token for token, rank in self.rank.items()}
        self.split = regex.compile(pattern)
        self._halves()
        self.longest = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if len(token) == 1 or rank in self.parts:
                self.longest.add_word(token, rank)
        self.longest.make_automaton()
        self.shorter = self._prefixes()
        self.size = [len(self.text_of.get(rank, "")) for rank in range(len(self.shorter))]
        self.fits: dict[int, bool] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.head, self.after_space = _Pieces(self, ""), _Pieces(self, " ")

    def _halves(self) -> None:
        """For each token the two tokens whose merge makes it. A token that merges never make has no halves."""
        self.parts: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.text_of):
            if len(token := self.text_of[rank]) > 1:
                left = self._merge(token, rank)
                if len(left) == 2:
                    self.parts[rank] = (self.rank[left[0]], self.rank[left[1]])

    def _merge(self, text: str, below: int) -> list[str]:
        """Plain merging with the ranks under ``below``."""
        parts = list(text)
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                if (r := self.rank.get(parts[i] + parts[i + 1], below)) < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _prefixes(self) -> list[int]:
        """For each token the longest usable token that is a proper prefix of it; -1 if there is none."""
        found = [-1] * (max(self.text_of) + 1)
        for rank, token in self.text_of.items():
            for end in range(len(token) - 1, 0, -1):
                r = self.rank.get(token[:end])
                if r is not None and (end == 1 or r in self.parts):
                    found[rank] = r
                    break
        return found

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two tokens.

        Undoes merges on either side of the seam, the later one first. If two tokens that meet at the seam
        would have merged before the merge undone last, the pair can't stand.
        """
        if len(self.fits) > 4 * CACHE_ENTRIES:
            self.fits.clear()
        a, b, undone = left, right, len(self.rank) + 1
        a_undone = b_undone = undone  # a merge on the left wins a tie against one at the seam, one on the right doesn't
        good = True
        while True:
            joint = self.rank.get(self.text_of[a] + self.text_of[b])
            if joint is not None and joint < a_undone and joint <= b_undone:
                good = False
                break
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                break
            if pb_ is None or (pa_ is not None and a > b):
                a_undone = b_undone = a
                a = pa_[1]
            else:
                a_undone, b_undone = b + 1, b
                b = pb_[0]
        self.fits[left << 32 | right] = good
        return good

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        if (whole := self.rank.get(raw)) is not None:
            return array("i", [whole]).tobytes()
        fits, before, ids = self.fits, -1, []
        for _, token in self.longest.iter_long(raw):  # the longest matches one after another; most pieces need no more
            if before >= 0:
                if (good := fits.get(before << 32 | token)) is None:
                    good = self._adjacent(before, token)
                if not good:
                    return self._backtrack(raw)
            ids.append(token)
            before = token
        return array("i", ids).tobytes()

    def _backtrack(self, raw: str) -> bytes:
        end_of_text, size, shorter, fits = len(raw), self.size, self.shorter, self.fits
        longest = [-1] * end_of_text
        for end, token in self.longest.iter(raw):
            longest[end - size[token] + 1] = token
        dead: set[int] = set()
        ids: list[int] = []
        starts: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if before < 0:
                        break
                    if (good := fits.get(before << 32 | token)) is None:
                        good = self._adjacent(before, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == end_of_text:
                    return array("i", ids).tobytes()
                starts.append(at)
                at, before, token = end, token, longest[end]
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                token, at = shorter[ids.pop()], starts.pop()
                before = ids[-1] if ids else -1

    def encode_piece(self, piece: str) -> bytes:
        if (found := self.piece_ids.get(piece)) is None:
            if len(self.piece_ids) >= CACHE_ENTRIES // 4:
                self.piece_ids.clear()
            found = self._encode_piece(piece)
            if len(piece) < 64:
                self.piece_ids[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids as int32. Where single spaces alone separate words, whole words are looked up: no match of the pattern crosses such a space."""
        if not text:
            return np.empty(0, "<i4")
        if text[0] == ' ' or text[-1] == ' ' or any(x in text for x in _LOOSE_SPACE):
            return np.frombuffer(b"".join(map(self.encode_piece, self.split.findall(text))), "<i4")
        first, *rest = text.split(" ")
        return np.frombuffer(self.head[first] + b"".join(map(self.after_space.__getitem__, rest)), "<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_MARKS = string.punctuation.replace("'", "")
#: White space beside a space, or any but line breaks: such texts go through the pattern as a whole.
_LOOSE_SPACE = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


class _Pieces(dict):
    """Ids, as bytes, of what stands between two single spaces, with the space before it; it holds plain words, with marks after them or not."""

    def __init__(self, codec: Codec, prefix: str) -> None:
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha():
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            if len(core) < len(word):  # letters and then marks: two matches of the pattern
                ids = self[core] + self.codec.encode_piece(word[len(core) :])
            else:
                ids = self.codec._encode_piece(self.prefix + word)
            if len(word) < 64:
                self[word] = ids
            return ids
        return b"".join(map(self.codec.encode_piece, self.codec.split.findall(self.prefix + word)))


_codecs: dict[bytes, Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    take_turn("byte_bpe", _codecs.clear)
    key = hashlib.sha256(content + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds ``out``: array<int>, the ids of the whole text."""
    named_apart(df, out)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                ids = [c.encode(x or "") for x in batch.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate([np.empty(0, "<i4"), *ids]))
                yield _with(batch, out, pa.ListArray.from_arrays(pa.array(ends), flat))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: binary, the bytes that the ids stand for; null ids give no bytes."""
    named_apart(df, out)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                column = batch.column(at)
                flat, ends = column.flatten().to_numpy().tolist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
                yield _with(batch, out, pa.array([c.decode(flat[i:j]) for i, j in zip([0, *ends], ends)], pa.binary()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    both = decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
