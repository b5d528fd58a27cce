"""Packing documents into sequences by dynamic programming, in the order of the input.

The documents' ids stand one after another. A window (sequence) may end at a document's end for nothing,
at a sentence's end for a small penalty, and inside a long sentence, at every ``STRIDE`` ids, for a larger
one. The windows' padding plus these penalties is least: best[j] = penalty[j] + L - at[j] + min(best[i] +
at[i]) over the cuts i at most L ids before j, where a monotone queue gives the minimum in constant time.

Each task packs its own part of the input as it streams by, in blocks of at least ``BLOCK`` ids, so
nothing is shuffled and a lost task gives the same sequences again. Null and empty texts are documents of
the end id alone; repeated rows are packed each for itself; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import os
import string
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import table, take_turn
from siltstone.llm.token_counts import read_tokenizer

LENGTH = 2048
#: In ids of padding: what ending a window at a sentence's end, or inside a sentence, costs.
SENTENCE_PENALTY, INSIDE_PENALTY = 8, 48
STRIDE = 256
#: Ids in a block: its last window is padded, which is one in 500.
BLOCK = 1_000_000
#: Kept under what makes a dictionary of words double its table.
CACHE_ENTRIES = 650_000
SLICE = 256

_PUNCTUATION = string.punctuation
_CONTROL = "\x1c\x1d\x1e\x1f"
_encoders: dict[str, "WordEncoder"] = {}


def _lowered(word: str) -> str:
    """As the tokenizer's normaliser makes it; marks may come off a letter here."""
    return word if word.isascii() else unicodedata.normalize("NFC", word).lower()


class WordEncoder:
    """Ids by a tokenizer that drops white space and marks the ends of words: each word between spaces stands alone.

    Words are looked up in a bounded cache. New ones go to the library together: the letters between a
    word's outer punctuation are one word for it, and the mark of word ends tells the ids apart again.
    Whatever isn't so simple is encoded word by word or as a whole.
    """

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops = np.zeros(len(self.ends), bool)
        self.stops[[i for token, i in vocabulary.items() if token in (".</w>", "!</w>", "?</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, plain: list[str]) -> None:
        if not plain:
            return
        ids = self._whole(" ".join(plain))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):
            data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.words.update((x, data[i:j]) for x, i, j in zip(plain, at, at[1:]))
        else:
            self.words.update((x, self._whole(x).tobytes()) for x in plain)

    def _learn(self, new: set[str]) -> None:
        known = self.words
        plain, odd, parted = set(), [], []
        for word in new:
            if word.isalpha():
                plain.add(word)
                continue
            core = word.strip(_PUNCTUATION)
            if not core.isalpha() or "'" in word or "<|" in word or not _lowered(core).isalpha():
                odd.append(word)
                continue
            at = word.index(core)
            before, after = word[:at], word[at + len(core) :]
            parted.append((word, before, core, after))
            if core not in known:
                plain.add(core)
            odd += [x for x in (before, after) if x and x not in known]
        self._together(list(plain))
        for word in odd:
            if word not in known:
                known[word] = self._whole(word).tobytes()
        known[""] = b""
        for word, before, core, after in parted:
            known[word] = known[before] + known[core] + known[after]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the places, counted in ids, where sentences end."""
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        split = [None if any(c in x for c in _CONTROL) else x.split() for x in texts]
        self._learn(set().union(*(words for words in split if words)).difference(self.words))
        out = []
        for text, words in zip(texts, split):
            ids = self._whole(text) if words is None else np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
            out.append((ids, np.flatnonzero(self.stops[ids]) + 1))
        return out


def word_encoder(content: bytes) -> WordEncoder:
    """One encoder for each tokenizer in a Python worker."""
    take_turn("packing", _encoders.clear)
    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders[key] = WordEncoder(content)
    return _encoders[key]


def windows(at: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """Indexes into ``at`` of the cuts of least padding and penalties; the first is 0, the last the end.

    ``at`` rises from 0 by at most ``length`` a step.
    """
    places, costs = at.tolist(), penalty.tolist()
    came = [0] * len(places)
    reach = deque([(0, 0, 0)])  # (best[i] + at[i], at[i], i), rising in the first
    for j in range(1, len(places)):
        place = places[j]
        while place - reach[0][1] > length:
            reach.popleft()
        value, _, came[j] = reach[0]
        value += costs[j] + length
        while reach and reach[-1][0] >= value:
            reach.pop()
        reach.append((value, place, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return np.array([0, *cuts[::-1]])


def pack_block(ids: list[np.ndarray], stops: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces of the documents in order: document's index, start in it, length, window's index, offset in the window."""
    sizes = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sentences = np.concatenate([begins[k] + s for k, s in enumerate(stops)] or [np.empty(0, np.int64)])
    at = np.unique(np.concatenate([[0], sentences, ends]))
    step = min(STRIDE, length)
    gaps = np.diff(at)
    extra = [np.arange(at[k] + step, at[k + 1], step) for k in np.flatnonzero(gaps > step)]
    inside = np.concatenate([np.empty(0, np.int64), *extra])
    every = np.concatenate([at, inside])
    cost = np.concatenate([np.where(np.isin(at, ends), 0, SENTENCE_PENALTY), np.full(len(inside), INSIDE_PENALTY)])
    order = np.argsort(every, kind="stable")
    every, cost = every[order], cost[order]
    cuts = every[windows(every, cost, length)]
    bounds = np.unique(np.concatenate([cuts, ends, [0]]))
    starts, lengths = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(begins, starts, "right") - 1
    window = np.searchsorted(cuts, starts, "right") - 1
    return doc, starts - begins[doc], lengths, window, starts - cuts[window]


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path)[1])
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = word_encoder(shared.value), np.array([end_id], "<u4")
        sequence = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        stops: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, keys, ids, stops, held
            doc, start, size, window, offset = pack_block(ids, stops, length)
            names = pa.concat_arrays(keys)
            total = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            begins = np.concatenate([[0], np.cumsum(size)])
            for k in range(0, len(doc), 4096):
                s = slice(k, k + 4096)
                lo, hi = begins[k], begins[min(k + 4096, len(doc))]
                cut = (4 * (begins[k : k + len(doc[s]) + 1] - lo)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc[s]), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(flat[lo:hi].tobytes())])
                columns = [names.take(pa.array(doc[s])), *(pa.array(x[s]) for x in (start, size, total[doc], window + sequence, offset)), data]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += int(window[-1]) + 1
            keys, ids, stops, held = [], [], [], 0

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                keys.append(batch.column(0))
                for found, ends in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                    ids.append(np.concatenate([found, last]))
                    stops.append(ends)
                    held += len(found) + 1
                if held >= BLOCK:
                    yield from packed()
        if ids:
            yield from packed()

    return df.select(id_col, text).mapInArrow(run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
