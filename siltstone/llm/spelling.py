"""Groups of spelling variants by full neighbourhood generation.

Words are maximal runs of Latin letters with A-Z in lower case, of ``MIN_CHARS`` code points and ``MIN_COUNT``
occurrences at least. For each word all distinct deletions, replacements and insertions over the observed
alphabet are generated; those that are words themselves, which a hash join with the vocabulary tells, are the
words near it, so distances are never computed. A word's form is its near word of largest count (ties: the
smallest in code-point order) if that is at least ``RATIO`` times as frequent, else null; its root is where the
forms lead, itself if it has none. Counts at least double from form to form, so the way is short and has an end.

Neighbours are generated as hashes: a word's hash is a sum over its places, so each neighbour's follows from sums
over the places before and after the edit. A Bloom filter of the vocabulary, sized by a count of the words up
to ``MOST_BITS``, sifts them, and only what passes becomes text and is joined; with more words than the largest
filter is made for more neighbours pass, and the result stays exact. No word is near more words than it has
neighbours, so no key of that join is hot.

``damaged``: as a test of itself, the query takes a code point out of one in ``damaged`` runs of a document, chosen
by the CRC-32 of ``<id>:<run>``; a null id is the empty text there. Null and empty texts have no runs. Repeated
rows count each time. An empty table has no words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, kept, lookup, stored, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
DAMAGED = 97
#: Bits of the filter for each word, how many it has at least and at most (256 MB, the bound of the broadcast), and bits that a word sets.
WORD_BITS, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 20, 1 << 31, 3
#: Bits of one of Spark's bitmaps.
BITMAP = 32_768
#: Words of a task, and neighbours that a task generates at a time.
TASK_WORDS, AT_ONCE = 8_192, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_UNBASE = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F)]


def counted(df: DataFrame, id_col: str = "doc_id", text: str = "text", damaged: int | None = None) -> DataFrame:
    """(word, n): the words of all texts; those of ``MIN_CHARS`` and ``MIN_COUNT`` at least."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")  # lower() would change accented letters too
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if damaged:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        word = F.col("word")
        cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
        runs = runs.select(F.when(h % damaged == 0, cut).otherwise(word).alias("word"))
    words = runs.where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= MIN_COUNT)


def filter_bits(words: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (WORD_BITS * words).bit_length()))


def _codes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of words of one length each time: their numbers, and a row of code points for each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        joined = "".join(words[k] for k in rows)
        yield rows, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(rows), length)


def _value(codes: np.ndarray) -> np.ndarray:
    """A number for each code point."""
    h = (codes.astype(np.uint64) + _MIX[0]) * _MIX[1]
    return (h ^ (h >> np.uint64(29))) * _MIX[2]


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def _before(codes: np.ndarray) -> np.ndarray:
    """For each word the sums over the places before each place and, at last, over all."""
    terms = _value(codes) * _powers(codes.shape[1])
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)


def hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for rows, codes in _codes(words):
        out[rows] = _before(codes)[:, -1]
    return out


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(32))) * _MIX[probe]) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def has(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """The indexes of the hashes that the filter holds."""
    at = np.arange(len(h))
    for probe in range(PROBES):
        place = _places(h[at], bits, probe)
        at = at[(bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    return at


def vocabulary_filter(vocabulary: DataFrame, bits: int) -> bytes:
    """The filter's bits; bitmaps are put together in Spark, and at most ``MOST_BITS`` of them come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_places(h, bits, probe) for probe in range(PROBES)]))], names=["place"])

    places = vocabulary.select("word").mapInArrow(run, "place long")
    parts = places.groupBy(F.floor(F.col("place") / BITMAP).cast("long").alias("part")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        start = r["part"] * BITMAP // 8
        out[start : start + BITMAP // 8] = np.frombuffer(r["bitmap"], np.uint8)
    return out.tobytes()


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, word, place, index in the alphabet, hash) of all distinct neighbours of words of one length, some at a time.

    Of a run of equal letters the first is deleted, and a letter is inserted only where its like doesn't stand
    before; so no text comes twice.
    """
    n, length = codes.shape
    values, powers = _value(alphabet), _powers(length + 1)
    before = _before(codes)
    whole = before[:, -1]
    step = max(1, AT_ONCE // (n * len(alphabet)))
    for a in range(0, length + 1, step):
        b = min(a + step, length)
        if b > a:
            here, own, power = codes[:, a:b], before[:, a + 1 : b + 1] - before[:, a:b], powers[a:b]
            first = np.ones(here.shape, bool)
            first[:, 1 if a == 0 else 0 :] = here[:, 1 if a == 0 else 0 :] != codes[:, (0 if a == 0 else a - 1) : b - 1]
            word, place = np.nonzero(first)
            yield "delete", word, place + a, np.zeros(len(word), np.int64), (before[:, a:b] + (whole[:, None] - before[:, a + 1 : b + 1]) * _UNBASE)[word, place]
            word, place, letter = np.nonzero(here[:, :, None] != alphabet)
            yield "replace", word, place + a, letter, (whole[:, None] - own)[word, place] + (values[letter] * power[place])
        c = min(a + step, length + 1)
        previous = np.zeros((n, c - a), np.uint32)
        previous[:, 1 if a == 0 else 0 :] = codes[:, (0 if a == 0 else a - 1) : c - 1]
        word, place, letter = np.nonzero(previous[:, :, None] != alphabet)
        kept_sum = before[:, a:c] + (whole[:, None] - before[:, a:c]) * np.uint64(_BASE)
        yield "insert", word, place + a, letter, kept_sum[word, place] + values[letter] * powers[a:c][place]


def _edited(edit: str, word: str, place: int, letter: str) -> str:
    return word[:place] + ("" if edit == "delete" else letter) + word[place + (edit != "insert") :]


def near_words(vocabulary: DataFrame, words: int) -> DataFrame:
    """(word, near, near_n) for each two words of ``vocabulary`` (word, n; stored) that are near each other, both ways round. ``words``: how many it has."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect()  # letters of ``RUN``
    alphabet = "".join(sorted(r["letter"] for r in letters))
    bits = filter_bits(words)
    shared = vocabulary.sparkSession.sparkContext.broadcast(vocabulary_filter(vocabulary, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, points = np.frombuffer(shared.value, np.uint8), np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for rows, codes in _codes(texts):
                size = max(1, AT_ONCE // (codes.shape[1] * len(points)))
                for k in range(0, len(rows), size):
                    for edit, word, place, letter, h in neighbours(codes[k : k + size], points):
                        held = has(bitmap, bits, h)
                        own = [texts[rows[k + w]] for w in word[held]]
                        near = [_edited(edit, x, p, alphabet[c]) for x, p, c in zip(own, place[held].tolist(), letter[held].tolist())]
                        if near:
                            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    dealt = vocabulary.select("word").repartition(max(1, -(-words // TASK_WORDS)), "word")
    found = dealt.mapInArrow(run, "word string, near string")
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, root) with a word's form: each round a root's own root takes its place, so ways halve."""
    links, at = kept(forms)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further, further_at = kept(further.join(links.groupBy("root").agg(F.count(F.lit(1)).alias("times")), "root"))
        if further.isEmpty():
            discard(further_at)
            return links
        moved = lookup(links, further, "root", "times", "left").select("word", F.coalesce("next", "root").alias("root"))
        was, (links, at) = at, kept(moved)
        discard(was, further_at)


def variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", damaged: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row a word."""
    vocabulary = stored(counted(df, id_col, text, damaged))
    words = vocabulary.count()
    near = near_words(vocabulary, words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    frequent = -F.col("best.rank") >= RATIO * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word",
        F.when(frequent, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, -F.col("best.rank")).alias("form_n"),
    )
    found = stored(found)
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"), damaged=DAMAGED)
