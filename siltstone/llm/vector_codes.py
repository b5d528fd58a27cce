"""Short codes for vectors: one codebook a part of the vector, nearest entries found by segment-mean lower bounds.

Components become integers, floor(``scale`` * x). A vector is cut into ``parts`` equal parts, each coded as the
index of its nearest entry of the part's codebook (squared Euclidean distance, ties to the lower index). A
codebook starts as the parts of the first vectors by id; each round assigns all parts and replaces each entry
by its parts' componentwise floor(sum / count); an entry without parts stays.

The nearest entry: a part and an entry are at least as far apart as their block means and the norms of what the
means leave over. That bound is taken over one block, then two, four and so on; each time entries drop out whose
bound lies above the distance to an entry that looked best so far, by a margin beyond rounding. Only the others'
exact integer distances are computed. So codes are exact.

Every row takes part in every round. Tasks return sums a codebook entry, which Spark adds; the driver holds the
codebooks alone (``entries`` vectors). Errors over equal labels are added by label and joined back where the
rows are, so a label that holds most rows is no one task's work.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of the most frequent
length that ``parts`` divides (ties: the shorter) are coded; those of other lengths, the empty one included,
stay with null code and error and count for nothing. With fewer vectors than ``entries`` there are fewer entries.
Repeated rows each count, as entries too; rows with a null id come after all others. Equal labels' errors are
added, nulls together; null where none of them has an error. Components so large that a distance might not fit
64 bits raise an error. An empty table has no rows. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lookup, stored, table
from siltstone.llm.topk import usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors at a time in a task.
SLICE = 1_024
#: Share of the squared norms that a bound is lowered by: rounding is below a seventh of it.
MARGIN = 1e-6


def _levels(size: int) -> list[np.ndarray]:
    """Where the blocks begin: one block, then twice as many each time, down to pairs."""
    levels, blocks = [], 1
    while blocks == 1 or blocks < size:
        levels.append(np.arange(blocks) * size // blocks)
        blocks *= 2
    return levels


def _sketch(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the block means times the roots of the blocks' sizes, and the norm of what they leave over."""
    sizes = np.diff([*starts, x.shape[1]])
    means = np.add.reduceat(x.astype(float), starts, axis=1) / np.sqrt(sizes)
    rest = np.sqrt(np.maximum((x.astype(float) ** 2).sum(axis=1) - (means**2).sum(axis=1), 0))
    return np.column_stack([means, rest])


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the index of the nearest entry and its squared distance; and how many distances were computed."""
    norms, book_norms = ((v.astype(float) ** 2).sum(axis=1) for v in (x, book))
    for level, starts in enumerate(_levels(x.shape[1])):
        of_x, of_book = _sketch(x, starts), _sketch(book, starts)
        if level == 0:  # all entries of all rows, as a matrix
            bound = sum((a[:, None] - b) ** 2 for a, b in zip(of_x.T, of_book.T))
            most = ((x - book[bound.argmin(axis=1)]) ** 2).sum(axis=1)
            bound -= MARGIN * norms[:, None]
            row, entry = np.nonzero(bound <= most[:, None] + MARGIN * book_norms)
        else:
            bound = _apart(of_x, row, of_book, entry)
            most = np.minimum(most, ((x - book[entry[_first_least(bound, row)]]) ** 2).sum(axis=1))
            left = bound - MARGIN * (norms[row] + book_norms[entry]) <= most[row]  # the nearest entry is always left
            row, entry = row[left], entry[left]
    computed = (level + 1) * len(x)
    exact = _apart(x, row, book, entry)
    best = _first_least(exact, row)
    return entry[best], exact[best], computed + len(exact)


def _apart(x: np.ndarray, row: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, a column at a time."""
    out = np.zeros(len(row), x.dtype)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(book.T)):
        far = a[row]
        far -= b[entry]
        far *= far
        out += far
    return out


def _first_least(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where each row (rising, none missing) has its least value, the first of equal ones."""
    least = np.minimum.reduceat(values, np.flatnonzero(np.diff(row, prepend=-1)))
    hit = np.flatnonzero(values == least[row])
    return hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            if x.shape[1] * (2 * np.abs(x.astype(float)).max(initial=0)) ** 2 >= 2.0**62:
                raise OverflowError("squared distances may not fit 64 bits")
            yield batch, x


def _improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after a round over (x)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, size = books.shape
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for _, x in _slices(batches, 0):
            for p in range(parts):
                part = x[:, p * size : (p + 1) * size]
                code = nearest(part, books[p])[0]
                np.add.at(sums[p], code, np.column_stack([part, np.ones(len(part), np.int64)]))
        some = np.flatnonzero(sums[:, :, size].ravel())
        for k in some:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, k)), pa.array(np.arange(size + 1)), pa.array(sums.reshape(-1, size + 1)[k])], names=["entry", "place", "total"])

    found = vectors.mapInArrow(run, "entry long, place long, total long").groupBy("entry", "place").agg(F.sum("total").alias("total"))
    sums = np.zeros((books.shape[0] * books.shape[1], books.shape[2] + 1), np.int64)
    for r in found.toLocalIterator():
        sums[r["entry"], r["place"]] = r["total"]
    out, used = books.reshape(-1, books.shape[2]).copy(), sums[:, -1] > 0
    out[used] = sums[used, :-1] // sums[used, -1:]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component) from (id, x), x of one length."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        books = _improved(vectors.select("x"), books)
    return books


def _coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) from (id, label, x)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, size = books.shape
        for batch, x in _slices(batches, 2):
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], far, _ = nearest(x[:, p * size : (p + 1) * size], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {n: vectors.schema[n].dataType.simpleString() for n in ("id", "label")}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), a row a vector that is kept; at most 256 ``entries``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    floors = F.transform(vec, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    rows = stored(df.where(usable(vec)).select(F.col(id_col).alias("id"), F.col(label).alias("label"), floors.alias("x")))
    lengths = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0)).groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "length").first()
    none = (F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if common is None:
        return rows.select(F.col("id").alias("vec_id"), "label", *none, F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    vectors = rows.where(F.size("x") == common["length"])
    books = codebooks(vectors, parts, entries, rounds)
    coded = stored(_coded(vectors, books).unionByName(rows.where(F.size("x") != common["length"]).select("id", "label", *none)))
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    unnamed = sums.where("label is null").first()
    named = lookup(coded.where("label is not null"), sums.where("label is not null"), "label", "n")
    apart = coded.where("label is null").withColumn("label_error", F.lit(unnamed["label_error"] if unnamed else None).cast("long"))
    return named.unionByName(apart).select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
