"""Line dedup with two Bloom filters, for lines seen once and seen twice.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Each task puts
the hashes of its documents' keys into a filter of once-seen ones, and into a second one those that the
first has already. The filters are cut into segments; segments of all tasks meet by their number, where a
bit set in two tasks' first filters goes to the second. Filters are sized by a count of the lines, up to
``MOST_BITS``, and the second is broadcast. Only lines that it suspects of repeating are shuffled, as SHA-256
digests, to be counted and to find the one document that keeps the line. With more lines than the largest
filter is made for (half a billion at 8 bits each), more of them are suspected; the result stays exact.

Keys shorter than ``MIN_CHARS`` code points, or in fewer than ``MIN_DOCS`` documents, lose nothing. A null
text is one empty line, and its text becomes empty. Rows that repeat an id are one document for the counts.
Rows with a null id neither count nor lose lines. Other columns pass through unchanged; columns of the outputs'
names raise, and the outputs can be named otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import lookup, named_apart, stored, table, take_turn

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of a filter for each line that there is, and how many it has at least and at most (512 MB, the bound of the broadcast).
LINE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 32
SEGMENTS = 1_024
SPACE = b" \t\n\x0b\x0c\r"
SLICE = 512


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= 4 * chars or (len(key) >= chars and len(key.decode()) >= chars)


def _keys(text: str | None, chars: int) -> set[bytes]:
    return {k for k in map(line_key, (text or "").encode().split(b"\n")) if _long_enough(k, chars)}


def filter_bits(lines: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (LINE_BITS * lines).bit_length()))


class Bloom:
    """Bits in segments; a hash sets two bits of its segment."""

    def __init__(self, bits: int, segments: int) -> None:
        self.segments, self.width = segments, bits // segments
        self.bits = np.zeros((segments, self.width // 8), np.uint8)

    def _places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        segment = (h % np.uint64(self.segments)).astype(np.int64)
        for shift in (np.uint64(10), np.uint64(37)):
            at = ((h >> shift) % np.uint64(self.width)).astype(np.int64)
            yield segment, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for segment, byte, bit in self._places(h):
            np.bitwise_or.at(self.bits, (segment, byte), bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for segment, byte, bit in self._places(h):
            found &= self.bits[segment, byte] & bit != 0
        return found


def _filters(texts: DataFrame, chars: int, bits: int) -> DataFrame:
    """(segment, once, twice) of each task's own lines; packed, so that they follow the task's lines and not the filter's size."""
    segments = SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("line_dedup", int)
        once, twice, any_line = Bloom(bits, segments), Bloom(bits, segments), False
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                hashes = [xxhash.xxh3_64_intdigest(x) for text in whole.column(0).slice(k, SLICE).to_pylist() for x in _keys(text, chars)]
                if not hashes:
                    continue
                any_line = True
                h, times = np.unique(np.array(hashes, np.uint64), return_counts=True)
                twice.add(h[(times > 1) | once.has(h)])
                once.add(h)
        if any_line:
            some = np.flatnonzero(once.bits.any(axis=1))
            for part in np.array_split(some, max(1, len(some) // 256)):
                columns = [pa.array(part), *(pa.array([zlib.compress(f.bits[s].tobytes(), 1) for s in part], pa.binary()) for f in (once, twice))]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "once", "twice"])

    return texts.mapInArrow(run, "segment long, once binary, twice binary")


def _joined(parts: DataFrame) -> DataFrame:
    """(segment, twice) over all tasks. What a task holds is a few segments, however many parts come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(zlib.decompress(b), np.uint8) for b in blobs)
                if segment in held:
                    seen = held[segment]
                    seen[1] = seen[1] | twice | (seen[0] & once)
                    seen[0] = seen[0] | once
                else:
                    held[segment] = [once, twice]
        packed = {s: zlib.compress(twice.tobytes(), 1) for s, (_, twice) in held.items() if twice.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int64()), pa.array(list(packed.values()), pa.binary())], names=["segment", "twice"])

    return parts.repartition("segment").mapInArrow(run, "segment long, twice binary")


def _suspected(rows: DataFrame, twice: dict[int, bytes], chars: int, bits: int) -> DataFrame:
    """Of (id, text): (id, digest) of the lines that the second filter holds."""
    segments = SEGMENTS
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bloom(bits, segments)
        for segment, blob in shared.value.items():
            seen.bits[segment] = np.frombuffer(zlib.decompress(blob), np.uint8)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                keys, owners = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    found = _keys(text, chars)
                    keys += found
                    owners += [row] * len(found)
                hit = np.flatnonzero(seen.has(np.array([xxhash.xxh3_64_intdigest(x) for x in keys], np.uint64)))
                digests = pa.array([hashlib.sha256(keys[i]).digest() for i in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(owners, np.int64)[hit])), digests], names=["id", "digest"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary")


def repeated_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digests): for each document that loses lines, the digests of their keys."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    bits = filter_bits(rows.agg(F.sum(F.coalesce(ends, F.lit(0)) + 1)).first()[0] or 0)
    segments = _joined(_filters(rows.select("text"), min_chars, bits)).collect()  # MOST_BITS / 8 bytes at most
    found = stored(_suspected(rows, {r["segment"]: bytes(r["twice"]) for r in segments}, min_chars, bits).distinct())
    common = stored(found.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs))
    lost = lookup(found, common, "digest", "docs").where("id <> keeper")
    return lost.groupBy("id").agg(F.collect_list("digest").alias("digests"))


def deduplicate(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``df`` with the lines taken out of ``text``, and with n_lines (before) and n_dropped, or as ``counts`` names them."""
    named_apart(df, *counts)
    key, digests = "__siltstone_id", "__siltstone_digests"
    lost = repeated_lines(df, min_chars, min_docs, id_col, text).select(F.col("id").alias(key), F.col("digests").alias(digests))
    joined = df.join(lost, F.col(id_col) == F.col(key), "left").drop(key)
    names = df.columns
    at = names.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                texts, before, dropped = [], [], []
                for value, digests in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                    value = value or ""
                    if not digests:
                        texts.append(value)
                        before.append(value.count("\n") + 1)
                        dropped.append(0)
                        continue
                    gone, lines = set(digests), value.split("\n")
                    left = [x for x in lines if not (len(x) >= min_chars and hashlib.sha256(line_key(x.encode())).digest() in gone)]
                    texts.append("\n".join(left))
                    before.append(len(lines))
                    dropped.append(len(lines) - len(left))
                columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *counts])

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(c.keeper <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
