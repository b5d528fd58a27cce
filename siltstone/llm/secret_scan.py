"""Secrets: patterns, and strings in sensitive places that a primed compressor finds incompressible.

The base finds values assigned to telling names, access key ids and long hexadecimal numbers. Beside it, a run of
at least ``RUN_CHARS`` characters of the values' alphabet is a candidate if it holds a letter and a digit, overlaps no base
span and begins within ``REACH`` code points after a sensitive word (or goes on behind one within the run). Its novelty
is how many bytes Zstandard needs more for the surroundings with it than for the surroundings alone (``AROUND``
code points on each side, without copies of the candidate), primed with a dictionary of the corpus's identifiers. A
candidate of ``NOVEL`` bytes a character at least is reported: names and words made of known pieces need far less,
random strings can't.

The dictionary holds identifiers (letters and underscores) by the bytes that they'd save: in how many texts
they are, over all documents, times their length. It is ``DICTIONARY`` bytes at most, so it is broadcast.

Texts are searched whole and in linear time; there is no shuffle but the count of identifiers, which is combined
in the tasks first. Rows are independent: a null id does no harm, repeated rows each get their spans. Null and empty texts
have none. Other columns pass through; ``find`` raises where the input has its output columns already. Positions count
code points; the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import discard, kept, named_apart, table

KINDS = ("assign", "access", "hex")
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 and more, found without stopping at the shorter ones
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE_CHARS, ACCESS_CHARS = 6, 20
#: Words (in lower case) that make the place after them a sensitive one.
SENSITIVE = ("apikey", "api_key", "auth", "bearer", "cookie", "credential", "passphrase", "passw", "private", "pwd", "salt", "secret", "session", "signature", "signing", "token", "_key", "-key", " key")
RUN_CHARS, REACH, AROUND, NOVEL = 16, 48, 512, 0.8
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{RUN_CHARS}}}")
_REST = re.compile(r"[A-Za-z0-9+/_.=-]*")
_WORDS = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: The dictionary's bytes, an identifier's pattern, and how many identifiers come to the driver at most: as many classes of the best as that holds.
DICTIONARY, IDENTIFIER, IDENTIFIERS = 1 << 16, r"(?<![A-Za-z0-9_])[A-Za-z_]{5,32}+(?![A-Za-z0-9_])", 12_000
LEVEL, SLICE = 3, 256
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def base_spans(text: str, low: str) -> list[tuple[str, int, int, str]]:
    """By start and then kind. ``low``: the text in lower case, which shows cheaply that most texts hold none."""
    found = []
    if any(name in low for name in ASSIGNED):
        found += [("assign", *m.span(), m.group()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= VALUE_CHARS]
    if "AKIA" in text:
        found += [("access", *m.span(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    found += [("hex", *m.span(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs in sensitive places, by start; each character is in one run at most, so this is linear."""
    reached, k = 0, 0
    reach = []  # how far the base spans up to each come
    for s in base:
        reach.append(max(s[2], reach[-1] if reach else 0))
    for word in _WORDS.finditer(text):
        at = max(word.end(), reached)
        while at <= word.end() + REACH and (run := _RUN.search(text, at, word.end() + REACH + RUN_CHARS)):
            start, end = run.start(), _REST.match(text, run.end()).end()
            at = reached = end
            while k < len(base) and base[k][1] < end:
                k += 1
            if (k == 0 or reach[k - 1] <= start) and _DIGIT.search(text, start, end) and _LETTER.search(text, start, end):
                yield start, end


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:  # too short for Zstandard
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_dict_id=False)


def novelty(press: zstandard.ZstdCompressor, text: str, start: int, end: int) -> float:
    """Bytes a character that the run adds to its surroundings."""
    value = text[start:end]
    around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).replace(value, "").encode()
    return (len(press.compress(around + value.encode())) - len(press.compress(around))) / len(value)


def identifiers(df: DataFrame, text: str = "text") -> bytes:
    """The dictionary: the corpus's identifiers, those that save most at its end, where they are cheapest to refer to."""
    names = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))))
    counts = df.select(names.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    saved = F.col("texts") * F.length("name")
    scored, at = kept(counts.select("name", saved.alias("saved"), F.floor(8 * F.log2(saved)).alias("class")))
    total, lowest = 0, None
    for r in sorted(scored.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # a few hundred
        total += r["n"]
        if total > IDENTIFIERS:
            break
        lowest = r["class"]
    best = scored.where(F.col("class") >= lowest).collect() if lowest is not None else []
    discard(at)
    best.sort(key=lambda r: (-r["saved"], r["name"]))
    out, size = [], 0
    for r in best:
        if size + len(r["name"]) + 1 > DICTIONARY:
            break
        out.append(r["name"])
        size += len(r["name"]) + 1
    return " ".join(reversed(out)).encode()


def find(df: DataFrame, text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """Adds base and extra: arrays of (kind, start, end, value) by start; extra's kind is ``novel``. ``dictionary``: made from ``df`` if not given."""
    named_apart(df, "base", "extra")
    shared = df.sparkSession.sparkContext.broadcast(identifiers(df, text) if dictionary is None else dictionary)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = compressor(shared.value)

        def spans(text: str | None) -> tuple[list, list]:
            text = text or ""
            low = text.lower()
            base = base_spans(text, low)
            if not any(w in low for w in SENSITIVE):
                return base, []
            return base, [("novel", a, b, text[a:b]) for a, b in candidates(text, base) if novelty(press, text, a, b) >= NOVEL]

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                found = [spans(x) for x in batch.column(at).to_pylist()]
                columns = [pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in f[j]] for f in found], _ARROW) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "base", "extra"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("base", T.ArrayType(SPAN)), T.StructField("extra", T.ArrayType(SPAN))]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _in_order(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "novel"))), s["kind"])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_in_order(F.concat("base", "extra"))).alias("spans"))
