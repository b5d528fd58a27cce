"""Personal data: patterns, and terms that reveal what the patterns protect.

The base finds e-mail and IP addresses, card and phone numbers. A term is a word outside them, of two characters
at least; one of two or three must begin with a capital or a letter without case. It is held to reveal an entity
(one address or number) by co-occurrence in whole documents, over the corpus: at least ``MIN_TEXTS`` different
texts hold both, so that copies of one text (letter case and white space aside) are one piece of evidence;
texts that differ in a word are different. And of all documents that hold the term, at least ``DISCLOSURE``
hold the entity, log2(p(entity | term) / p(entity)) then being large for all but the most common entities
(``MIN_BITS``). Such terms become spans of their own wherever they stand outside base spans, and sanitising
generalises them to a placeholder.

All of it is DataFrame functions, and linear in a text's length but for a logarithm. Terms are held against
entities by classes of those that are in the same documents, so pairs follow the different sets of documents, not
the terms times the entities of a text. A document is a row; repeated
rows each get their own spans. Null texts have no spans and stay null. Rows with a null id count as documents and
get base spans only. Other columns pass through, whatever their names; ``find`` raises where the input has its
output columns already. Positions count code points; the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, lookup, named_apart, spread_join, stored, table

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds the leftmost longest matches of its contract in one pass: a match can only begin where a
# run of its characters does, or where the match before ended, and repetitions never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MIN_TEXTS = 3
DISCLOSURE = 0.5
MIN_BITS = 4.0
INNER = r"[\p{L}\p{M}\p{N}_-]"
#: What the corpus is searched for: two characters at least, a letter first; marks belong to their letters.
WORD = rf"\p{{L}}{INNER}+"
#: What can be a term: of two or three characters only what is written as a name, with no lower-case letter first.
TERM = rf"\p{{L}}{INNER}{{3,}}|(?<!{INNER})[\p{{Lu}}\p{{Lt}}\p{{Lo}}]{INNER}{{1,2}}"
#: Code points of a piece that a text is cut into, so that a place in it is found without counting from its start.
PIECE = 1_000
#: Begins the names of columns that are ours alone.
OWN = "__siltstone_pii_"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _filtered(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array: at each round values twice as far apart are added, so there are few rounds."""
    n = F.size(values)

    def far(acc: Column, k: Column) -> Column:
        return F.zip_with(acc, F.slice(F.concat(F.array_repeat(zero, F.pow(F.lit(2), k).cast("int")), acc), F.lit(1), n), add)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), values, far)


def _located(df: DataFrame, text: Column, kind: str, pattern: str, needs: Column, out: str) -> DataFrame:
    """Adds ``out``: the pattern's matches with their places, from the lengths of matches and of what stands between."""
    between, found, ends = (f"{OWN}{n}" for n in ("between", "found", "ends"))
    body = F.when(needs, text).otherwise(F.lit(""))
    df = df.withColumns({between: F.split(body, pattern, -1), found: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))})
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.length(b) + F.length(f))
    df = df.withColumn(ends, _running(lengths, F.lit(0), lambda x, y: x + y))
    spans = F.zip_with(found, ends, lambda f, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(f)).alias("start"), e.alias("end"), f.alias("value")))
    return df.withColumn(out, F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))).drop(between, found, ends)


def _rebuilt(df: DataFrame, text: str, spans: str, fill: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
    """Adds ``out``: the text with ``fill(span, at, reach)`` for the spans (sorted by start), ``at`` where spans before it end and ``reach`` where they and it do."""
    pieces, reach = f"{OWN}pieces", f"{OWN}reach"
    some = F.size(spans) > 0
    df = df.withColumns({pieces: F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), reach: F.when(some, _running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y)))})

    def cut(a: Column, b: Column) -> Column:
        first, last = (a / PIECE).cast("int"), ((b - 1) / PIECE).cast("int")
        return F.when(b > a, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), a % PIECE + 1, b - a)).otherwise(F.lit(""))

    ats = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
    marks = F.zip_with(F.zip_with(spans, ats, lambda s, at: F.struct(s.alias("s"), at.alias("at"))), reach, lambda x, r: F.struct(x["s"].alias("s"), x["at"].alias("at"), r.alias("r")))
    parts = F.transform(marks, lambda x: F.concat(cut(x["at"], x["s"]["start"]), fill(x["s"], x["at"], x["r"])))
    whole = F.concat(F.array_join(parts, ""), cut(F.element_at(reach, -1), F.length(text)))
    return df.withColumn(out, F.when(some, whole).otherwise(F.col(text))).drop(pieces, reach)


def _base(df: DataFrame, text: str, out: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    needs = {"email": body.contains("@"), "ip": body.rlike(r"[0-9]\.[0-9]"), "card": body.rlike("[0-9][0-9 -]{14}"), "phone": body.contains("+")}
    for kind in KINDS:
        df = _located(df, body, kind, PATTERNS[kind], needs[kind], f"{OWN}{kind}")
    every = F.concat(*(_filtered(f"{OWN}{kind}", kind) for kind in KINDS))
    return df.withColumn(out, every).drop(*(f"{OWN}{kind}" for kind in KINDS))


def base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds ``out``: the base spans by kind and then start."""
    named_apart(df, out)
    return _base(df, text, out)


def _by_start(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _bare(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text, base, bare): ``bare`` is the text with blanks for base spans, so places stay."""
    df = _base(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "base")
    blanks = lambda s, at, reach: F.repeat(F.lit(" "), reach - F.greatest(s["start"], at))
    return _rebuilt(df.withColumn("sorted", _by_start(F.col("base"))), "text", "sorted", blanks, "bare").drop("sorted")


def _words(pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all("bare", F.lit(pattern), F.lit(0)), F.lower))


def _held_terms(bare: DataFrame, terms: DataFrame) -> DataFrame:
    """(term) for each document that holds one of ``terms``; without the join that sheds the others where that isn't small."""
    words = bare.select(F.explode(_words(WORD)).alias("term"))
    return words.join(F.broadcast(terms), "term") if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else words


def _entity(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def _set_of(row: str) -> Column:
    """Tells sets of different rows apart: 128 bits."""
    return F.concat_ws(":", F.bit_xor(F.xxhash64(row)), F.bit_xor(F.xxhash64(row, F.lit(1))))


def _revealing(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of classes: (terms, entities, entities of terms) that exceed the threshold.

    Entities of the same documents are one class, and so are terms of the same documents, so a text of many terms
    and many entities is no product of them.
    """
    bare = _bare(df, id_col, text)
    source = F.xxhash64(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    # The documents with entities are few; their words are kept, so that the texts are not searched again for them.
    marked = stored(bare.where(F.size("base") > 0).select(F.monotonically_increasing_id().alias("row"), source.alias("source"), F.array_distinct(F.transform("base", _entity)).alias("entities"), _words(TERM).alias("terms")))
    each = marked.select("row", "source", F.explode("entities").alias("entity"))
    of_source = each.groupBy("entity", "source").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    entities = of_source.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("entity_docs"), F.concat_ws(":", F.bit_xor("x"), F.bit_xor("y")).alias("entity_class"))
    entities = stored(entities.where(F.col("texts") >= MIN_TEXTS).select("entity", "entity_class", "entity_docs", F.col("entity_docs").alias("n")))
    held = spread_join(each.select("row", "entity"), entities, "entity", "n")
    of_row = held.groupBy("row").agg(F.max("entity_docs").alias("most"), F.collect_set(F.struct("entity_class", "entity_docs")).alias("classes"))
    rows = stored(marked.select("row", "source", "terms").join(of_row, "row"))
    near = rows.select("row", "most", F.explode("terms").alias("term"))
    # No entity beside the term is in more documents than ``most``, and the term is in no fewer than here: what
    # this bound puts under the threshold is not counted over the corpus, and then the count is held to it too.
    bound = near.groupBy("term").agg(F.count(F.lit(1)).alias("least"), F.max("most").alias("most"), _set_of("row").alias("rows"))
    terms = stored(bound.where((F.col("least") >= MIN_TEXTS) & (F.col("most") >= DISCLOSURE * F.col("least"))))
    counts = _held_terms(bare, terms.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    terms = terms.join(counts, "term").where(F.col("most") >= DISCLOSURE * F.col("term_docs"))
    terms = stored(terms.select("term", F.concat_ws(":", "rows", "term_docs").alias("term_class"), "term_docs", "least"))
    total = df.count()
    of_class = lookup(near.select("row", "term"), terms, "term", "least").select("row", "term_class", "term_docs").distinct()
    pairs = of_class.join(rows.select("row", "source", "classes"), "row").select("term_class", "term_docs", "source", F.inline("classes"))
    pairs = pairs.where(F.col("entity_docs") >= DISCLOSURE * F.col("term_docs")).groupBy("term_class", "term_docs", "entity_class", "entity_docs", "source").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("term_class", "term_docs", "entity_class", "entity_docs").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("both"))
    given = F.col("both") / F.col("term_docs")
    strong = pairs.where((F.col("texts") >= MIN_TEXTS) & (given >= DISCLOSURE) & (F.log2(given * total / F.col("entity_docs")) >= MIN_BITS))
    return terms, entities, stored(strong)


def revealing_terms(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, entity, texts, both, term_docs, entity_docs) of what exceeds the threshold: every pair, so it may be large where ``find`` isn't."""
    terms, entities, strong = _revealing(df, id_col, text)
    pairs = strong.join(terms.select("term", "term_class"), "term_class").join(entities.select("entity", "entity_class"), "entity_class")
    return pairs.select("term", "entity", "texts", "both", "term_docs", "entity_docs")


def _small_lists(lists: DataFrame) -> DataFrame:
    """Marks (id, terms) for broadcast if all of it is small, counted in bytes."""
    size = lists.agg(F.sum(F.lit(64) + 32 * F.size("terms") + F.length(F.array_join("terms", "")))).first()[0] or 0
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def _found(df: DataFrame, id_col: str, text: str, base: str, extra: str) -> DataFrame:
    based = _base(df, text, base)
    terms, _, found = _revealing(df, id_col, text)
    strong = stored(terms.join(found.select("term_class").distinct(), "term_class").select("term", F.col("term_docs").alias("n")))
    if strong.isEmpty():
        return based.withColumn(extra, F.array().cast(_SPAN))
    words_of = _bare(df.where(F.col(id_col).isNotNull()), id_col, text).select("id", F.explode(_words(WORD)).alias("term"))
    holders = lookup(words_of, strong, "term", "n")
    lists = stored(holders.groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    key, terms, bare, words, spans = (f"{OWN}{n}" for n in ("id", "terms", "bare", "words", "sorted"))
    named = _small_lists(lists).select(F.col("id").alias(key), F.col("terms").alias(terms))
    joined = based.join(named, F.col(id_col) == F.col(key), "left").drop(key)
    held = F.col(terms).isNotNull()
    blanks = lambda s, at, reach: F.repeat(F.lit(" "), reach - F.greatest(s["start"], at))
    joined = joined.withColumn(spans, F.when(held, _by_start(F.col(base))).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    joined = _rebuilt(joined, text, spans, blanks, bare)
    joined = _located(joined, F.coalesce(F.col(bare), F.lit("")), "term", WORD, held, words)
    joined = joined.withColumn(extra, F.filter(words, lambda s: F.array_contains(F.col(terms), F.lower(s["value"]))))
    return joined.drop(terms, bare, words, spans)


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds base and extra: arrays of (kind, start, end, value); extra's kind is ``term``."""
    named_apart(df, "base", "extra")
    return _found(df, id_col, text, "base", "extra")


def sanitise(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets; of overlapping spans the first's kind stands for all."""
    base, extra, spans, clean = (f"{OWN}{n}" for n in ("base", "extra", "spans", "clean"))
    found = _found(df, id_col, text, base, extra)
    found = found.withColumn(spans, _by_start(F.concat(base, extra)))
    label = lambda s, at, reach: F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
    rebuilt = _rebuilt(found, text, spans, label, clean)
    return rebuilt.withColumn(text, F.col(clean)).select(*df.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "extra")).alias("spans"))
