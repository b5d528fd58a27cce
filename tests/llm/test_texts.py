import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, line_dedup, pii

SF = "/root/testdata/sf0.01"
WS = " \t\n\x0b\x0c\r"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def brute_lines(rows, chars=20, docs=3):
    key = lambda line: "".join(c.lower() if c < "\x80" else c for c in line.strip(WS))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if i is None or len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_op4_whole_table(spark):
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(documents(spark))]
    assert sorted(map(tuple, line_dedup.op4_line_dedup(spark, SF).collect()), key=str) == want
    assert sum(w[2] for w in want) > 100


def test_op4_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", 2)
    line, other = "  The Same Line, Twenty or More ", "ÄÖÜ" * 7
    rows = [(1, line), (2, line.upper() + "\nx\n" + line), (3, "\t" + line.lower() + "\r\n" + other), (4, other), (5, other + "\n" + "short"), (6, "short"), (7, "short")]
    rows += [(8, None), (9, ""), (10, "\n\n"), (None, line), (None, line), (11, "a" * 100_000 + "\n" + line), (4, other), (12, "nineteen code point"), (13, "nineteen code point"), (14, "nineteen code point")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, digest string")
    got = line_dedup.deduplicate(df)
    assert got.columns == ["doc_id", "text", "digest", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


def test_filter_full_of_lines_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "filter_bits", lambda lines: 1024)
    monkeypatch.setattr(line_dedup, "SEGMENTS", 16)
    rows = [(k, f"line number {k % 90} of many\nall of them hold this one") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.deduplicate(df).collect()), key=str)
    assert got == brute_lines(rows)


def test_filters_follow_the_lines():
    assert line_dedup.filter_bits(0) == 1 << 20 and line_dedup.filter_bits(10**6) == 1 << 24 and line_dedup.filter_bits(10**12) == 1 << 32


def test_op4_columns_of_the_outputs_names(spark):
    df = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, n_lines int")
    with pytest.raises(ValueError):
        line_dedup.deduplicate(df)
    assert line_dedup.deduplicate(df, counts=("lines", "dropped")).first().n_lines == 7


NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found(df):
    return {(r.doc_id, r.text): [(s.kind, s.start, s.end) for s in r.base] for r in df.collect()}


def test_op5_whole_table(spark):
    got = {r.doc_id: r for r in pii.op5_pii(spark, SF).collect()}
    rows = documents(spark)
    assert len(got) == len(rows)
    kinds = dict.fromkeys(NAIVE, 0)
    for i, text in rows:
        spans = brute_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, spans)
        assert got[i].spans.startswith(listed)
        for kind in NAIVE:
            kinds[kind] += got[i][f"n_{kind}"]
            assert got[i][f"n_{kind}"] == sum(s[0] == kind for s in spans)
    assert min(kinds.values()) > 0


def test_op5_base_on_random_texts(spark):
    rnd = random.Random(11)
    pools = ["a.@-b_ ", "01.25 ", "4 -1", "+1 ()-.9x", "a@b.c1+2 -😀é"]
    texts = ["".join(rnd.choices(pools[k % 5], k=rnd.randint(0, 60))) for k in range(3000)]
    texts += [None, "", "x@y.z", "4111 1111 1111 1111", "a4111-1111-1111-1111b", "1.2.3.4.5.6.7.8", "0256.1.1.1 0255.1.1.1", "a@b.c@d.e", "a@b.c_d@e.f", "+1 (555) 010-9999", "😀 x@y.zz", "9" * 50_000, "a" * 50_000, "1." * 20_000, "x@" + "y." * 20_000 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(pii.base_spans(df))
    for k, text in enumerate(texts):
        assert got[(k, text)] == brute_spans(text), repr(text[:80])


def test_op5_revealing_terms_and_sanitising(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [(k, f"{word()} {word()} Zorblatt {word()} mail zb@example.org now {word()} and {word()} thanks") for k in range(6)]
    rows += [(k, f"{word()} zorblatt {word()}") for k in range(6, 9)]
    rows += [(k, f"{word()} {word()} mail {word()}@example.org now {word()} thanks {word()}") for k in range(9, 60)]
    rows += [(60 + k, "copied Quimby text mail qq@example.org now") for k in range(20)]
    rows += [(1000 + k, f"{word()} {word()}") for k in range(300)] + [(100, None), (101, ""), (None, "zorblatt zb@example.org")]
    df = spark.createDataFrame([(i, t, 5, "e") for i, t in rows], "doc_id long, text string, n_email int, entity string")
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    for r in got:
        terms = {s.value.lower() for s in r.extra}
        assert terms == ({"zorblatt"} if r.doc_id is not None and r.doc_id < 9 else set()), (r.doc_id, terms)
        assert all(s.kind == "term" and r.text[s.start : s.end] == s.value for s in r.extra)
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns
    assert "[TERM]" in clean[0].text and "[EMAIL]" in clean[0].text and "zb@" not in clean[0].text
    assert clean[0].text == re.sub("Zorblatt", "[TERM]", dict(rows)[0].replace("zb@example.org", "[EMAIL]"))
    assert clean[7].text.split()[1] == "[TERM]" and clean[61].text == "copied Quimby text mail [EMAIL] now"
    assert clean[100].text is None and clean[101].text == "" and clean[None].text == "zorblatt [EMAIL]"
    assert pii.find(df.limit(0)).count() == 0


def revealed(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {s.value.lower() for r in pii.find(df).collect() for s in r.extra}


def test_op5_copies_count_once_and_never_against_a_term(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [f"{word()} {word()} Zorblatt {word()} mail zb@example.org now {word()}" for _ in range(50)]
    rows += ["copied Zorblatt text mail zb@example.org now"] * 500 + ["COPIED  Zorblatt text mail zb@example.org now "] * 500
    rows += ["other Quimby text mail qq@example.org now", "other  quimby text mail qq@example.org now"] * 200
    rows += [f"{word()} mail now {word()}" for _ in range(20_000)]
    assert revealed(spark, rows) == {"zorblatt"}


def test_op5_fixed_signature_in_different_texts(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = [" ".join(word() for _ in range(30)) + "\nKind Regards, Jane Zorblatt jane@example.org or thus" for _ in range(100)]
    rows += [f"{word()} kind regards or thus {word()}" for _ in range(3000)]
    assert revealed(spark, rows) == {"jane", "zorblatt"}


def test_op5_short_terms_and_terms_at_the_ends(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("bcdfghjklm", k=9))
    rows = [f"{word()} {word()} mail jane@example.org Zorblatt" for _ in range(5)]
    rows += [f"{word()} Lee mail lee@example.org {word()}" for _ in range(5)]
    rows += [f"{word()} नेहा mail neha@example.org {word()} Li and 王芳" for _ in range(5)]
    # words far from the entity are evidence too
    rows += [f"{word()} cutoff Edgeone {'. ' * 43}. far@example.org{' .' * 44} Edgetwo cutoff {word()}" for _ in range(5)]
    rows += [f"{word()} mail now {word()}" for _ in range(400)]
    assert revealed(spark, rows) == {"zorblatt", "lee", "नेहा", "li", "王芳", "cutoff", "edgeone", "edgetwo"}


@pytest.mark.parametrize("text,want", [("+49 30 1234567 and 1.2.3.4", "[PHONE] and [IP]"), ("+4111 1111 1111 1111 x", "+[CARD] x")])
def test_sanitised(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitise(df).select(F.first("text")).first()[0] == want


def test_op5_is_linear_in_a_texts_spans(spark):
    many = " ".join(f"user{k}@mail{k % 7}.example.org" for k in range(200_000))
    df = spark.createDataFrame([(1, many), (2, "ü😀 a@b.c " * 3), (3, None)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 200_000) and clean[2] == "ü😀 [EMAIL] " * 3 and clean[3] is None


def test_op5_many_terms_beside_many_entities(spark):
    n = 15_000
    many = " ".join(f"Name{k}x user{k}@mail.example.org" for k in range(n))
    rows = [(k, f"{many} Closing{k}") for k in range(3)] + [(10 + k, f"other words of text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n, r.terms) for r in pii.find(df).select("doc_id", F.size("base").alias("n"), F.size("extra").alias("terms")).collect()}
    assert time.perf_counter() - began < 60
    assert all(got[k] == (n, n) for k in range(3)) and all(got[10 + k] == (0, 0) for k in range(200))


def test_op5_columns_of_clashing_names(spark):
    names = ["base", "extra", "spans", "terms", "bare", "between", "id", "entity"]
    df = spark.createDataFrame([(k, f"mail a{k}@b.org or 1.2.3.4", *names) for k in range(4)], ["doc_id", "text", *names])
    got = pii.sanitise(df).collect()
    assert pii.sanitise(df).columns == df.columns
    assert all(r[2:] == tuple(names) and r.text == "mail [EMAIL] or [IP]" for r in got)
    with pytest.raises(ValueError):
        pii.find(df)


def brute_terms(rows):
    """(term, entity) by counting, naively, over all documents."""
    import math
    from collections import defaultdict

    held, of_term, of_entity, terms_in = defaultdict(set), defaultdict(set), defaultdict(set), []
    letters = re.compile(r"[^\W\d_][\w-]+")
    source = []
    for k, (_, text) in enumerate(rows):
        text = text or ""
        bare = list(text)
        entities = set()
        for kind, a, b in brute_spans(text):
            bare[a:b] = " " * (b - a)
            entities.add(f"{kind}:{text[a:b].lower()}")
        bare = "".join(bare)
        source.append(" ".join(text.split()).lower())
        words = [m[0] for m in letters.finditer(bare)]
        for w in words:
            of_term[w.lower()].add(k)
        for e in entities:
            of_entity[e].add(k)
            for w in words:
                if len(w) > 3 or not w[0].islower():
                    held[w.lower(), e].add(k)
    out = set()
    for (w, e), both in held.items():
        given = len(both) / len(of_term[w])
        if len({source[k] for k in both}) >= 3 and given >= 0.5 and math.log2(given * len(rows) / len(of_entity[e])) >= 4:
            out.add((w, e))
    return out


def test_op5_terms_against_naive_counts_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(9)
    rows = documents(spark)
    rows += [(10**6 + k, f"{rnd.choice(rows)[1] or ''}\nwritten by Quentin{k % 5} for desk{k % 5}@example.org") for k in range(30)]
    df = spark.createDataFrame(rows, docs.schema)
    got = {(r.term, r.entity) for r in pii.revealing_terms(df).collect()}
    assert got == brute_terms(rows) and {(f"quentin{k}", f"email:desk{k}@example.org") for k in range(5)} <= got


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklm", k=8))
    rows = [(k, f"{word()} Zorblatt {word()} zb@example.org\nthe same line in all of them\n{word() * 3 if k % 4 else 'a line in a quarter of them'}") for k in range(40)]
    rows += [(100 + k, f"{word()} {word()}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.deduplicate(df).collect()), key=str) == brute_lines(rows)
    assert {(r.term, r.entity) for r in pii.revealing_terms(df).collect()} == brute_terms(rows) >= {("zorblatt", "email:zb@example.org")}
    assert all("[TERM]" in r.text and "Zorblatt" not in r.text for r in pii.sanitise(df.where("doc_id < 100").unionByName(df.where("doc_id >= 100"))).where("doc_id < 100").collect())
