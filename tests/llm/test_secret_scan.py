import base64
import hashlib
import random
import re
import time

import pytest
import zstandard

from siltstone.llm import secret_scan
from siltstone.llm.common import table


def plain_base(text):
    """The contract's patterns as they stand."""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append(("assign", m.start(), m.end()))
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def plain_extra(text, base, dictionary):
    """Every run at every place, judged by itself."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if len(dictionary) >= 8 else zstandard.ZstdCompressor(level=3, write_content_size=False)
    words = [m.end() for m in re.finditer("|".join(secret_scan.SENSITIVE), text, re.I | re.A)]
    found, at = [], 0
    while at < len(text):
        run = re.compile("[A-Za-z0-9+/_.=-]{16,}").match(text, at)
        near = [e for e in words if e <= at <= e + 48]
        if not near or not run:
            at += 1
            continue
        a, b = run.span()
        at = b
        value = text[a:b]
        if any(s < b and a < e for _, s, e in base) or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
            continue
        around = (text[max(0, a - 512) : a] + " " + text[b : b + 512]).replace(value, "").encode()
        if (len(press.compress(around + value.encode())) - len(press.compress(around))) / len(value) >= secret_scan.NOVEL:
            found.append(("novel", a, b))
    return found


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def want(rows, dictionary):
    out = []
    for i, text in rows:
        base = plain_base(text or "")
        extra = plain_extra(text or "", base, dictionary)
        every = sorted(base + extra, key=lambda s: (s[1], ("assign", "access", "hex", "novel").index(s[0])))
        out.append((i, *(sum(s[0] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
    return sorted(out, key=str)


def test_op13_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    dictionary = secret_scan.identifiers(table(spark, "/root/testdata/sf0.01", "documents"))
    assert 20_000 < len(dictionary) <= secret_scan.DICTIONARY
    got = sorted(map(tuple, secret_scan.op13_secret_scan(spark, "/root/testdata/sf0.01").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()), key=str)
    assert got == want(rows, dictionary)
    assert sum(r[1] for r in got) > 10


def odd():
    rnd = random.Random(11)
    secret = lambda n: base64.b64encode(rnd.randbytes(n)).decode()
    pieces = ["token", "Token ", "SECRET = ", "api_key:'", 'apikey"   :', "passwd=", "password", " key ", "AKIA", "AKIA" + "B7" * 9, "0123456789abcdef" * 2, "deadbeef", "ſecret=abcdefgh", "toKen=abcdefgh", "é", "\U0001f600", "\n", "=", ":", " ", "'", "bearer ", "x" * 40, "the_name_of_the_thing_1", "wörter "]
    made = ["".join(rnd.choice([*pieces, secret(15), secret(24), secret(4)]) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    return [(k, t) for k, t in enumerate(made)] + [(900, None), (901, ""), (None, "token = abcdef"), (None, "token = abcde"), (903, "token = abcdef")] * 2


@pytest.mark.parametrize("dictionary", [b"", b"the_name_of_the_thing " * 20])
def test_op13_odd_rows(spark, dictionary):
    rows = odd()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, value int")
    found = secret_scan.find(df, dictionary=dictionary).collect()
    got = sorted(((r["doc_id"], r["text"], [tuple(s)[:3] for s in r["base"]], [tuple(s)[:3] for s in r["extra"]]) for r in found), key=str)
    assert got == sorted(((i, t, b := plain_base(t or ""), plain_extra(t or "", b, dictionary)) for i, t in rows), key=str)
    assert all(r["text"][s["start"] : s["end"]] == s["value"] for r in found for s in r["base"] + r["extra"])
    assert any(r["extra"] for r in found)


def test_op13_novelty_tells_secrets_from_names(spark):
    rnd = random.Random(2)
    words = "connection retry timeout handler session parser buffer index config request response stream worker client server module logger metrics".split()
    code = lambda n: "\n".join(f"    {rnd.choice(words)}_{rnd.choice(words)} = self.{rnd.choice(words)}.{rnd.choice(words)}({rnd.randint(0, 99)})" for _ in range(n))
    name = lambda: "_".join(rnd.choice(words) for _ in range(4)) + "_2"
    rows = [(k, f"{code(20)}\n# the private key {base64.b64encode(rnd.randbytes(30)).decode().strip('=')}9\n{code(20)}") for k in range(100)]
    rows += [(k, f"{code(20)}\n# the private key {name()}\n{code(20)}") for k in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hit = {r["doc_id"] for r in secret_scan.find(df).where("size(extra) > 0").collect()}
    assert len([i for i in hit if i < 100]) >= 95 and len([i for i in hit if i >= 100]) <= 5


def test_op13_empty_table_long_texts_and_clashes(spark):
    assert secret_scan.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    began = time.perf_counter()
    long = ["token" * 200_000, "key" * 300_000, "secret " * 100_000 + " " * 300_000, "a1" * 500_000, "AKIA" * 200_000, "token = " + "f0" * 400_000, "key a1b2c3d4e5f6g7h8 " * 2_000]
    found = secret_scan.find(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), dictionary=b"").collect()
    assert len(found) == len(long) and time.perf_counter() - began < 60
    assert {(s["kind"], s["end"] - s["start"]) for r in found if r["doc_id"] == 5 for s in r["base"]} == {("assign", 800_008), ("hex", 800_000)}
    with pytest.raises(ValueError, match="base"):
        secret_scan.find(spark.createDataFrame([("x", 1)], "text string, base int"))
