import base64
import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from siltstone.llm import byte_bpe, packing, sharding, token_counts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\n\n", "İstanbul ΣΑΣ", "don't <|endoftext|> stop", "x\x1cy z", "日本語 テスト", "word" * 500, "é ́", "a" * 3000]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_rows(spark):
    rows = [(k, x, "s") for k, x in enumerate(ODD)] + [(1, "", "s"), (None, "no id", None), (3, "a", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_codec_equals_library(tik):
    codec = byte_bpe.codec(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rnd = random.Random(5)
    for alphabet in ("ab", "abcdefgh", "aeiou thn", " \n\tab", "019 x", "éß日😀 a", "'s't re'll don", "=-_*#"):
        for _ in range(1500):
            text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
            ids = codec.encode(text).tolist()
            assert ids == tik.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_op1_whole_table_and_odd_rows(spark, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op1_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tik.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = byte_bpe.decode(byte_bpe.encode(odd_rows(spark), ranks, P.PATTERN), ranks, P.PATTERN).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert r.token_ids == tik.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    empty = byte_bpe.encode(odd_rows(spark).limit(0), ranks, P.PATTERN)
    assert empty.count() == 0 and empty.columns[-1] == "token_ids"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_op2_counts_and_cache(spark, tmp_path, name):
    cache = str(tmp_path / "cache")
    got = token_counts.token_counts(odd_rows(spark), P.path(name), cache).collect()
    assert len(got) == len(ODD) + 3
    count = token_counts._counter(*token_counts.read_tokenizer(P.path(name)))
    for r in got:
        assert r.n_tokens == count([r.text or ""])[0] and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 1024)
    held = spark.read.parquet(cache).count()
    assert held == len({x or "" for x in ODD} | {"no id"})
    again = token_counts.token_counts(odd_rows(spark).where("doc_id < 3"), P.path(name), cache)
    assert again.count() == 4 and spark.read.parquet(cache).count() == held
    assert token_counts.token_counts(odd_rows(spark).limit(0), P.path(name)).count() == 0


def test_op2_whole_table(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, SF).collect()}
    assert got == {k: len(tokenizer.encode(x or "", add_special_tokens=False)) for k, x in texts.items()}


def check_pieces(rows, texts, padding):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
    assert 1 - total / (2048 * len(by_sequence)) < padding


def test_op3_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    check_pieces(packing.op3_packing(spark, "/root/testdata/sf0.01").collect(), texts, 0.03)


def test_op3_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = odd_rows(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in rows.collect()}
    packed = packing.pack(rows, P.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(packed.collect(), texts, 1)
    assert packing.pack(rows.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_word_encoder_equals_library():
    encoder = packing.WordEncoder(token_counts.read_tokenizer(P.path("word_bpe_49k.json"))[1])
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [f"a{chr(i)} {chr(i)}b. {chr(i)}, x{chr(i)}{chr(i)}y c" for i in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x11000)]]
    for text, (ids, _) in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_windows_are_optimal():
    rnd = random.Random(3)
    for _ in range(300):
        at = np.cumsum([0, *(rnd.randint(1, 6) for _ in range(rnd.randint(1, 7)))])
        cost = np.array([rnd.randint(0, 5) for _ in at])
        cuts = packing.windows(at, cost, 8)
        value = lambda c: sum(8 - (at[j] - at[i]) + cost[j] for i, j in zip(c, c[1:]))
        inner = range(1, len(at) - 1)
        best = min(
            value(c)
            for k in range(len(at))
            for chosen in combinations_with_replacement(inner, k)
            if len(set(chosen)) == k
            for c in [[0, *chosen, len(at) - 1]]
            if all(at[j] - at[i] <= 8 for i, j in zip(c, c[1:]))
        )
        assert value(cuts) == best


def test_op7_matches_turns_taken_by_hand(spark):
    names, slots = ("a", "b", "c"), 13
    orders = []
    for n in names:
        d = hashlib.blake2b(n.encode(), digest_size=16).digest()
        first, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        orders.append([(first + k * step) % slots for k in range(slots)])
    taken = {}
    while len(taken) < slots:
        for k, order in enumerate(orders):
            if len(taken) < slots:
                taken[next(s for s in order if s not in taken)] = k
    assert sharding.lookup(names, slots) == [taken[s] for s in range(slots)]
    full = sharding.lookup(sharding.SHARDS)
    counts = np.bincount(full)
    assert len(counts) == len(sharding.SHARDS) and counts.max() - counts.min() <= 1
    fewer = sharding.lookup(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * len(full)
    rows = sharding.op7_sharding(spark, SF).collect()
    assert len(rows) == 200 and all(full[r.slot] == r.shard and r.shard_name == sharding.SHARDS[r.shard] for r in rows)
    assert sharding.place(odd_rows(spark)).count() == len(ODD) + 3 and sharding.place(odd_rows(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup(("a", "a"))


def test_op2_cache_of_another_kind_is_no_empty_cache(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception, match="parquet|Parquet"):
        token_counts.token_counts(odd_rows(spark), P.path("byte_bpe_50k.json"), str(tmp_path / "cache")).collect()


def test_op2_encodes_each_text_once_and_only_what_is_missing(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    encode = token_counts._encode

    def counted(rows, kind, content):
        seen.add(rows.count())
        return encode(rows, kind, content)

    monkeypatch.setattr(token_counts, "_encode", counted)
    cache, path = str(tmp_path / "counts"), P.path("byte_bpe_50k.json")
    rows = [(k, f"text {k % 7}", 1) for k in range(300)] + [(None, "no id", 2), (None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    assert token_counts.token_counts(df, path, cache).where("n_tokens > 0").count() == 302
    assert seen.value in (8, 9)
    more = df.unionByName(spark.createDataFrame([(900, "a new one", 0), (901, "a new one", 0)], df.schema))
    before = seen.value
    assert token_counts.token_counts(more, path, cache).count() == 304 and seen.value == before + 1
    again = token_counts.token_counts(more, path, cache, keep_text=False)
    assert again.columns == ["doc_id", "n_lines", "n_bytes", "n_tokens", "over_limit"] and seen.value == before + 1
    whole = token_counts.token_counts(more, path, cache).select(*again.columns)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_columns_of_the_outputs_names_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 2, 3, 4)], "doc_id long, text string, token_ids int, n_tokens int, shard int")
    path = P.path("byte_bpe_50k.json")
    for call in (lambda: byte_bpe.encode(df, b"", P.PATTERN), lambda: token_counts.token_counts(df, path), lambda: sharding.place(df)):
        with pytest.raises(ValueError, match="names"):
            call()
