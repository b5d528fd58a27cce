import random
import re

import pytest

from siltstone.llm import common, near_dedup


def brute(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + rnd.choice("qrstuvÄ")
    shared = [word() for _ in range(60)]
    base = [[word() for _ in range(rnd.randint(1, 80))] for _ in range(80)]
    texts = list(base)
    for k in range(160):  # near copies, some of copies: chains and one large group
        w = list(texts[0 if k < 80 else rnd.randrange(len(texts))])
        if k < 80:
            w = (base[0] * 80)[:80]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            w[rnd.randrange(len(w))] = word()
        texts.append(w)
    texts += [shared + [word() for _ in range(60)] for _ in range(40)]  # a passage that many hold
    texts += [["IT", "is"], ["it", "IS"], ["it", "is", "so"], ["x"] * 9, ["x"] * 30]
    ids = rnd.sample(range(1000), len(texts))
    return [(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in zip(ids, texts)]


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 5)])
def test_op9_against_brute_force(spark, seed, words):
    rows = made(seed) + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one" * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = sorted(map(tuple, near_dedup.near_duplicates(df, words).collect()))
    assert got == brute(rows, words)


def test_op9_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, near_dedup.op9_near_dedup(spark, sf).collect())) == brute(rows, 4)


def test_op9_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True)], key=str)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == ["doc_id", "text"] and kept.count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op9_rows_are_removed_by_their_own_text(spark):
    a, b, c = "a b c d e f", "one two three four five six", "A b  c d E f"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, b, 5), (3, c, 6), (8, None, 7), (8, None, 8), (None, a, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int")
    kept = near_dedup.deduplicate(df).collect()
    got = sorted((r.doc_id, r.text) for r in kept if r.doc_id and r.text)
    assert len(got) == 2 and got[0][0] == 3 and got[0][1] in (a, c) and got[1] == (5, b) and len(kept) == 5
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text")  # ids of another type
    judged = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(named).collect() if r.doc_id)
    assert judged == [("d3", "d3"), ("d3", "d3"), ("d5", "d3"), ("d5", "d5"), ("d5", "d5"), ("d7", "d5"), ("d8", "d8"), ("d8", "d8")]


@pytest.mark.parametrize("few", [True, False])
def test_components_of_paths_hubs_and_cycles(spark, few, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 200_000 if few else 1)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    links = [(k, k + 1) for k in range(100, 160)] + [(999, k) for k in range(200, 280)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = {r.id: r.label for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 200 for k in (*range(200, 280), 999)} | {k: 300 for k in (300, 301, 302)}


def test_spread_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 50), (3, 51), (4, 52)], "key int, x int")
    keyed = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (3, "c", 1)], "key int, name string, n int")
    assert sorted((r.key, r.name) for r in common.spread_join(rows, keyed, "key", "n").collect()) == [(1, "a")] * 50 + [(2, "b"), (3, "c")]
    assert common.spread_join(rows, keyed, "key", "n", "left").count() == 53
    assert common.spread_join(rows, keyed.limit(0), "key", "n").count() == 0


def test_op9_long_texts_and_large_hubs(spark, monkeypatch):
    """Sets beyond ``LONG`` take another way through the paths; a hub's set is copied in steps."""
    monkeypatch.setattr(near_dedup, "LONG", 20)
    monkeypatch.setattr(near_dedup, "STAR", 2)
    monkeypatch.setattr(near_dedup, "COPIES", 3)
    rnd = random.Random(12)
    long = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)]
    rows = [(k, " ".join([*long, f"end{k}"])) for k in range(60)] + [(100 + k, " ".join(f"x{rnd.randint(0, 10**6)}" for _ in range(50))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df, words=4).collect())) == brute(rows, 4)


def test_op9_a_text_beyond_the_bound(spark):
    words = [f"w{k * 7919 % 1_000_003}" for k in range(near_dedup.LONG + 20_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "another short text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(df, words=4).collect()))
    assert got == [(1, len(words) - 3, 1, True), (2, len(words) - 2, 1, False), (3, 3, 3, True)]


def test_the_sketches_drop_unlike_pairs_and_no_alike_one(spark):
    rnd = random.Random(8)
    sets, pairs = {}, []
    for k in range(0, 600, 2):
        n, kept_of = rnd.choice((1, 5, 30, 300, 3000)), rnd.choice((0.0, 0.5, 0.85, 0.89, 0.9, 1.0))
        own = [rnd.getrandbits(64) for _ in range(n)]
        sets[k], sets[k + 1] = own, own[: int(n * kept_of)] + [rnd.getrandbits(64) for _ in range(n - int(n * kept_of))]
        pairs.append((k, k + 1, 0))
    rows = [(c, len(s), near_dedup.sketch(near_dedup.np.array(s, near_dedup.np.uint64)).tolist()) for c, s in sets.items()]
    left = near_dedup._possible(spark.createDataFrame(pairs, "hub long, member long, tree int"), spark.createDataFrame(rows, "cid long, n long, sketch array<long>"), 80)
    found = {(r.hub, r.member) for r in left.collect()}
    share = {(a, b): (len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))) for a, b, _ in pairs}
    alike = {p for p, (common, every) in share.items() if 100 * common >= 80 * every}
    far = {p for p, (common, every) in share.items() if 2 * common < every and len(sets[p[0]]) <= 300}
    assert alike and far and alike <= found and not far & found
