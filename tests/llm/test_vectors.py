import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import embedding_dedup, topk

NAN, INF = float("nan"), float("inf")


def brute_links(rows, threshold=0.95):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, links[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def planted(seed, dims=16):
    rnd = np.random.default_rng(seed)
    rows = [rnd.standard_normal(dims) for _ in range(300)]
    rows += [rows[k % 7] + rnd.standard_normal(dims) * 0.05 for k in range(60)]
    rows += [rows[3]] * 30 + [2 * rows[4]] * 2
    ids = rnd.permutation(len(rows)) * 3
    return [(int(i), [float(c) for c in v]) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_op6_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "CODES", 16)
    rows = planted(seed) + [(9001, None), (9002, [0.0] * 16), (9003, [NAN] * 16), (9004, [None, 1.0]), (9005, [INF]), (9006, []), (9007, [1.0, 2.0]), (9008, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, digest string")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    assert got == brute_links(rows)


def fast_links(x, threshold=0.95):
    """Links of each row, and the smallest row reachable, by brute force in blocks."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, label = np.zeros(len(x), int), np.arange(len(x))
    pairs = []
    for k in range(0, len(x), 1000):
        a, b = np.nonzero(u[k : k + 1000] @ u.T >= threshold)
        pairs.append(np.stack([a + k, b])[:, a + k != b])
    a, b = np.concatenate(pairs, axis=1)
    np.add.at(links, a, 1)
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        if (lower == label).all():
            return links, label
        label = lower


def recall_on(spark, x):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    want, label = fast_links(x.astype(np.float32).astype(float))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df.repartition(4)).collect()))
    assert [g[0] for g in got] == list(range(len(x)))
    assert all(g[1] <= w for g, w in zip(got, want)) and all(g[2] >= c for g, c in zip(got, label))
    assert all(g[3] == (g[2] == g[0]) for g in got)
    return sum(g[1] for g in got) / want.sum(), int(want.sum())


def crowd(seed, dims, offset, cosine=0.955, rows=2000):
    """Rows about a common mean, each with a partner just over the threshold."""
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((rows, dims)) + offset
    u = rnd.standard_normal((rows, dims))
    u -= (u * x).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x
    u *= np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(u, axis=1, keepdims=True)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * u])


@pytest.mark.parametrize("offset,most", [(0, 0.01), (1, 0.01), (1.5, 0.05), (2, 0.05)])
def test_op6_plan_leaves_out_most_random_pairs(offset, most):
    x = np.random.default_rng(3).standard_normal((8192, 64)) + offset
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = embedding_dedup.plan_tables(x[:4096], 50_000, 0.95)
    keys, codes = plan.keys(x[4096:]), plan.codes(x[4096:])
    met = (keys[::2] == keys[1::2]).any(axis=1) & (np.bitwise_count(codes[::2] ^ codes[1::2]).sum(axis=1, dtype=int) <= plan.radius)
    assert met.mean() <= most and not plan.dense


def test_op6_plan_of_vectors_within_the_threshold_of_their_mean():
    x = np.random.default_rng(3).standard_normal((4096, 64)) + 3
    assert embedding_dedup.plan_tables(x / np.linalg.norm(x, axis=1, keepdims=True), 50_000, 0.95).dense


@pytest.mark.parametrize("offset", [1.5, 2, 3])
def test_op6_hubs_near_the_common_mean(spark, offset, monkeypatch):
    """Three vectors near the mean come last, link with many and aren't in the sample."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 1500)
    rnd = np.random.default_rng(17)
    x = np.concatenate([crowd(18, 64, offset), offset + 0.35 * rnd.standard_normal((3, 64))])
    recall, links = recall_on(spark, x)
    assert recall >= 0.99 and links >= (8000 if offset == 3 else 4000)


@pytest.mark.parametrize("dims,offset", [(64, 0), (64, 3), (64, 1), (12, 0), (128, 0.5)])
def test_op6_recall_against_brute_force(spark, dims, offset):
    recall, links = recall_on(spark, crowd(dims, dims, offset))
    assert recall >= 0.99 and links >= 4000


def test_op6_recall_in_clusters(spark):
    rnd = np.random.default_rng(21)
    centers = rnd.standard_normal((40, 48)) * np.linspace(3, 0.2, 48)
    x = centers[rnd.integers(40, size=3000) ** 2 // 40] + rnd.standard_normal((3000, 48)) * 0.35
    recall, links = recall_on(spark, x)
    assert recall >= 0.99 and links >= 10_000


def test_op6_whole_table_with_planted_links(spark, tmp_path):
    """The table has no links of its own; a copy of it gets some."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    rnd = np.random.default_rng(4)
    noise = rnd.standard_normal(x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(x.shape[1])
    x = np.concatenate([x, x + 0.3 * noise, x[:100] * 2, np.repeat(x[:1], 300, axis=0) + 0.1 * rnd.standard_normal((300, x.shape[1])) * np.linalg.norm(x[0]) / 8])
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    want, label = fast_links(x.astype(np.float32).astype(float))
    got = sorted(map(tuple, embedding_dedup.op6_embedding_dedup(spark, str(tmp_path)).collect()))
    assert len(got) == len(x) and sum(g[1] for g in got) >= 0.99 * want.sum() and want.sum() > 10_000
    assert all(g[1] <= w for g, w in zip(got, want)) and np.mean([g[2] == c for g, c in zip(got, label)]) > 0.99
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_op6_one_id_with_several_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("b", [0.0, 1.0]), ("c", [0.0, 1.0]), ("c", None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([("a", 1, "a", True), ("b", 1, "a", False), ("b", 1, "b", True), ("c", 1, "b", False), ("c", 0, "c", True), (None, 0, None, True)], key=str)


def pairs_of(seed, cosine, pairs, dims=64):
    """Rows 2k and 2k + 1 are at the cosine; all else is far apart."""
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((pairs, dims))
    u = rnd.standard_normal((pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.stack([x, cosine * x + np.sqrt(1 - cosine**2) * u], axis=1).reshape(2 * pairs, dims)


@pytest.mark.parametrize("classes,offset", [(2_000, 0), (100_000, 0), (1_000_000, 0), (10_000_000, 0), (1_000_000, 0.2)])
def test_op6_plan_holds_recall_as_tables_grow(classes, offset):
    sample = np.random.default_rng(5).standard_normal((4096, 64)) / 8 + offset
    plan = embedding_dedup.plan_tables(sample / np.linalg.norm(sample, axis=1, keepdims=True), classes, 0.95)
    x = pairs_of(6, 0.95, 4000)
    keys, codes = plan.keys(x), plan.codes(x)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    near = np.bitwise_count(codes[::2] ^ codes[1::2]).sum(axis=1, dtype=int) <= plan.radius
    assert (plan.keys_of(codes) == keys).all()
    assert (met & near).mean() >= 0.985 and (plan.radius < plan.width * plan.tables / 4 or offset)
    assert plan.width == embedding_dedup.window_width(classes) or offset


def test_op6_recall_at_the_width_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "window_width", lambda classes: 21)
    x = pairs_of(8, 0.9501, 400)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).collect()
    assert all(r.n_links <= 1 and r.component_id in (r.vec_id, r.vec_id - r.vec_id % 2) for r in got)
    assert sum(r.n_links for r in got) >= 0.98 * len(x)


@pytest.mark.parametrize("dims", [8, 16])
def test_op6_short_vectors(spark, dims):
    x = pairs_of(9, 0.955, 300, dims)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).collect()
    want = {i: n for i, n, _, _ in brute_links(rows)}
    assert all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.985 * sum(want.values())


def test_op6_rare_lengths_do_not_touch_others(spark):
    x = pairs_of(10, 0.9501, 300)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, [1.0, 0.1]), (5001, [1.0, 0.0]), (5002, [0.0, 1.0]), (5003, [3.0]), (5004, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert [(got[k].n_links, got[k].component_id) for k in range(5000, 5005)] == [(1, 5000), (1, 5000), (0, 5002), (1, 5003), (1, 5003)]
    assert sum(got[k].n_links for k in range(len(x))) >= 0.98 * len(x)


def brute_top(rows, asked, k=10):
    ints = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, v in ints:
        if q in asked:
            found = sorted((-int(v @ x), i) for i, x in ints if i != q and len(x) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_op8_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, topk.op8_topk(spark, sf).collect()))
    assert got == brute_top(rows, {i for i, _ in rows if i % 100 == 0})


def test_op8_odd_rows_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "ROW_BLOCK", 25)
    monkeypatch.setattr(topk, "STEP", 3)
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rnd.standard_normal(4), 1)]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(15)] + [(200, None), (201, [NAN] * 4), (202, [None] * 4), (203, [1.0] * 3), (300, [2.0] * 3), (400, [0.0] * 4), (None, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    asked = [0, 7, 100, 200, 300, 400]
    got = sorted(map(tuple, topk.top_k(df, df.where(df.vec_id.isin(asked))).collect()))
    assert got == brute_top(rows, asked)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_op8_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, df).collect()


def test_op8_ids_of_any_type(spark):
    rnd = np.random.default_rng(8)
    x = [[float(c) for c in rnd.integers(-3, 4, 8) / 8] for _ in range(300)]
    name = lambda k: f"{'zab'[k % 3]}{k * 7919 % 1000}"
    order = sorted(range(300), key=name)
    place = {k: n for n, k in enumerate(order)}
    df = spark.createDataFrame([(name(k), v) for k, v in enumerate(x)] + [(None, x[0]), ("none", None)], "vec_id string, embedding array<double>").repartition(5)
    numbered = spark.createDataFrame([(place[k], v) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id LIKE '%1'")).collect()
    want = topk.top_k(numbered, numbered.where(F.col("vec_id").isin([place[k] for k in range(300) if name(k).endswith("1")]))).collect()
    assert sorted(map(tuple, got)) == sorted((name(order[r.query_id]), r.rank, name(order[r.vec_id]), r.score) for r in want) and len(got) > 200
