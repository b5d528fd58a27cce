import hashlib
import math

import numpy as np
import pytest

from siltstone.llm import common, vector_codes
from siltstone.llm.common import table

NAN, INF = float("nan"), float("inf")


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain lists and loops over (id, vector, label), all of one length."""
    rows = [(i, [math.floor(scale * float(c)) for c in v], lab) for i, v, lab in rows if good(v)]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(rows[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
        k = min(range(len(far)), key=lambda k: (far[k], k))
        return k, far[k]

    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(parts):
                held[p][assign(p, c[p])[0]].append(c[p])
        for p in range(parts):
            for k, members in enumerate(held[p]):
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[assign(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(far for _, far in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(rows, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for k, _ in f), e, by_label[lab], sha) for (i, _, lab), f, e in zip(rows, found, errors)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def test_op12_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding", "label").collect()]
    assert got(vector_codes.op12_vector_codes(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_op12_odd_rows_ties_and_labels(spark, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(vector_codes, "SLICE", 7)
    rnd = np.random.default_rng(3)
    rows = [(int(k), [float(c) for c in rnd.integers(-2, 3, 32) / 256], ["a", "b", None][k % 3]) for k in rnd.permutation(150)]
    rows += rows[:5] + [(None, rows[7][1], "b"), (900, rows[3][1], "b")]
    bad = [(901, None, "a"), (902, [NAN] * 32, "a"), (903, [None] * 32, None), (904, [INF] * 32, "q")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS code", "2 AS id", "3 AS n", "4 AS x").repartition(6)
    assert got(vector_codes.compress(df)) == brute(rows)


def test_op12_few_vectors_other_lengths_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(k, [0.25 * k + j for j in range(16)], k % 2) for k in range(5)]
    other = [(100, [1.0] * 48, 1), (101, [], 7), (102, [1.0, 2.0], None)]
    found = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows + other, schema)).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert {i: (r["code"], r["error"], r["codebooks_sha256"]) for i, r in found.items() if i < 100} == {i: (r[1], r[2], r[4]) for i, r in want.items()}
    assert all(found[i]["code"] is None and found[i]["error"] is None for i in (100, 101, 102))
    assert found[100]["label_error"] == found[1]["label_error"] and found[101]["label_error"] is None
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r)[2:] for r in vector_codes.compress(spark.createDataFrame(other[1:], schema)).collect()] == [(None,) * 4] * 2


def test_op12_components_too_large(spark):
    df = spark.createDataFrame([(1, [1e300] * 16, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(df).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 16])
def test_nearest_is_exact_and_skips_most(size):
    rnd = np.random.default_rng(size)
    for spread in (2, 300, 1 << 20):
        x, book = rnd.integers(-spread, spread, (500, size)), rnd.integers(-spread, spread, (64, size))
        book[10] = book[40]
        far = ((x[:, None] - book) ** 2).sum(axis=2)
        entry, least, computed = vector_codes.nearest(x, book)
        assert entry.tolist() == far.argmin(axis=1).tolist() and least.tolist() == far.min(axis=1).tolist()
        if spread > 2 and size <= 4:
            assert computed < 0.45 * far.size
