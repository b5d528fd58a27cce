import math
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    p = labels == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    scores, labels = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    predicted = np.array([r.predicted for r in rows])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert ((scores >= 0) & (scores <= 1)).all() and ((scores >= 0.3) == (predicted == 1)).all()
    assert area(scores, labels) > 0.95
    assert predicted[labels == 1].mean() > 0.85 and predicted[labels == 0].mean() < 0.01


def test_op10_odd_rows(spark):
    texts = [None, "", "   ", "a vile word here", "a fine word here", "###", "word " * 20000]
    docs = spark.createDataFrame([(k, x, "s") for k, x in enumerate(texts)] + [(None, "vile", "s"), (3, "a vile word here", "s")], "doc_id long, text string, label string")
    model = toxicity.fit(docs, spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model)
    assert got.count() == 9 and got.columns == ["doc_id", "text", "label", "score"]
    assert got.where(F.col("score").isNull()).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_training_finds_the_telling_word():
    rnd = np.random.default_rng(0)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rnd.choice(words, 30)) for _ in range(600)]
    labels = np.array([float(k % 5 == 0) for k in range(600)])
    texts = [t + " vile!" if y else t for t, y in zip(texts, labels)]
    keys, weights, bias = toxicity.train([np.unique(toxicity.features(t)) for t in texts], labels)
    vile = toxicity.features("vile")[0]
    assert weights[keys == vile][0] == weights.max() and bias < 0
    assert len(keys) < 60


def naive_model(rows):
    """FTRL-proximal by the book, feature by feature, over words themselves instead of hashes."""
    rate = sum(y for _, y in rows) / len(rows)
    z, n, bias, bias_n = {}, {}, math.log(rate / (1 - rate)), 1.0

    def weight(f):
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zf) <= toxicity.L1 else (math.copysign(toxicity.L1, zf) - zf) / ((toxicity.BETA + math.sqrt(nf)) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            found, y = rows[k]
            g = 1 / (1 + math.exp(-max(-40, min(40, sum(map(weight, found)) + bias)))) - y
            g *= toxicity.TOXIC_WEIGHT if y else 1
            for f in found:
                w, nf = weight(f), n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(nf + g * g) - math.sqrt(nf)) / toxicity.ALPHA * w
                n[f] = nf + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
    return {f: weight(f) for f in z if weight(f)}, bias


def naive_features(text):
    w = [x.strip(string.punctuation) for x in (text or "").lower().split()]
    return {(x,) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, *p) for p in zip(w, w[2:])}


def test_op10_against_a_naive_model_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.toxic is not None and r.doc_id in texts:
            toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    rows = [(naive_features(texts[i]), toxic[i]) for i in sorted(toxic, key=str)]
    weights, bias = naive_model(rows)
    got = toxicity.op10_toxicity(spark, sf).collect()
    assert len(got) == len(texts) and weights
    for r in got:
        x = sum(weights.get(f, 0.0) for f in naive_features(texts[r.doc_id])) + bias
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, x))))) < 1e-6, r.doc_id


def test_only_words_pairs_and_skips_are_features():
    assert len(toxicity.features("")) == 0 and len(toxicity.features("One two, three")) == 6
    assert set(toxicity.features("horrible")) == set(toxicity.features("Horrible!")) and not set(toxicity.features("horrible")) & set(toxicity.features("horribly"))


def test_score_column_must_be_new(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "doc_id long, text string, score double")
    with pytest.raises(ValueError):
        toxicity.score(df, (np.empty(0, np.uint32), np.empty(0), 0.0))


def test_columns_of_any_names(spark):
    rows = [(k, "a vile thing to say" if k % 2 else "a kind thing to say", 5, 6, 7, 8) for k in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "__id", "__toxic", "id", "toxic"])
    labels = spark.createDataFrame([(k, k % 2, "x", "y") for k in range(60)], ["doc_id", "toxic", "__id", "text"])
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) and r["__id"] == 5 and r.toxic == 8 for r in got)
