"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the words, the pairs of neighbours and the pairs with one word between, each present or
not, hashed to 32 bits. Words are lower-cased and freed of outer marks. The weights are learned with a rate for
each coordinate; the L1 term leaves most at zero, so those that stay are few and are broadcast. A toxic text's
gradients count ``TOXIC_WEIGHT`` times, as toxic texts are few.

Training takes a bounded sample (``SAMPLE_DOCS``) of the labelled rows, chosen by a hash of their ids, and
runs as one task over their features alone. Scores depend on the text only. Null and empty texts have no
features and get the bias's score. Ids that have several labels count as toxic if one says so; labels that
are null count for nothing. Without labels of both kinds every score is the rate of the one kind (0 if none). Other
columns pass through ``score`` whatever their names, but for that of the score, which raises; ``fit`` reads none of them.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import named_apart, stored, table, take_turn

#: The bound of the labelled sample that the model is fitted on.
SAMPLE_DOCS = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
TOXIC_WEIGHT = 2.0
WORDS_KEPT = 200_000
SLICE = 256
#: Parts of the features' range that are counted one after the other.
PARTS = 16
_KEY_BITS = 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.strip(string.punctuation))
        return value


_hashes = _WordHashes()


def _begin() -> None:
    take_turn("toxicity", _hashes.clear)


def features(text: str | None) -> np.ndarray:
    """Hashes of all words, pairs and skip pairs in their order; repeated ones stay."""
    words = (text or "").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * _MIX[0]) ^ (h[1:] * _MIX[1] + _MIX[4])
    skips = (h[:-2] * _MIX[2]) ^ (h[2:] * _MIX[3] + _MIX[4])
    every = np.concatenate([h, pairs * _MIX[2], skips * _MIX[0]])
    return (every >> np.uint64(32)).astype(np.uint32)


def _reachable(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features (rising) whose weights L1 may let leave zero, counted a part of their range at a time.

    While a weight is zero its sum of gradients moves by less than 1, or TOXIC_WEIGHT, a document and epoch: where
    all of them together don't exceed L1, the weight stays zero, so leaving it out changes nothing.
    """
    edges = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 32) // PARTS)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    found = []
    for p in range(PARTS):
        part = [s[c[p] : c[p + 1]] for s, c in zip(sets, cuts)]
        keys, docs = np.unique(np.concatenate(part), return_counts=True)
        toxic, toxic_docs = np.unique(np.concatenate([s for s, y in zip(part, labels) if y]), return_counts=True)
        most = docs.astype(float)
        most[np.searchsorted(keys, toxic)] += (TOXIC_WEIGHT - 1) * toxic_docs
        found.append(keys[EPOCHS * most > L1])
    return np.concatenate(found)


def train(sets: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes (rising), their weights, and the bias. ``sets``: each text's different features, rising."""
    rate = float(np.mean(labels)) if len(labels) else 0.0
    none = np.empty(0, np.uint32), np.empty(0)
    if not 0 < rate < 1:
        return *none, 40.0 if rate else -40.0
    keys = _reachable(sets, labels)
    indexes = []
    for s in sets:
        at = np.searchsorted(keys, s).astype(np.int32)
        held = at < len(keys)
        held[held] = keys[at[held]] == s[held]
        indexes.append(at[held])
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias, bias_n = np.log(rate / (1 - rate)), 1.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.arange(len(sets))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(order):
            at = indexes[k]
            zk, nk = z[at], n[at]
            w = weights(zk, nk)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -40, 40))) - labels[k]
            g *= TOXIC_WEIGHT if labels[k] else 1.0
            z[at] = zk + g - (np.sqrt(nk + g * g) - np.sqrt(nk)) / ALPHA * w
            n[at] = nk + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return keys[kept], w[kept], float(bias)


def _feature_sets(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                sets = [np.unique(features(x)).astype("<u4").tobytes() for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "toxic", "features"])

    return df.mapInArrow(run, "id string, toxic int, features binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, id_col: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """The model for ``docs`` from ``labels`` (doc_id, toxic 0/1). Held-out ids must be taken out of ``labels`` before."""
    mine, marked, body = "__siltstone_id", "__siltstone_toxic", "__siltstone_text"
    one = labels.select(F.col(id_col).alias(mine), F.col("toxic").alias(marked)).where(F.col(marked).isNotNull() & F.col(mine).isNotNull())
    one = one.groupBy(mine).agg(F.max(marked).cast("int").alias(marked))
    chosen = stored(one.orderBy(F.xxhash64(mine), mine).limit(sample))
    texts = docs.select(F.col(id_col).alias(mine), F.col(text).alias(body))  # whatever else there is, its names are left behind
    rows = texts.join(F.broadcast(chosen), mine).select(F.col(mine).cast("string").alias("id"), F.col(marked).alias("toxic"), F.col(body).alias("text"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "features"], kind="stable").drop_duplicates("id")
        keys, weights, bias = train([np.frombuffer(x, "<u4") for x in frame["features"]], frame["toxic"].to_numpy(float))
        return pd.DataFrame({"keys": [keys.astype("<u4").tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    model = _feature_sets(rows).groupBy(F.lit("all").alias("sample")).applyInPandas(learn, "keys binary, weights binary, bias double").first()
    if model is None:
        return np.empty(0, np.uint32), np.empty(0), -40.0
    return np.frombuffer(model["keys"], "<u4"), np.frombuffer(model["weights"]), model["bias"]


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``: the probability, 0 to 1, that the text is toxic."""
    named_apart(df, out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        keys, weights, bias = shared.value
        low = np.uint32((1 << _KEY_BITS) - 1)
        likely = np.zeros(1 << _KEY_BITS, bool)
        likely[keys & low] = True

        def value(text: str | None) -> float:
            found = features(text)
            found = np.unique(found[likely[found & low]])
            where = np.searchsorted(keys, found)
            hit = where < len(keys)
            hit[hit] = keys[where[hit]] == found[hit]
            return float(1 / (1 + np.exp(-np.clip(weights[where[hit]].sum() + bias, -40, 40))))

        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                scores = pa.array([value(x) for x in batch.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
