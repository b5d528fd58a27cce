"""Exact top-k search by inner product with pivot-table elimination.

Each candidate's distances to many pivots are stored beside it. For a query the pivots give lower bounds
of its distance to each candidate, |d(q, p) - d(x, p)|; the largest bound and the norms give an upper bound
of the inner product. Candidates are evaluated in the order of their bounds until the k-th score found
exceeds the next bound, so the result is exact whatever the pivots are.

The queries are a stated set. Each block of about ``QUERY_BLOCK`` queries meets each block of about ``ROW_BLOCK``
candidates in one group of a shuffle, which yields k rows a query; nothing is broadcast or goes through the
driver but the pivots.

Vectors that are null or hold null or non-finite components take no part; nor do candidates of another
length than the query. Ties go to the smaller id. Rows with a query's own id are no candidates for it;
a query id that comes repeatedly is asked once, with its least vector; repeated candidate rows all count.
Rows with a null id take no part. Ids are of any type that sorts; those that aren't whole numbers are numbered in
their order first. Other columns are left behind. Components so large that a score might not
fit 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import by_group, stored, table

PIVOTS = 24
#: Vectors that pivots are picked from; the bound of what is collected for that.
PIVOT_SAMPLE = 2_000
QUERY_BLOCK, ROW_BLOCK = 8_192, 16_384
#: Candidates evaluated at a time.
STEP = 128


def usable(column: str) -> F.Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~bad, F.lit(False))


def integers(df: DataFrame, id_col: str, vec: str, scale: int) -> DataFrame:
    """(id, x): the usable vectors with each component turned into floor(scale * component)."""
    return df.where(usable(vec) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vec, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("x"))


def pick_pivots(vectors: list[np.ndarray], count: int = PIVOTS) -> list[np.ndarray]:
    """Far from each other: each next one is the farthest from those picked."""
    if not vectors:
        return []
    length = max(set(map(len, vectors)), key=[len(v) for v in vectors].count)
    x = np.array([v for v in vectors if len(v) == length], float)
    picked, nearest = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(count, len(x)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(x - x[picked[-1]], axis=1))
    return [x[i] for i in picked]


def _pivot_distances(x: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """A row a vector, a column a pivot; no columns when the lengths differ."""
    if not pivots or len(pivots[0]) != x.shape[1]:
        return np.empty((len(x), 0))
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[begins[rows][:, None] + np.arange(size)]


def index(vectors: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """(id, x, to_pivots): the pivot table, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[float]] = [[]] * batch.num_rows
            for rows, x in _by_length(batch.column(1)):
                for row, distances in zip(rows, _pivot_distances(x.astype(float), pivots).tolist()):
                    found[row] = distances
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=["id", "x", "to_pivots"])

    return vectors.mapInArrow(run, "id long, x array<long>, to_pivots array<double>")


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _search(q: np.ndarray, q_id: int, q_pivots: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, pivots: np.ndarray, best: _Best) -> None:
    q_norm = float((q.astype(float) ** 2).sum())
    if pivots.shape[1] and len(q_pivots) == pivots.shape[1]:
        apart = np.abs(pivots - q_pivots).max(axis=1)
        bound = (q_norm + norms - apart**2) / 2
        bound += 1e-9 * (q_norm + norms) + 1  # rounding never drops a candidate
    else:
        bound = np.sqrt(q_norm * norms) + 1
    bound[ids == q_id] = -np.inf
    if len(bound) > STEP:  # the highest bounds come first and set the floor
        first = np.argpartition(-bound, STEP)[:STEP]
        first = first[bound[first] > -np.inf]
        best.add(x[first] @ q, ids[first])
        bound[first] = -np.inf
    worth = np.flatnonzero((bound >= best.floor()) & (bound > -np.inf))
    worth = worth[np.argsort(-bound[worth], kind="stable")]
    for k in range(0, len(worth), STEP):
        part = worth[k : k + STEP]
        if bound[part[0]] < best.floor():
            break
        best.add(x[part] @ q, ids[part])


def _block(part: pa.Table, k: int) -> list:
    """Of one block of queries (side 0) and one of candidates: the k best for each query among these."""
    side = part.column("side").to_numpy()
    asked, held = part.slice(0, int((side == 0).sum())), part.slice(int((side == 0).sum()))
    if not asked.num_rows or not held.num_rows:
        return []
    ids, q_ids = held.column("id").to_numpy(), asked.column("id").to_numpy()
    vectors, tables = (held.column(n).combine_chunks() for n in ("x", "to_pivots"))
    queries = list(zip(q_ids.tolist(), (np.array(v, np.int64) for v in asked.column("x").to_pylist()), map(np.array, asked.column("to_pivots").to_pylist())))
    out: list[tuple[int, int, int]] = []
    for rows, x in _by_length(vectors):
        x = x.astype(np.int64)
        exact = x.astype(float)
        norms, most = (exact**2).sum(axis=1), np.abs(exact).max(initial=0) * x.shape[1]
        of_pivots = list(_by_length(tables.take(pa.array(rows))))
        to_pivots = of_pivots[0][1] if len(of_pivots) == 1 else np.empty((len(rows), 0))
        for q_id, q, q_pivots in queries:
            if len(q) != x.shape[1]:
                continue
            if most * np.abs(q.astype(float)).max(initial=0) >= 2.0**62:
                raise OverflowError(f"scores of query {q_id} may not fit 64 bits")
            best = _Best(k)
            _search(q, q_id, q_pivots, ids[rows], x, norms, to_pivots, best)
            out += [(q_id, v, s) for s, v in zip(best.scores.tolist(), best.ids.tolist())]
    return list(zip(*out))


def _numbers(*tables: DataFrame) -> DataFrame:
    """(id, number): the ids of all tables, with numbers in their order: ids alone are sorted, by ranges."""
    ids = reduce(DataFrame.unionByName, (t.select("id") for t in tables)).distinct()
    return stored(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("number")))


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``df`` of the highest integer inner product."""
    candidates, asked = integers(df, id_col, vec, scale), integers(queries, id_col, vec, scale)
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return _top_k(candidates.withColumn("id", F.col("id").cast("long")), asked.withColumn("id", F.col("id").cast("long")), k)
    numbers = _numbers(candidates, asked)
    found = _top_k(*(t.join(numbers, "id").select(F.col("number").alias("id"), "x") for t in (candidates, asked)), k)
    named = [numbers.select(F.col("number").alias(c), F.col("id").alias(f"{c}_named")) for c in ("query_id", "vec_id")]
    found = found.join(named[0], "query_id").join(named[1], "vec_id")
    return found.select(F.col("query_id_named").alias("query_id"), "rank", F.col("vec_id_named").alias("vec_id"), "score")


def _top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``top_k``, from (id long, x) on both sides."""
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("x").collect()
    pivots = pick_pivots([np.array(r["x"]) for r in sample])
    built = stored(index(candidates, pivots).withColumn("row", F.monotonically_increasing_id()))
    asked = stored(index(queries.groupBy("id").agg(F.min("x").alias("x")), pivots))
    asked_blocks, built_blocks = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-built.count() // ROW_BLOCK))

    def block_of(number: str, blocks: int) -> F.Column:
        return F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int")

    def every(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    rows = built.select(every(asked_blocks).alias("i"), block_of("row", built_blocks).alias("j"), F.lit(1).alias("side"), "id", "x", "to_pivots")
    sent = asked.select(block_of("id", asked_blocks).alias("i"), every(built_blocks).alias("j"), F.lit(0).alias("side"), "id", "x", "to_pivots")
    dealt = sent.unionByName(rows).repartition("i", "j").sortWithinPartitions("i", "j", "side")
    found = by_group(dealt, ["i", "j"], lambda part: _block(part, k), "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
