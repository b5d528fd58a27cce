"""What several operators share: checked broadcasts, joins on hot keys, work on groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import discard, kept, release, scratch_dir, stored

__all__ = ["by_group", "by_part", "components", "discard", "kept", "lookup", "named_apart", "release", "scratch_dir", "small", "spread_join", "stored", "table", "take_turn"]

#: Rows up to which a narrow table (a few numbers a row) may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table with texts or arrays may be broadcast; they are summed first.
BROADCAST_BYTES = 16 << 20
#: A key with more than 1 / HOT_KEYS of all rows is hot; so there are fewer hot keys than that.
HOT_KEYS = 5_000

_caches: dict[str, Callable[[], None]] = {}


def take_turn(name: str, clear: Callable[[], None]) -> None:
    """Called by a task that is about to use its worker's cache ``name``: those of other operators are emptied.

    Python workers outlive their tasks, and the caches of several operators together would crowd an executor.
    """
    if others := [other for other in _caches if other != name]:
        for other in others:
            _caches.pop(other)()
        pa.default_memory_pool().release_unused()
    _caches[name] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_apart(df: DataFrame, *names: str) -> None:
    """Raises where ``df`` has a column that an operator is about to add."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the input has columns of the output's names: {', '.join(sorted(taken))}")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored table of narrow rows for broadcast if it has at most ``rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``keyed`` (stored, narrow, one row a key) on ``key``; ``how`` is inner or left.

    ``n`` of ``keyed`` is how many rows of ``rows`` have the key, and is left out. Hot keys are joined where
    their rows are, by a broadcast of fewer than ``HOT_KEYS`` keys; the others shuffle, and none of them is
    much of a task. ``rows`` is then read twice, so it is best stored. Where no key is hot it is a plain join.
    """
    total, most = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most * HOT_KEYS <= total:
        return rows.join(keyed.drop(n), key, how)
    hot = F.col(n) * HOT_KEYS > total
    often, rest = keyed.where(hot).drop(n), keyed.where(~hot).drop(n)
    near = rows.join(F.broadcast(often), key)
    far = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key, how)
    return near.unionByName(far)


def lookup(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str, how: str = "inner") -> DataFrame:
    """As ``spread_join``, but all of ``keyed`` is broadcast if it is small."""
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed.drop(n)), key, how)
    return spread_join(rows, keyed, key, n, how)


def by_part(dealt: DataFrame, group: list[str], work: Callable[[pa.Table, list[int]], list], schema: str) -> DataFrame:
    """``work`` on rows of whole groups and the places where each begins gives the columns of ``schema``, or an empty list.

    The groups are of the integer columns ``group``; a partition holds whole groups, sorted by them. A task holds
    a batch, or a group where that is more.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(parts).combine_chunks()
            keys = [part.column(n).to_numpy() for n in group]
            starts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist()]
            if columns := work(part, starts):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n).to_numpy() for n in group]
            if held and any(held[-1].column(n)[-1].as_py() != int(k[0]) for n, k in zip(group, keys)):
                yield from results(held)
                held = []
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            if len(last):  # all groups but the last are whole
                yield from results([*held, batch.slice(0, last[-1] + 1)])
                held = []
            held.append(batch.slice(last[-1] + 1) if len(last) else batch)
        if held:
            yield from results(held)

    return dealt.mapInArrow(run, schema)


def by_group(dealt: DataFrame, group: list[str], work: Callable[[pa.Table], list], schema: str) -> DataFrame:
    """As ``by_part``, a group at a time."""

    def each(part: pa.Table, starts: list[int]) -> list:
        found = [columns for a, b in zip(starts, [*starts[1:], part.num_rows]) if (columns := work(part.slice(a, b - a)))]
        return [np.concatenate(c) for c in zip(*found)]

    return by_part(dealt, group, each, schema)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): (id, label), label the smallest id that is reachable.

    Each round takes the least label of all neighbours and then the label of that label, so that paths halve.
    Sums per vertex are combined before the shuffle and joins spread, so neither a hub with very many links nor
    a large component is a single task's work.
    """
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, edges_at = kept(ends.where("a <> b").distinct())
    start = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree"))
    labels, at = kept(start.select("id", F.least("id", "least").alias("label"), "degree"))
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    while True:
        of = labels.select(F.col("id").alias("b"), "label", F.col("degree").alias("n"))
        met = edges.join(F.broadcast(of.drop("n")), "b") if few else spread_join(edges, of, "b", "n")
        seen = met.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "id").select("id", "degree", F.col("label").alias("was"), F.least("label", "seen").alias("near"))
        far = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        gone = [at]
        if few:
            reached = lower.join(F.broadcast(far), "near")
        else:
            lower, lower_at = kept(lower)
            far, far_at = kept(far.join(lower.groupBy("near").agg(F.count(F.lit(1)).alias("n")), "near"))
            gone += [lower_at, far_at]
            reached = spread_join(lower, far, "near", "n")
        nxt, at = kept(reached.select("id", "degree", "was", F.least("near", "far").alias("label")))
        discard(*gone)
        labels = nxt.select("id", "label", "degree")
        if nxt.where("was <> label").isEmpty():
            discard(edges_at)
            return labels.select("id", "label")
