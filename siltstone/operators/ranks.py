"""Values at exact ranks of a column without sorting it: a sketch brackets each rank, one count confirms it.

The first pass over the rows makes a mergeable quantile sketch (KLL) of each column, the second counts the rows
below each rank's bracket and, value by value, those within; that takes two passes whatever the values are. A
bracket that doesn't hold its rank, which the sketch's error makes all but impossible, shows in the counts and is
opened to the column's ends for another count. Within a bracket the rank is found in ranges of values: what
comes to the driver is a number a range, and then the values of the range that holds the rank.

Nulls have no rank. Others are in Spark's order: minus infinity, finite numbers, infinity, then what is no number.
"""

from __future__ import annotations

from math import ceil, floor, inf, nan

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.sources.scratch import discard, kept

#: The sketch's size; its ranks are then off by about SKETCH_ERROR at most, and brackets are twice as wide.
SKETCH, SKETCH_ERROR = 4_096, 0.0015
#: Different values of a range, which the driver may hold.
FETCHED = 50_000


def at_ranks(df: DataFrame, ranks: dict[str, tuple[Column, list[int]]]) -> dict[str, list[float]]:
    """For each name the doubles at the ranks (from 0) among its column's values; a rank beyond their number raises."""
    names = list(ranks)
    values = df.select(*(ranks[n][0].cast("double").alias(f"v{k}") for k, n in enumerate(names)))
    brackets, found = _sketched(values, names, ranks)
    while brackets:
        missed = _confirmed(values, brackets, found)
        brackets = {key: (-inf, inf) for key in missed}
    return {n: [found[k, rank] for rank in ranks[n][1]] for k, n in enumerate(names)}


def _sketched(values: DataFrame, names: list[str], ranks: dict) -> tuple[dict, dict]:
    """The first pass: (name's number, rank) -> bracket of the ranks among finite values, and the values at the others."""
    kept_figures = []
    for k in range(len(names)):
        v = F.col(f"v{k}")
        finite = F.when(~F.isnan(v) & (F.abs(v) < inf), v)
        kept_figures += [F.count_if(v == -inf).alias(f"low{k}"), F.count(finite).alias(f"n{k}"), F.count_if((v == inf) & ~F.isnan(v)).alias(f"high{k}"), F.count_if(F.isnan(v)).alias(f"nan{k}")]
        kept_figures.append(F.kll_sketch_agg_double(finite, SKETCH).alias(f"s{k}"))
    one = values.agg(*kept_figures).first()
    brackets, found = {}, {}
    for k, name in enumerate(names):
        low, n, high, odd = (one[f"{c}{k}"] for c in ("low", "n", "high", "nan"))
        inside = []
        for rank in sorted(set(ranks[name][1])):
            if not 0 <= rank < low + n + high + odd:
                raise ValueError(f"{name} has {low + n + high + odd} values, so none of rank {rank}")
            if low <= rank < low + n:
                inside.append(rank)
            else:
                found[k, rank] = -inf if rank < low else inf if rank < low + n + high else nan
        if inside:
            shares = [(rank - low) / n + off for rank in inside for off in (-2 * SKETCH_ERROR, 2 * SKETCH_ERROR)]
            asked = F.array(*(F.lit(min(max(share, 0.0), 1.0)) for share in shares))
            sketch = values.sparkSession.createDataFrame([(one[f"s{k}"],)], "sketch binary")
            ends = sketch.select(F.kll_sketch_get_quantile_double("sketch", asked)).first()[0]
            for rank, lo, hi, a, b in zip(inside, ends[::2], ends[1::2], shares[::2], shares[1::2]):
                brackets[k, rank] = (lo if a > 0 else -inf, hi if b < 1 else inf)  # a sketch may miss the least and the greatest value
    return brackets, found


def _confirmed(values: DataFrame, brackets: dict, found: dict) -> list:
    """The second pass: adds to ``found`` and returns the ranks that lie outside their brackets."""
    order = list(dict.fromkeys((k, *b) for (k, _), b in brackets.items()))

    def within(k: int, lo: float, hi: float) -> Column:
        return F.coalesce(F.col(f"v{k}").between(F.lit(lo), F.lit(hi)), F.lit(False))

    below = Observation()
    seen = values.observe(below, *(F.count_if(F.col(f"v{k}") < F.lit(lo)).alias(f"b{i}") for i, (k, lo, _) in enumerate(order)))
    items = F.array(*(F.when(within(*b), F.struct(F.lit(i).alias("i"), F.col(f"v{b[0]}").alias("v"))) for i, b in enumerate(order)))
    counts, at = kept(seen.select(F.explode(F.array_compact(items)).alias("x")).select("x.*").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    before = below.get
    sizes = {r["i"]: (r["values"], r["rows"]) for r in counts.groupBy("i").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    inside, missed = {}, []
    for (k, rank), b in brackets.items():
        i = order.index((k, *b))
        place = rank - before[f"b{i}"]
        if 0 <= place < sizes.get(i, (0, 0))[1]:
            inside[k, rank] = (i, place)
        else:
            missed.append((k, rank))
    parts, ranged, where = -(-sum(v for v, _ in sizes.values()) // FETCHED), counts, [at]
    if parts > 1:
        ranged, ranged_at = kept(counts.repartitionByRange(parts, "i", "v").withColumn("part", F.spark_partition_id()))
        totals = ranged.groupBy("i", "part").agg(F.sum("n").alias("n"), F.min("v").alias("lo")).orderBy("i", "lo").collect()
        where.append(ranged_at)
    held: dict[int, list] = {}
    if parts <= 1:
        for r in sorted(counts.collect()):  # (i, v, n)
            held.setdefault(r["i"], []).append(r)
    for (k, rank), (i, place) in inside.items():
        rows = held.get(i)
        if rows is None:
            for r in totals:
                if r["i"] == i:
                    if place < r["n"]:
                        break
                    place -= r["n"]
            rows = ranged.where((F.col("i") == i) & (F.col("part") == r["part"])).orderBy("v").collect()
        for r in rows:
            if place < r["n"]:
                found[k, rank] = r["v"]
                break
            place -= r["n"]
    discard(*where)
    return missed


def percentiles(df: DataFrame, value: Column, count: int, shares: list[float]) -> list[float]:
    """Between the two nearest values by their distance, as numpy has it. ``count``: of the rows, all of which have a value."""
    places = [share * (count - 1) for share in shares]
    wanted = sorted({f(p) for p in places for f in (floor, ceil)})
    at = dict(zip(wanted, at_ranks(df, {"v": (value, wanted)})["v"]))
    return [at[floor(p)] + (at[ceil(p)] - at[floor(p)]) * (p - floor(p)) for p in places]
