"""Flagging in one pass, and what the flags say about the table and its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import percent
from siltstone.operators.cube import Cube, asked
from siltstone.operators.ranks import at_ranks
from siltstone.operators.registry import Registry, strict


def apply_rules(fact: DataFrame, registry: Registry, overrides: dict | None = None) -> DataFrame:
    """Adds a 0/1 flag for each rule and issue_count. Flags that are there already are made anew."""
    plain = fact.drop("issue_count", *(r.flag for r in registry.rules))
    flags = {r.flag: F.when(F.expr(registry.predicate_sql(r, overrides)), 1).otherwise(0) for r in registry.rules}
    flagged = plain.select("*", *(c.alias(n) for n, c in flags.items()))
    return flagged.withColumn("issue_count", sum((F.col(n) for n in flags), F.lit(0)))


def _as_rows(one: DataFrame, names: list[tuple], columns: list[str]) -> DataFrame:
    """A one-row aggregate with v0, v1, ... as a row for each of ``names``, with the value in ``value``."""
    items = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(columns, row)), F.col(f"v{k}").alias("value")) for k, row in enumerate(names)))
    return one.select("total", F.explode(items).alias("x")).select("total", "x.*")


def summary(flagged: DataFrame | Cube, registry: Registry, overrides: dict | None = None) -> DataFrame:
    rows, s = asked(flagged, "time", registry)
    one = rows.agg(s.count().alias("total"), *(s.count(F.col(r.flag) == 1).alias(f"v{k}") for k, r in enumerate(registry.rules)))
    rows = [(r.name, r.severity, registry.description(r, overrides), ", ".join(r.invalidates)) for r in registry.rules]
    out = _as_rows(one, rows, ["rule", "severity", "description", "invalidates"]).withColumnRenamed("value", "flagged")
    return out.select("rule", "severity", "flagged", percent(F.col("flagged"), F.col("total"), 3).alias("pct_of_trips"), "description", "invalidates").orderBy(F.desc("flagged"), "rule")


def issue_distribution(flagged: DataFrame | Cube, registry: Registry) -> DataFrame:
    rows, s = asked(flagged, "time", registry)
    counts = rows.groupBy(F.col("issue_count").alias("issues")).agg(s.count().alias("trips"))
    total = counts.agg(F.sum("trips").alias("total"))
    return counts.join(F.broadcast(total)).select("issues", "trips", percent(F.col("trips"), F.col("total"), 3).alias("pct")).orderBy("issues")


def measure_coverage(flagged: DataFrame | Cube, registry: Registry) -> DataFrame:
    flagged, s = asked(flagged, "time", registry)
    names = [*registry.measures, "(all rules)"]
    usable = [registry.condition(m) for m in registry.measures] + [strict()]
    sums = [s.count(u).alias(f"v{k}") for k, u in enumerate(usable)]
    rows = [(m, registry.measures.get(m, "rows that no rule has flagged"), len(registry.affecting(m)) if m in registry.measures else len(registry.rules)) for m in names]
    out = _as_rows(flagged.agg(s.count().alias("total"), *sums), rows, ["measure", "meaning", "rules"]).withColumnRenamed("value", "usable_rows")
    return out.select("measure", "meaning", "rules", "usable_rows", percent(F.col("usable_rows"), F.col("total"), 2).alias("pct_of_trips"))


SAMPLE_COLUMNS = ("pickup_ts", "dropoff_ts", "minutes", "distance", "mph", "fare", "tip", "total", "pu_zone", "do_zone", "issue_count")


def sample(flagged: DataFrame, registry: Registry, rule: str, limit: int = 10) -> DataFrame:
    """The rows of a rule with the largest distances."""
    hit = flagged.where(F.col(registry.rule(rule).flag) == 1)
    return hit.orderBy(F.desc_nulls_last("distance"), "raw_id").select("raw_id", *SAMPLE_COLUMNS).limit(limit)


def selected(registry: Registry, selector: str) -> Column:
    """``all``, ``flagged``, ``clean`` or a rule's name."""
    known = {"all": F.lit(True), "flagged": F.col("issue_count") > 0, "clean": strict()}
    return known[selector] if selector in known else F.col(registry.rule(selector).flag) == 1


def fired_names(registry: Registry) -> Column:
    names = F.array_join(F.array_compact(F.array(*(F.when(F.col(r.flag) == 1, F.lit(r.name)) for r in registry.rules))), ", ")
    return F.when(names == "", F.lit("—")).otherwise(names)


def tested_cells(registry: Registry) -> Column:
    """rule -> the columns that show why it fired, for the fired rules that show any."""
    none = F.array().cast("array<string>")
    cells = []
    for r in registry.rules:
        shown = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(column)) for column, when in r.tested)))
        cells.append(F.when(F.col(r.flag) == 1, shown).otherwise(none))
    every = F.map_from_arrays(F.array(*(F.lit(r.name) for r in registry.rules)), F.array(*cells))
    return F.map_filter(every, lambda _, v: F.size(v) > 0)


RAW_COLUMNS = {"pickup_text": "pickup", "dropoff_text": "dropoff", "passengers_text": "passengers", "distance_text": "distance", "fare_text": "fare", "tip_text": "tip", "total_text": "total"}


def browse(flagged: DataFrame, registry: Registry, selector: str = "flagged", limit: int = 25, raw: DataFrame | None = None) -> DataFrame:
    """The rows with most issues: what the source said (``raw``, by raw_id), what was derived, which rules fired and on what."""
    order = (F.desc("issue_count"), F.asc_nulls_last("pickup_ts"), F.asc_nulls_last("pu_zone"), F.asc_nulls_last("do_zone"), F.asc("raw_id"))
    top = flagged.where(selected(registry, selector)).orderBy(*order).limit(limit)
    shown = [F.col("issue_count").alias("issues"), fired_names(registry).alias("flags"), tested_cells(registry).alias("tested")]
    out = top.select("raw_id", "pickup_ts", "pu_zone", "do_zone", "minutes", "mph", *shown)
    if raw is None:
        return out
    # ``out`` has ``limit`` rows.
    source = raw.select("raw_id", *(F.col(c).alias(name) for name, c in RAW_COLUMNS.items()))
    return source.join(F.broadcast(out), "raw_id").orderBy(F.desc("issues"), *order[1:])


def browse_count(flagged: DataFrame, registry: Registry, selector: str = "flagged") -> DataFrame:
    return flagged.agg(F.count_if(selected(registry, selector)).alias("matching"))


THRESHOLD_COLUMNS = {"max_fare": "fare", "max_distance": "distance", "max_minutes": "minutes"}


def upper_tails(flagged: DataFrame, tail: float = 0.001) -> dict[str, float]:
    """The least of the largest ``tail`` of fares, distances and durations (one row at least), by the threshold's name."""
    counts = flagged.agg(*(F.count(c).alias(n) for n, c in THRESHOLD_COLUMNS.items())).first()
    ranks = {n: (F.col(c), [counts[n] - max(1, int(counts[n] * tail))]) for n, c in THRESHOLD_COLUMNS.items() if counts[n]}
    return {n: v[0] for n, v in at_ranks(flagged, ranks).items()} if ranks else {}


def derive_thresholds(flagged: DataFrame, tail: float = 0.001) -> DataFrame:
    """(threshold, value), as ``upper_tails`` finds them; null where a column has no values."""
    found = upper_tails(flagged, tail)
    rows = [(n, found.get(n)) for n in THRESHOLD_COLUMNS]
    return flagged.sparkSession.createDataFrame(rows, "threshold string, value double")
