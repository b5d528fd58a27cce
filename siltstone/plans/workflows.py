"""The analytical workflows over a flagged fact.

Each names the measures that its rows depend on (the population) and those of each aggregate (its guard).
Ties in a ranking are broken by the group's keys. All but ``reconciliation`` take the fact's rows or its cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.expressions import DAYS, day_name, mean, month_name, payment_name
from siltstone.operators.cube import Cube, Spec, asked
from siltstone.operators.registry import Registry, Scope, all_of, strict
from siltstone.plans.rules import DISCREPANCY

#: What the workflows ask for. Exact sums where the columns are decimals.
CUBE = Spec(
    grains={"place": ("pu_borough", "pu_zone", "do_borough", "do_zone"), "time": ("month", "dow", "hour"), "payment": ("pu_borough", "payment_type")},
    sums=("distance", "minutes", "mph", "fare", "tip", "tip_pct", "total"),
    positive=("distance", "fare"),
    greatest=("distance", "pickup_date"),
    least=("pickup_date",),
    distinct="pu_zone",
)


def _avg(s: Scope, column: str, places: int, *measures: str) -> Column:
    return s.mean(column, places, s.population(*measures))


def _sum(s: Scope, column: str, places: int, *measures: str) -> Column:
    return F.round(s.sum(column, s.population(*measures)), places)


def busiest_zones(fact: DataFrame | Cube, registry: Registry, direction: str = "pickup", limit: int = 15, exclude_invalid: bool = True) -> DataFrame:
    if direction not in ("pickup", "dropoff"):
        raise ValueError("direction is pickup or dropoff")
    (fact, s), side = asked(fact, "place", registry, exclude_invalid), "pu" if direction == "pickup" else "do"
    rows = fact.where(all_of(s.population("trip_count", "location"))).groupBy(F.col(f"{side}_borough").alias("borough"), F.col(f"{side}_zone").alias("zone"))
    return rows.agg(
        s.count().alias("trips"),
        _avg(s, "distance", 2, "distance").alias("avg_miles"),
        _avg(s, "minutes", 1, "duration").alias("avg_minutes"),
        _avg(s, "fare", 2, "fare").alias("avg_fare"),
        _avg(s, "tip_pct", 1, "tip", "fare").alias("avg_tip_pct"),
    ).orderBy(F.desc("trips"), "borough", "zone").limit(limit)


def borough_summary(fact: DataFrame | Cube, registry: Registry, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "place", registry, exclude_invalid)
    rows = fact.where(all_of(s.population("trip_count", "location"))).groupBy(F.col("pu_borough").alias("borough"))
    return rows.agg(
        s.count().alias("trips"),
        _avg(s, "distance", 2, "distance").alias("avg_miles"),
        _avg(s, "fare", 2, "fare").alias("avg_fare"),
        _avg(s, "total", 2, "total").alias("avg_total"),
        _avg(s, "tip_pct", 1, "tip", "fare").alias("avg_tip_pct"),
        _sum(s, "total", 0, "total").alias("revenue"),
    ).orderBy(F.desc("trips"), "borough")


def activity_by_hour(fact: DataFrame | Cube, registry: Registry, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "time", registry, exclude_invalid)
    rows = fact.where(all_of(s.population("trip_count", "time"))).groupBy(F.col("hour").alias("pickup_hour"))
    return rows.agg(
        s.count().alias("trips"),
        _avg(s, "mph", 2, "speed").alias("avg_mph"),
        _avg(s, "minutes", 1, "duration").alias("avg_minutes"),
        _avg(s, "fare", 2, "fare").alias("avg_fare"),
    ).orderBy("pickup_hour")


def activity_by_dow(fact: DataFrame | Cube, registry: Registry, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "time", registry, exclude_invalid)
    out = fact.where(all_of(s.population("trip_count", "time"))).groupBy("dow").agg(
        s.count().alias("trips"),
        _avg(s, "distance", 2, "distance").alias("avg_miles"),
        _avg(s, "fare", 2, "fare").alias("avg_fare"),
        _avg(s, "tip_pct", 1, "tip", "fare").alias("avg_tip_pct"),
    )
    return out.select("dow", day_name(F.col("dow")).alias("day"), "trips", "avg_miles", "avg_fare", "avg_tip_pct").orderBy("dow")


def activity_by_month(fact: DataFrame | Cube, registry: Registry, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "time", registry, exclude_invalid)
    out = fact.where(all_of(F.col("month").isNotNull(), s.population("trip_count", "time"))).groupBy(F.col("month").alias("month_num")).agg(
        s.count().alias("trips"),
        _avg(s, "distance", 2, "distance").alias("avg_miles"),
        _avg(s, "fare", 2, "fare").alias("avg_fare"),
        _sum(s, "total", 0, "total").alias("revenue"),
    )
    return out.select("month_num", month_name(F.col("month_num")).alias("month_name"), "trips", "avg_miles", "avg_fare", "revenue").orderBy("month_num")


def hourly_heatmap(fact: DataFrame | Cube, registry: Registry, exclude_invalid: bool = True) -> DataFrame:
    """A row for each day of the week that occurs, Sunday first; a column for each hour."""
    fact, s = asked(fact, "time", registry, exclude_invalid)
    rows = fact.where(all_of(F.col("dow").isNotNull(), s.population("trip_count", "time")))
    cells = rows.groupBy("dow").agg(*(s.count(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)))
    return cells.select(day_name(F.col("dow")).alias("day"), *(f"h{h:02d}" for h in range(24))).orderBy(F.array_position(F.array(*map(F.lit, DAYS)), F.col("day")))


def tipping_by_borough(fact: DataFrame | Cube, registry: Registry, min_trips: int = 500, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "payment", registry, exclude_invalid)
    rows = fact.where(all_of(s.positive("fare"), s.population("trip_count", "location", "fare", "tip")))
    out = rows.groupBy(F.col("pu_borough").alias("borough"), "payment_type").agg(
        s.count().alias("trips"), s.mean("tip_pct", 2).alias("avg_tip_pct"), s.mean("tip", 2).alias("avg_tip"), s.mean("fare", 2).alias("avg_fare")
    )
    named = out.where(F.col("trips") >= min_trips).withColumn("payment", payment_name(F.col("payment_type")))
    return named.select("borough", "payment_type", "payment", "trips", "avg_tip_pct", "avg_tip", "avg_fare").orderBy("borough", F.desc("trips"), "payment_type")


def fare_per_mile(fact: DataFrame | Cube, registry: Registry, limit: int = 15, min_trips: int = 1000, exclude_invalid: bool = True) -> DataFrame:
    """A ratio takes both sums from the same rows, so fare and distance filter rows here."""
    fact, s = asked(fact, "place", registry, exclude_invalid)
    rows = fact.where(all_of(s.positive("distance"), s.positive("fare"), s.population("trip_count", "location", "fare", "distance")))
    out = rows.groupBy(F.col("pu_borough").alias("borough"), F.col("pu_zone").alias("zone")).agg(
        s.count().alias("trips"),
        F.try_divide(s.sum("fare"), s.sum("distance")).alias("ratio"),
        s.mean("distance", 2).alias("avg_miles"),
        s.mean("fare", 2).alias("avg_fare"),
        _avg(s, "mph", 1, "speed").alias("avg_mph"),
    )
    top = out.where((F.col("trips") >= min_trips) & F.col("ratio").isNotNull()).orderBy(F.desc("ratio"), "borough", "zone").limit(limit)
    return top.select("borough", "zone", "trips", F.round("ratio", 2).alias("fare_per_mile"), "avg_miles", "avg_fare", "avg_mph")


def od_pairs(fact: DataFrame | Cube, registry: Registry, limit: int = 20, cross_borough_only: bool = False, exclude_invalid: bool = True) -> DataFrame:
    fact, s = asked(fact, "place", registry, exclude_invalid)
    cross = F.col("pu_borough") != F.col("do_borough") if cross_borough_only else None
    names = {"pu_borough": "from_borough", "pu_zone": "from_zone", "do_borough": "to_borough", "do_zone": "to_zone"}
    out = fact.where(all_of(cross, s.population("trip_count", "location"))).groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(
        s.count().alias("trips"),
        _avg(s, "distance", 2, "distance").alias("avg_miles"),
        _avg(s, "minutes", 1, "duration").alias("avg_minutes"),
        _avg(s, "total", 2, "total").alias("avg_total"),
    )
    return out.orderBy(F.desc("trips"), *names.values()).limit(limit)


def reconciliation(fact: DataFrame, min_trips: int = 500, places: int = 2) -> DataFrame:
    """Flagged mismatches by the size of the discrepancy."""
    rows = fact.where("q_total_mismatch = 1").groupBy(F.round(F.expr(DISCREPANCY), places).cast("double").alias("discrepancy"))
    out = rows.agg(
        F.count(F.lit(1)).alias("trips"),
        mean(F.col("mta_tax"), 3).alias("avg_mta_tax"),
        mean(F.col("improvement"), 3).alias("avg_improvement"),
        mean(F.col("congestion"), 3).alias("avg_congestion"),
        F.count_if(F.col("congestion").isNull()).alias("congestion_null"),
    )
    return out.where(F.col("trips") >= min_trips).orderBy(F.desc("trips"), "discrepancy")


IMPACT = (
    ("avg_miles", "distance", 2, ("distance",)),
    ("avg_minutes", "minutes", 1, ("duration",)),
    ("avg_mph", "mph", 2, ("speed",)),
    ("max_miles", "distance", 2, ("distance",)),
    ("avg_fare", "fare", 2, ("fare",)),
    ("avg_tip_pct", "tip_pct", 2, ("tip", "fare")),
)


def cleaning_impact(fact: DataFrame | Cube, registry: Registry) -> DataFrame:
    """Each figure over all rows, over rows without any flag, and over the rows that can bear it; one pass."""
    (fact, s), aggregates, rows = asked(fact, "time", registry), [], []
    for scenario in ("all_rows", "strict_clean", "selective"):
        for name, column, places, measures in (("trips", None, 0, ("trip_count",)), *IMPACT):
            when = {"all_rows": None, "strict_clean": strict(), "selective": registry.condition(*measures)}[scenario]
            value = s.count(when).cast("double") if column is None else F.round(s.greatest(column, when).cast("double"), places) if name == "max_miles" else s.mean(column, places, when)
            aggregates.append(value.alias(f"{name}_{scenario}"))
    for name, _, _, measures in (("trips", None, 0, ("trip_count",)), *IMPACT):
        rows.append(F.struct(F.lit(name).alias("metric"), F.lit(", ".join(measures)).alias("depends_on"), *(F.col(f"{name}_{c}").alias(c) for c in ("all_rows", "strict_clean", "selective"))))
    return fact.agg(*aggregates).select(F.inline(F.array(*rows)))


def headline(fact: DataFrame | Cube, registry: Registry) -> DataFrame:
    distinct = fact.distinct() if isinstance(fact, Cube) else F.countDistinct("pu_zone")
    fact, s = asked(fact, "time", registry)
    return fact.agg(
        s.count().alias("trips"),
        s.count(strict()).alias("clean_trips"),
        distinct.alias("pickup_zones"),
        s.least("pickup_date").alias("first_pickup"),
        s.greatest("pickup_date").alias("last_pickup"),
        _sum(s, "total", 0, "total").alias("total_revenue"),
        _avg(s, "distance", 2, "distance").alias("typical_miles"),
        _avg(s, "minutes", 1, "duration").alias("typical_minutes"),
        _avg(s, "fare", 2, "fare").alias("typical_fare"),
    )
