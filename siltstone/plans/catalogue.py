"""The registered queries over the trade tables and events. ``oracles`` has the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import flags, tariff, transform
from siltstone.operators.cube import asked
from siltstone.plans import workflows as w
from siltstone.plans.rules import TRIPS
from siltstone.plans.trade import EVENTS, FILE, TRADE, TRADE_TABLES, added_files, events_cube, flagged_events, flagged_trade, landed_file, landed_trade, nation_zones, trade_cube, typed_file, version_of
from siltstone.sources.buckets import bucket_count, bucketed
from siltstone.sources.scratch import scratch_dir

BOUNDS = tariff.Bounds((0.1, 48), (1, 1800))


_tariffs: dict[str, tuple[str, tariff.Tariff]] = {}


def _calibrated(spark, sf_dir):
    """The fact and the tariff, which is fitted once for each version of the files."""
    fact, now = flagged_trade(spark, sf_dir), version_of(spark, sf_dir, TRADE_TABLES)
    if sf_dir not in _tariffs or _tariffs[sf_dir][0] != now:
        _tariffs[sf_dir] = (now, tariff.calibrate(fact, BOUNDS))
    return fact, _tariffs[sf_dir][1]


def _tariff_fit(spark, sf_dir):
    t = _calibrated(spark, sf_dir)[1]
    row = (t.rows_fitted, round(t.base, 3), round(t.per_mile, 3), round(t.per_minute, 3))
    return spark.createDataFrame([row], "rows_fitted long, base double, per_mile double, per_minute double")


def _tariff_errors(spark, sf_dir):
    t = _calibrated(spark, sf_dir)[1]
    return spark.createDataFrame([(round(t.median_error, 2), round(t.p95_error, 2))], "median_error double, p95_error double")


def _tariff_gap(spark, sf_dir, by_udf):
    fact, t = _calibrated(spark, sf_dir)
    if not by_udf:
        return tariff.gap_by_rate_code(fact, tariff.expected_fare(t))
    udf = tariff.deploy(spark, t)
    return tariff.gap_by_rate_code(fact, udf(F.col("rate_code"), F.col("distance").cast("double"), F.col("minutes").cast("double")))


def _tariff_gap_sql(spark, sf_dir):
    """By the SQL function, in a session that reads the stored coefficients and fits nothing."""
    fact, t = _calibrated(spark, sf_dir)
    path = scratch_dir(spark)
    tariff.publish(spark, t, path)
    tariff.deploy_sql(spark, tariff.published(spark, path))
    return tariff.gap_by_rate_code(fact, F.expr("tariff_fare(rate_code, CAST(distance AS DOUBLE), CAST(minutes AS DOUBLE))"))


def _flat_fares(spark, sf_dir):
    return tariff.flat_fares(flagged_trade(spark, sf_dir)).select("rate_code", F.col("fare").cast("double").alias("fare"))


def _landed(spark, sf_dir):
    return transform.cast_and_enrich(landed_trade(spark, sf_dir), nation_zones(spark, sf_dir))


def _landing(spark, sf_dir):
    money = [F.round(F.sum(c).cast("double"), 2).alias(f"sum_{c}") for c in ("distance", "fare", "total")]
    return _landed(spark, sf_dir)[0].groupBy("pu_borough", "hour").agg(F.count(F.lit(1)).alias("trips"), F.count("fare").alias("fares"), *money)


def _derived(spark, sf_dir):
    columns = [F.col(c).cast("double").alias(c) for c in ("minutes", "mph", "tip_pct")]
    return _landed(spark, sf_dir)[0].select("raw_id", *columns, "pickup_date", "hour", "dow", "month")


#: The benchmark's questions: the grain, key and its name, and the value to add up and its name. Orders have no time of day, so the hours are asked of the events too.
BENCH = {
    "bench_revenue_by_borough": ("place", "pu_borough", "borough", "total", "revenue"),
    "bench_distance_by_hour": ("time", "hour", "hour", "distance", "miles"),
    "bench_event_distance_by_hour": ("time", "hour", "hour", "distance", "miles"),
    "bench_flagged_distribution": ("time", "issue_count", "issues", None, None),
}


def _bench(name: str, fact_of: Callable) -> Callable:
    grain, key, key_name, value, value_name = BENCH[name]

    def run(spark, sf_dir):
        rows, s = asked(fact_of(spark, sf_dir), grain, TRADE)
        sums = [F.round(s.sum(value), 2).alias(value_name)] if value else []
        return rows.groupBy(F.col(key).alias(key_name)).agg(s.count().alias("trips"), *sums)

    return run


def _cells() -> Column:
    keys = F.array_sort(F.map_keys("tested"))
    return F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, F.array_join(F.col("tested")[k], "+"))), ";")


def _shown(out: DataFrame) -> DataFrame:
    columns = [c for c in out.columns if c not in ("tested", "minutes", "mph")]
    return out.select(*columns, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("minutes", "mph")), _cells().alias("tested"))


def _browse(selector: str) -> Callable:
    return lambda s, d: _shown(flags.browse(flagged_trade(s, d), TRADE, selector, 25))


def _browse_file(spark, sf_dir):
    """The file's rows beside what the file says."""
    return _shown(flags.browse(typed_file(spark, sf_dir), FILE, "all", 25, landed_file(spark, sf_dir).raw))


def _file_accounting(spark, sf_dir):
    """Lines read, malformed, kept and rejected, as counted in the passes that wrote them."""
    landed, accounting = landed_file(spark, sf_dir), transform.Accounting()
    fact, _ = transform.cast_and_enrich(landed.raw, nation_zones(spark, sf_dir), accounting=accounting)
    fact.write.format("noop").mode("overwrite").save()
    counts = landed.counts | accounting.check()
    return spark.createDataFrame([(counts["read"], counts["malformed"], counts["kept"], counts["rejected"])], "read long, malformed long, kept long, rejected long")


def _malformed_lines(spark, sf_dir):
    return landed_file(spark, sf_dir).malformed.select("raw_id", "line")


#: Rows of a bucket that one task sorts in memory.
LOSS_ROWS = 250_000


def _cast_losses(spark, sf_dir):
    """Only the columns that are compared go to the buckets."""
    raw, fact = (df.select("raw_id", *transform.LOSS_COLUMNS) for df in (landed_file(spark, sf_dir).raw, typed_file(spark, sf_dir)))
    buckets = bucket_count(landed_file(spark, sf_dir).counts["read"], LOSS_ROWS)
    return transform.cast_losses(bucketed(raw, "raw_id", buckets), bucketed(fact, "raw_id", buckets))


def _trade(f: Callable[..., DataFrame], **options) -> Callable:
    return lambda s, d: f(flagged_trade(s, d), TRADE, **options)


#: Workflows over the trade tables and over the events (hours are the events' alone), and those without a switch for invalid rows.
TRADE_WORKFLOWS = {
    "busiest_zones_pickup": (w.busiest_zones, {"direction": "pickup"}),
    "busiest_zones_dropoff": (w.busiest_zones, {"direction": "dropoff"}),
    "borough_summary": (w.borough_summary, {}),
    "activity_by_dow": (w.activity_by_dow, {}),
    "activity_by_month": (w.activity_by_month, {}),
    "tipping_by_borough": (w.tipping_by_borough, {}),
    "fare_per_mile": (w.fare_per_mile, {}),
    "od_pairs": (w.od_pairs, {}),
    "od_pairs_cross": (w.od_pairs, {"cross_borough_only": True}),
}
EVENT_WORKFLOWS = {"activity_by_hour": (w.activity_by_hour, {}), "hourly_heatmap": (w.hourly_heatmap, {})}
FIGURES = {"cleaning_impact": w.cleaning_impact, "headline": w.headline, "rule_summary": flags.summary, "issue_distribution": flags.issue_distribution, "measure_coverage": flags.measure_coverage}


def _over(trade_of: Callable, events_of: Callable, suffix: str) -> dict:
    """All that can be asked of rows and of cubes alike, of the facts that these give."""

    def asking(f, fact_of, registry, options):
        return lambda s, d: f(fact_of(s, d), registry, **options)

    found = {}
    for workflows, fact_of, registry in ((TRADE_WORKFLOWS, trade_of, TRADE), (EVENT_WORKFLOWS, events_of, EVENTS)):
        for name, (f, options) in workflows.items():
            for rows, valid in (("", True), ("_all_rows", False)):
                found[f"{name}{rows}{suffix}"] = asking(f, fact_of, registry, options | {"exclude_invalid": valid})
    return found | {f"{name}{suffix}": asking(f, trade_of, TRADE, {}) for name, f in FIGURES.items()}


def queries() -> dict:
    found = _over(flagged_trade, flagged_events, "") | _over(trade_cube, events_cube, "_by_cube")
    for name in BENCH:
        of_rows, of_cube = (flagged_events, events_cube) if name == "bench_event_distance_by_hour" else (flagged_trade, trade_cube)
        found |= {name: _bench(name, of_cube), f"{name}_of_rows": _bench(name, of_rows)}
    return found | {
        "reconciliation": lambda s, d: w.reconciliation(flagged_trade(s, d), min_trips=2),
        "reconciliation_by_hundreds": lambda s, d: w.reconciliation(flagged_trade(s, d), places=-2),
        "rule_sample": lambda s, d: flags.sample(flagged_trade(s, d), TRADE, "excessive_fare", 10).select("raw_id", "fare", "distance"),
        "browse_flagged": _browse("flagged"),
        "browse_clean": _browse("clean"),
        "browse_all_with_raw": _browse_file,
        "file_accounting": _file_accounting,
        "malformed_lines": _malformed_lines,
        "cast_losses": _cast_losses,
        "headline_of_added_files": lambda s, d: w.headline(added_files(s, d), FILE),
        "rules_of_added_files": lambda s, d: flags.summary(added_files(s, d), FILE).select("rule", "flagged"),
        "busiest_zones_of_added_files": lambda s, d: w.busiest_zones(added_files(s, d), FILE),
        "browse_rule": _browse("excessive_fare"),
        "browse_count": _trade(flags.browse_count),
        "derive_thresholds": lambda s, d: flags.derive_thresholds(flagged_trade(s, d)),
        "flag_rows": lambda s, d: flagged_trade(s, d).select("raw_id", "issue_count", *(r.flag for r in TRIPS.rules)),
        "enrich_left_join": lambda s, d: _landed(s, d)[0].select("raw_id", "pu_borough", "pu_zone", "do_borough", "do_zone"),
        "derived_columns": _derived,
        "profile_raw": lambda s, d: transform.profile_raw(landed_trade(s, d)),
        "landing_cast": _landing,
        "rejects": lambda s, d: transform.first_rejects(_landed(s, d)[1], 50),
        "tariff_fit": _tariff_fit,
        "tariff_errors": _tariff_errors,
        "tariff_gap_udf": lambda s, d: _tariff_gap(s, d, True),
        "tariff_gap": lambda s, d: _tariff_gap(s, d, False),
        "tariff_gap_sql_function": _tariff_gap_sql,
        "flat_fare_mode": _flat_fares,
    }
