"""python -m siltstone.cli info | profile | quality | analyze | bench, over the trade tables in --data.

And: pipeline --trips CSV --zones CSV --out FOLDER, which builds the flagged fact and fits the tariff from files;
append --trips CSV --out FOLDER, which adds a further file to that; figures --out FOLDER, what is published there.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import flags, tariff, transform
from siltstone.plans import build, catalogue, compare
from siltstone.plans import workflows as w
from siltstone.plans.rules import TRIPS
from siltstone.plans.trade import TRADE, flagged_events, flagged_trade, landed_trade, nation_zones
from siltstone.sources import snapshots
from siltstone.sources.scratch import scratch_dir

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def info(spark: SparkSession, data: str) -> None:
    """Spark's version, the tables with their rows, and the queries."""
    print("Spark", spark.version)
    for name in TABLES:
        try:
            print(f"{name}: {spark.read.parquet(f'{data}/{name}.parquet').count()} rows")
        except AnalysisException as error:
            print(f"{name}: {error.getCondition()}")
    print(*sorted(catalogue.queries()), sep="\n")


def profile(spark: SparkSession, data: str) -> list[DataFrame]:
    raw = landed_trade(spark, data)
    return [transform.profile_raw(raw), transform.first_rejects(transform.cast_and_enrich(raw, nation_zones(spark, data))[1])]


def quality(spark: SparkSession, data: str, derive: bool, rule: str | None) -> list[DataFrame]:
    """With ``derive`` the rows are flagged anew with the thresholds that the data suggest."""
    fact, registry, shown = flagged_trade(spark, data), TRADE, []
    if derive:
        limits = flags.upper_tails(fact)
        registry = TRADE.with_limits(**limits)
        fact = flags.apply_rules(fact, registry)
        shown.append(spark.createDataFrame([(n, float(TRADE.limits()[n]), v) for n, v in limits.items()], "threshold string, was double, derived double"))
    shown += [flags.summary(fact, registry), flags.issue_distribution(fact, registry), flags.measure_coverage(fact, registry)]
    return shown + ([flags.sample(fact, registry, rule)] if rule else [])


def analyze(spark: SparkSession, data: str) -> list[DataFrame]:
    fact, events = flagged_trade(spark, data), flagged_events(spark, data)
    by_place = (w.busiest_zones, w.borough_summary, w.activity_by_dow, w.activity_by_month, w.tipping_by_borough, w.fare_per_mile, w.od_pairs)
    fit = tariff.calibrate(fact, catalogue.BOUNDS)
    return [
        w.headline(fact, TRADE),
        w.cleaning_impact(fact, TRADE),
        flags.measure_coverage(fact, TRADE),
        *(f(fact, TRADE) for f in by_place),
        w.activity_by_hour(events, TRADE),
        w.hourly_heatmap(events, TRADE),
        w.reconciliation(fact, places=-2),
        tariff.gap_by_rate_code(fact, tariff.expected_fare(fit)),
    ]


def figures(spark: SparkSession, out: str) -> list[DataFrame]:
    """From what is published: figures from the cube, and fares against the tariff by its SQL function, if one was fitted."""
    asked = build.cubed(spark, out)
    shown = [w.headline(asked, TRIPS), w.cleaning_impact(asked, TRIPS), flags.summary(asked, TRIPS), w.borough_summary(asked, TRIPS)]
    if snapshots.versions(spark, f"{out}/tariff"):
        tariff.deploy_sql(spark, tariff.published(spark, f"{out}/tariff"))
        expected = F.expr("tariff_fare(rate_code, CAST(distance AS DOUBLE), CAST(minutes AS DOUBLE))")
        shown.append(tariff.gap_by_rate_code(snapshots.current(spark, f"{out}/flagged"), expected))
    return shown


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["info", "pipeline", "append", "figures", "profile", "quality", "analyze", "bench"])
    parser.add_argument("--data", default="/root/testdata/sf0.01")
    parser.add_argument("--sample", metavar="RULE", help="with quality: rows of one rule")
    parser.add_argument("--derive-thresholds", action="store_true", help="with quality: flag by thresholds from the data")
    parser.add_argument("--repeat", type=int, default=3, help="with bench")
    parser.add_argument("--ingest-rows", type=int, default=0, help="with bench: rows of --trips to land in three ways")
    parser.add_argument("--pull-rows", type=int, default=0, help="with bench: rows that may go to the driver for the pandas arm, none by default")
    parser.add_argument("--quiet", action="store_true", help="with pipeline: no report")
    for name in ("trips", "zones", "out"):
        parser.add_argument(f"--{name}", help="with pipeline, append and figures")
    args = parser.parse_args(argv)
    if args.command == "pipeline" and not (args.trips and args.zones and args.out):
        parser.error("pipeline needs --trips, --zones and --out")
    if args.command == "append" and not (args.trips and args.out) or args.command == "figures" and not args.out:
        parser.error("append needs --trips and --out, figures --out")
    if args.ingest_rows and not args.trips:
        parser.error("--ingest-rows needs --trips")
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    shown: list[DataFrame] = []
    if args.command == "info":
        info(spark, args.data)
    elif args.command == "pipeline":
        flagged = build.build(spark, args.trips, args.zones, args.out)
        try:
            fit = tariff.calibrate(flagged)
            tariff.publish(spark, fit, f"{args.out}/tariff")
        except RuntimeError as error:
            fit = error
        if not args.quiet:
            shown = [flags.summary(flagged, TRIPS)]
            print(fit)
    elif args.command == "append":
        print(f"{build.append(spark, args.trips, args.out).count()} trips added")
    elif args.command == "figures":
        shown = figures(spark, args.out)
    elif args.command == "profile":
        shown = profile(spark, args.data)
    elif args.command == "quality":
        shown = quality(spark, args.data, args.derive_thresholds, args.sample)
    elif args.command == "analyze":
        shown = analyze(spark, args.data)
    else:
        fact = flagged_trade(spark, args.data)
        print(compare.compare_aggregation(fact, args.repeat, tariff.calibrate(fact, catalogue.BOUNDS), args.pull_rows).to_string())
        if args.ingest_rows:
            print(compare.compare_ingest(spark, args.trips, scratch_dir(spark), args.ingest_rows).to_string())
    for df in shown:
        df.show(50, False)


if __name__ == "__main__":
    main()
