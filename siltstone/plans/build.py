"""From the files to the flagged fact: land, cast and enrich, flag; each table is published and the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import cube, flags, transform
from siltstone.plans.rules import TRIPS
from siltstone.plans.workflows import CUBE
from siltstone.sources import landing, snapshots
from siltstone.sources.layout import clustered

# The names in the files' headers.
TRIP_COLUMNS = {
    "vendor": "VendorID",
    "pickup": "lpep_pickup_datetime",
    "dropoff": "lpep_dropoff_datetime",
    "store_and_fwd": "store_and_fwd_flag",
    "rate_code": "RatecodeID",
    "pu_location": "PULocationID",
    "do_location": "DOLocationID",
    "passengers": "passenger_count",
    "distance": "trip_distance",
    "fare": "fare_amount",
    "extra": "extra",
    "mta_tax": "mta_tax",
    "tip": "tip_amount",
    "tolls": "tolls_amount",
    "ehail_fee": "ehail_fee",
    "improvement": "improvement_surcharge",
    "total": "total_amount",
    "payment_type": "payment_type",
    "trip_type": "trip_type",
    "congestion": "congestion_surcharge",
}
ZONE_COLUMNS = {"location_id": "LocationID", "borough": "Borough", "zone": "Zone", "service_zone": "service_zone"}


def _landed(spark: SparkSession, trips: str, out: str, write: Callable[..., DataFrame], first_id: int) -> DataFrame:
    """Lands a trip file, types it and returns the kept trips. Rows are counted as they are written; counts that don't agree raise."""
    landed = landing.keep_landed(landing.land_csv(spark, trips, TRIP_COLUMNS), f"{out}/raw", write=write, first_id=first_id)
    accounting, gone = transform.Accounting(), Observation()
    fact, rejects = transform.cast_and_enrich(landed.raw, snapshots.current(spark, f"{out}/zones"), check=False, accounting=accounting)
    fact = write(fact, f"{out}/trips")
    write(rejects.observe(gone, F.count(F.lit(1)).alias("rejected")), f"{out}/rejects")
    counts = accounting.check()
    if counts["rejected"] != gone.get["rejected"] or counts["landed"] != landed.counts["read"] - landed.counts["malformed"]:
        raise RuntimeError(f"{landed.counts} lines landed, {counts} cast and {gone.get['rejected']} written as rejected")
    return fact


def build(spark: SparkSession, trips: str, zones: str, out: str, overrides: dict | None = None) -> DataFrame:
    """Publishes raw, zones, trips, rejects, flagged and the cube below ``out`` and returns the flagged trips."""
    snapshots.publish(landing.zones(landing.keep_landed(landing.land_csv(spark, zones, ZONE_COLUMNS), f"{out}/raw_zones").raw), f"{out}/zones")
    _landed(spark, trips, out, snapshots.publish, 0)
    return reflag(spark, out, overrides)


def reflag(spark: SparkSession, out: str, overrides: dict | None = None) -> DataFrame:
    """Flags the stored trips anew, say under other thresholds; the files aren't read again, and who reads the flagged trips now isn't disturbed."""
    flagged = flags.apply_rules(snapshots.current(spark, f"{out}/trips"), TRIPS, overrides)
    before = snapshots.versions(spark, f"{out}/flagged")
    frequent_first = [r["rule"] for r in flags.summary(cubed(spark, out), TRIPS).collect()] if before else None
    flagged = snapshots.publish(clustered(flagged, TRIPS, frequent_first=frequent_first), f"{out}/flagged", ("month",))
    numbers = snapshots.publish(cube.numbers(flagged.select(F.col(CUBE.distinct).alias("name"))), f"{out}/names")
    snapshots.publish(cube.build(flagged, TRIPS, CUBE, numbers), f"{out}/cube", ("grain",))
    return flagged


def append(spark: SparkSession, trips: str, out: str, overrides: dict | None = None) -> DataFrame:
    """Adds a further file, a day's say, to what ``build`` has published, and returns its flagged trips.

    Only the file's rows are landed, typed, flagged and added up; their cube is merged into the one there is. The
    ``overrides`` are those that the others were flagged with.
    """
    last = snapshots.current(spark, f"{out}/raw").agg(F.max("raw_id")).first()[0]
    fact = _landed(spark, trips, out, snapshots.add, 0 if last is None else last + 1)
    flagged = snapshots.add(clustered(flags.apply_rules(fact, TRIPS, overrides), TRIPS), f"{out}/flagged", ("month",))
    names = flagged.select(F.col(CUBE.distinct).alias("name"))
    numbers = snapshots.publish(cube.numbers(names, snapshots.current(spark, f"{out}/names")), f"{out}/names")
    both = [snapshots.current(spark, f"{out}/cube"), cube.build(flagged, TRIPS, CUBE, numbers)]
    snapshots.publish(cube.merge(both, CUBE), f"{out}/cube", ("grain",))
    return flagged


def cubed(spark: SparkSession, out: str) -> cube.Cube:
    """What has been published, to ask for figures."""
    return cube.Cube(snapshots.current(spark, f"{out}/cube"), TRIPS)
