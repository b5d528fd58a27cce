"""The trade tables and the event stream read as trips, so that every workflow runs over them.

A line of an order is a trip: from the customer's nation to the supplier's, from the order's date to the
ship date, in days; the quantity is its distance, the price its fare, the discount its tip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import cube
from siltstone.operators.flags import apply_rules
from siltstone.operators.registry import Registry
from siltstone.operators.transform import cast_and_enrich
from siltstone.plans.build import TRIP_COLUMNS, ZONE_COLUMNS, append, build, cubed
from siltstone.plans.rules import TRIPS
from siltstone.plans.workflows import CUBE
from siltstone.sources import landing
from siltstone.sources.scratch import exists, kept, scratch_dir, there
from siltstone.sources.versions import version

TRADE = TRIPS.with_limits(min_minutes=10, max_minutes=1800, max_distance=48, max_fare=95000, max_mph=4, min_mph=0.004, total_tolerance=100, max_tip_ratio=0.095, period_start="1993-01-01 00:00:00", period_end="1998-01-01 00:00:00")
EVENTS = TRIPS.with_limits(period_start="2024-01-02 00:00:00", period_end="2024-01-29 00:00:00", max_fare=90, max_mph=1000)
FILE = EVENTS.with_limits(max_mph=500)

def _nothing() -> Column:
    return F.lit(0).cast("decimal(12,2)")


def _rates(fact: DataFrame) -> DataFrame:
    """Days stand for minutes here, so the speed is distance over days."""
    return fact.withColumns(
        {
            "mph": F.when(F.col("minutes") > 0, F.col("distance").cast("double") / F.col("minutes").cast("double")),
            "tip_pct": F.when(F.col("fare") > 0, 100 * F.col("tip").cast("double") / F.col("fare").cast("double")),
        }
    )


def _derived(fact: DataFrame) -> DataFrame:
    return _rates(fact).withColumns(
        {
            "pickup_date": F.to_date("pickup_ts"),
            "month": F.month("pickup_ts"),
            "dow": F.dayofweek("pickup_ts"),
            "hour": F.hour("pickup_ts"),
        }
    )


#: Rows of a part of the join of lines and orders, about: their number follows the tables, so no task's memory does.
PART_ROWS = 300_000


def _parts(*tables: DataFrame) -> int:
    """Parts that the tables are dealt to, together. The counts come from the files' footers."""
    return -(-sum(t.count() for t in tables) // PART_ROWS)


def _dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """By the key to so many parts, where the session's own number of them (which Spark may lower) is too low."""
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def trade_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders are dealt once by the order's key, with nothing that can be had afterwards; an order's side of a part is hashed, so nothing is sorted.

    Nation and region have 25 and 5 rows; Spark sees their size and broadcasts them.
    """
    line, order, customer, supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def side(s: str) -> DataFrame:
        return places.select(F.col("n_nationkey").alias(f"{s}_nation"), F.col("r_name").alias(f"{s}_borough"), F.col("n_name").alias(f"{s}_zone"))

    parts, price = _parts(line, order), F.col("l_extendedprice").cast("decimal(12,2)")
    discount, tax = (F.col(c).cast("decimal(4,2)") for c in ("l_discount", "l_tax"))
    lines = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_returnflag", F.col("l_quantity").cast("decimal(10,2)").alias("distance"),
        price.alias("fare"), discount.alias("discount"), tax.alias("tax"), "s_nationkey",
    )
    orders = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_type"), "c_nationkey")
    rows = _dealt(lines, "l_orderkey", parts).join(_dealt(orders, "o_orderkey", parts).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(side("pu"), F.col("c_nationkey") == F.col("pu_nation")).join(side("do"), F.col("s_nationkey") == F.col("do_nation"))
    price, discount, tax = F.col("fare"), F.col("discount"), F.col("tax")
    tip = (price * discount).cast("decimal(12,2)")
    fact = rows.select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("raw_id"),
        F.col("o_orderdate").alias("pickup_ts"),
        F.col("l_shipdate").alias("dropoff_ts"),
        F.datediff("l_shipdate", "o_orderdate").cast("decimal(18,2)").alias("minutes"),
        "distance",
        "fare",
        tip.alias("tip"),
        (price * (1 - discount) * (1 + tax)).cast("decimal(12,2)").alias("total"),
        (-2 * tip).cast("decimal(12,2)").alias("extra"),
        (price * tax).cast("decimal(12,2)").alias("mta_tax"),
        _nothing().alias("tolls"),
        _nothing().alias("improvement"),
        F.when(F.col("l_linenumber") != 3, _nothing()).alias("congestion"),
        (F.col("l_linenumber") - 1).alias("passengers"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3).alias("rate_code"),
        "payment_type",
        "pu_borough", "pu_zone", "do_borough", "do_zone",
    )
    return _derived(fact)


def event_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a trip of one mile and one minute, its value the fare."""
    value, one = F.col("value").cast("decimal(12,2)"), F.lit(1)
    kind = F.col("event_type")
    columns = {
        "raw_id": F.col("event_id"), "pickup_ts": F.col("ts"), "dropoff_ts": F.col("ts"), "minutes": one.cast("decimal(18,2)"), "distance": one.cast("decimal(10,2)"), "fare": value, "tip": _nothing(), "total": value,
        "extra": _nothing(), "mta_tax": _nothing(), "tolls": _nothing(), "improvement": _nothing(), "congestion": _nothing(), "passengers": one, "rate_code": one, "payment_type": one,
        "pu_borough": kind, "pu_zone": kind, "do_borough": kind, "do_zone": kind,
    }
    return _derived(spark.read.parquet(f"{sf_dir}/events.parquet").select(*(c.alias(n) for n, c in columns.items())))


#: (application, folder, what) -> the version of the files that it was made of, the stored table, and where.
_facts: dict[tuple[str, str, str], tuple[str, DataFrame, str]] = {}
TRADE_TABLES, EVENT_TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "region"), ("events",)


def version_of(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    return version(spark, *(f"{sf_dir}/{t}.parquet" for t in tables))


def _once(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Built and stored once for each version of the files; whatever asks for it after that reads the stored one.

    What was made of older files is left to the plans that read it, and goes at exit.
    """
    key, now = (spark.sparkContext.applicationId, sf_dir, name), version_of(spark, sf_dir, tables)
    if key not in _facts or _facts[key][0] != now or not there(_facts[key][2]):
        _facts[key] = (now, *kept(build(), partition_by))
    return _facts[key][1]


def flagged_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as it is joined: it is asked as a whole, so it isn't worth a further shuffle and sort of whole rows (``clustered``) as a published table is.

    The two rates are most of a stored row and are had from its other columns.
    """
    return _rates(_once(spark, sf_dir, "trade", TRADE_TABLES, lambda: apply_rules(trade_fact(spark, sf_dir), TRADE).drop("mph", "tip_pct")))


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "events", EVENT_TABLES, lambda: apply_rules(event_fact(spark, sf_dir), EVENTS))


def _cube(fact: DataFrame, registry: Registry) -> DataFrame:
    return cube.build(fact, registry, CUBE, cube.numbers(fact.select(F.col(CUBE.distinct).alias("name"))))


def trade_cube(spark: SparkSession, sf_dir: str) -> cube.Cube:
    return cube.Cube(_once(spark, sf_dir, "trade cube", TRADE_TABLES, lambda: _cube(flagged_trade(spark, sf_dir), TRADE), ("grain",)), TRADE)


def events_cube(spark: SparkSession, sf_dir: str) -> cube.Cube:
    return cube.Cube(_once(spark, sf_dir, "events cube", EVENT_TABLES, lambda: _cube(flagged_events(spark, sf_dir), EVENTS), ("grain",)), EVENTS)


def landed_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as landed text, some of it broken by rule: what the landing path is run on."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shape = F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")
    bad = F.when(F.col("event_id") % 97 == 0, F.lit("2024-01-01")).when(F.col("event_id") % 89 == 0, F.lit("99/01/2024 01:00:00 AM")).when(F.col("event_id") % 83 == 0, F.lit(None)).otherwise(shape)
    money = F.col("value").cast("decimal(12,2)").cast("string")
    text = F.when(F.col("event_id") % 31 == 0, F.lit("1,234.50")).when(F.col("event_id") % 37 == 0, F.lit("abc")).when(F.col("event_id") % 41 == 0, F.lit(None)).otherwise(money)
    none = F.lit(None).cast("string")
    pickup, dropoff = (F.col("user_id") % 30).cast("string"), (F.col("event_id") % 28).cast("string")
    return e.select(
        F.col("event_id").alias("raw_id"), bad.alias("pickup"), shape.alias("dropoff"), none.alias("ehail_fee"), F.lit("N").alias("store_and_fwd"),
        *(F.lit("1").alias(c) for c in ("vendor", "rate_code", "payment_type", "trip_type", "passengers")),
        *(F.lit("0").alias(c) for c in ("extra", "mta_tax", "tip", "tolls", "improvement", "congestion")),
        text.alias("distance"), text.alias("fare"), text.alias("total"), pickup.alias("pu_location"), dropoff.alias("do_location"),
    )


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension for the landed events: nations by key. Ids from 25 on are unknown."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.select(F.col("n_nationkey").alias("location_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"), F.lit("x").alias("service_zone"))


def _csv_field(text: Column) -> Column:
    """Nulls as empty fields, commas in quotes."""
    return F.coalesce(F.when(text.contains(","), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text), F.lit(""))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): the events as lines of a trip file, some of them broken by rule; the vendor is the event's number.

    A line has a field too few where 101 divides the number, and one too many where 103 does.
    """
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    # A file of few row groups is read by few tasks, but the texts are made by all.
    e = e.select(k, "user_id", "ts", "value").repartition(k)
    shape = "MM/dd/yyyy hh:mm:ss a"
    dropoff = F.date_format(F.timestamp_add("SECOND", (k % 50) * 60 + 5, F.col("ts")), shape)
    pickup = F.when(k % 97 == 0, "2024-01-01").when(k % 89 == 0, "99/01/2024 01:00:00 AM").when(k % 83 != 0, F.date_format("ts", shape))
    money = F.when(k % 31 == 0, "1,234.50").when(k % 37 == 0, "abc").when(k % 41 != 0, F.col("value").cast("decimal(12,2)").cast("string"))
    # Each text that takes work is made once, a few to a step: Java compiles no method of over 8,000 bytes, and one that isn't compiled takes many times as long.
    e = e.select(k, "user_id", pickup.alias("pickup"), dropoff.alias("dropoff"), money.alias("money")).select("*", _csv_field(F.col("money")).alias("amount"))
    values = {
        "vendor": k.cast("string"), "pickup": F.col("pickup"), "dropoff": F.col("dropoff"), "store_and_fwd": F.lit("N"), "rate_code": F.lit("1"),
        "pu_location": (F.col("user_id") % 30).cast("string"), "do_location": (k % 28).cast("string"), "passengers": (k % 4).cast("string"),
        "distance": (k % 160).cast("string"), "fare": F.col("amount"), "extra": F.lit("0"), "mta_tax": F.lit("0"), "tip": (k % 10).cast("string"), "tolls": F.lit("0"),
        "ehail_fee": F.lit(None).cast("string"), "improvement": F.lit("0"), "total": F.col("amount"), "payment_type": (1 + k % 6).cast("string"), "trip_type": F.lit("1"), "congestion": F.lit(None).cast("string"),
    }
    *fields, last = (F.coalesce(values[c], F.lit("")) for c in TRIP_COLUMNS)
    rest = F.when(k % 101 == 0, "").when(k % 103 == 0, F.concat(F.lit(","), last, F.lit(",more"))).otherwise(F.concat(F.lit(","), last))
    return e.select(F.concat(F.concat_ws(",", *fields), rest).alias("line"))


def write_lines(lines: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Text files of the lines, each below the trip file's header; in a folder for each value of ``partition_by``. Lines have no control characters, so no field is quoted here."""
    header = ",".join(TRIP_COLUMNS.values())
    lines.select(F.col("line").alias(header), *partition_by).write.partitionBy(*partition_by).options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)


#: (application, folder) -> the version of the events, and what was landed from their file.
_landed: dict[tuple[str, str], tuple[str, landing.Landed, str]] = {}


def landed_file(spark: SparkSession, sf_dir: str) -> landing.Landed:
    """The events written as a delimited file and landed from it, once for each version of the events."""
    key, now = (spark.sparkContext.applicationId, sf_dir), version_of(spark, sf_dir, EVENT_TABLES)
    if key not in _landed or _landed[key][0] != now or not there(_landed[key][2]):
        path = scratch_dir(spark)
        write_lines(event_lines(spark, sf_dir), f"{path}/file")
        _landed[key] = (now, landing.keep_landed(landing.land_csv(spark, f"{path}/file", TRIP_COLUMNS), f"{path}/raw", id_col="vendor"), path)
    return _landed[key][1]


def typed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed file's rows typed, enriched and flagged."""
    return apply_rules(cast_and_enrich(landed_file(spark, sf_dir).raw, nation_zones(spark, sf_dir))[0], FILE)


#: (application, folder) -> the versions of the files, and where the trips of two files are published.
_added: dict[tuple[str, str], tuple[str, str]] = {}


def added_files(spark: SparkSession, sf_dir: str) -> cube.Cube:
    """The cube of two trip files, of which the second was added to what had been built of the first."""
    key, now = (spark.sparkContext.applicationId, sf_dir), version_of(spark, sf_dir, ("events", "nation", "region"))
    if key not in _added or _added[key][0] != now or not there(_added[key][1]):
        path, later = scratch_dir(spark), F.col("line").rlike("^[0-9]*[02468],")
        write_lines(event_lines(spark, sf_dir).withColumn("later", later), f"{path}/lines", ("later",))
        first, second = (f"{path}/lines/later={x}" for x in ("false", "true"))
        for file in (first, second):
            if not exists(spark, file):  # there are no lines for it
                write_lines(spark.createDataFrame([], "line string"), file)
        nation_zones(spark, sf_dir).withColumnsRenamed(ZONE_COLUMNS).write.option("header", True).csv(f"{path}/zones")
        limits = FILE.limits()
        build(spark, first, f"{path}/zones", f"{path}/out", limits)
        append(spark, second, f"{path}/out", limits)
        _added[key] = (now, path)
    return cubed(spark, f"{_added[key][1]}/out")
