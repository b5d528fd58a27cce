"""From landed text to the typed, derived and enriched fact, with every row accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.functions.expressions import STAMP_SHAPE, number, percent, stamp, whole

MONEY = ("fare", "extra", "mta_tax", "tip", "tolls", "improvement", "total", "congestion")
INTEGERS = ("vendor", "rate_code", "pu_location", "do_location", "passengers", "payment_type", "trip_type")
PROFILED = ("distance", "fare", "total", "tip", "passengers", "congestion")


def derive(fact: DataFrame) -> DataFrame:
    """Adds minutes, mph, tip_pct and the parts of pickup_ts to a fact with pickup_ts, dropoff_ts, distance, fare and tip."""
    seconds = F.timestamp_diff("SECOND", F.col("pickup_ts"), F.col("dropoff_ts"))
    exact = seconds / 60.0
    hours = F.col("distance").cast("double") / (exact / 60.0)
    return fact.withColumns(
        {
            "minutes": exact.cast("decimal(18,2)"),
            "mph": F.when(exact > 0, hours).cast("decimal(18,2)"),
            "tip_pct": F.when(F.col("fare") > 0, 100 * F.col("tip").cast("double") / F.col("fare").cast("double")).cast("decimal(18,2)"),
            "pickup_date": F.to_date("pickup_ts"),
            "hour": F.hour("pickup_ts"),
            "dow": F.dayofweek("pickup_ts"),
            "month": F.month("pickup_ts"),
        }
    )


def enrich(fact: DataFrame, zones: DataFrame) -> DataFrame:
    """Borough and zone of both ends; 'Unknown' where the dimension lacks the id. The dimension has 265 rows and is broadcast if Spark finds it small."""
    for side in ("pu", "do"):
        named = zones.select(F.col("location_id").alias(f"{side}_location"), F.col("borough").alias(f"__{side}_b"), F.col("zone").alias(f"__{side}_z"))
        fact = fact.join(named, f"{side}_location", "left")
        fact = fact.withColumns({f"{side}_borough": F.coalesce(f"__{side}_b", F.lit("Unknown")), f"{side}_zone": F.coalesce(f"__{side}_z", F.lit("Unknown"))}).drop(f"__{side}_b", f"__{side}_z")
    return fact


class Accounting:
    """What became of the landed rows, counted in the pass that casts them. ``check`` waits for that pass to end."""

    def __init__(self) -> None:
        self._read, self._kept = Observation(), Observation()

    def reads(self, typed: DataFrame, exists: Column) -> DataFrame:
        return typed.observe(self._read, F.count(F.lit(1)).alias("landed"), F.count_if(~exists).alias("rejected"))

    def keeps(self, fact: DataFrame) -> DataFrame:
        return fact.observe(self._kept, F.count(F.lit(1)).alias("kept"))

    def check(self) -> dict[str, int]:
        """landed, kept and rejected; raises if a row is lost or there twice."""
        found = self._read.get | self._kept.get
        if found["landed"] != found["kept"] + found["rejected"]:
            raise RuntimeError("{landed} rows landed, {kept} kept and {rejected} rejected".format(**found))
        return found


def cast_and_enrich(raw: DataFrame, zones: DataFrame, check: bool = True, accounting: Accounting | None = None) -> tuple[DataFrame, DataFrame]:
    """(fact, rejects). A row is rejected if a time is missing, has the wrong shape or doesn't exist, and kept once otherwise.

    ``check`` sees to that without reading the landed rows; ``accounting`` counts them as the fact is written.
    """
    typed = raw.withColumns({"pickup_ts": stamp(F.col("pickup")), "dropoff_ts": stamp(F.col("dropoff"))})
    shaped = F.coalesce(F.col("pickup").like(STAMP_SHAPE) & F.col("dropoff").like(STAMP_SHAPE), F.lit(False))
    exists = F.col("pickup_ts").isNotNull() & F.col("dropoff_ts").isNotNull()
    reason = F.when(F.col("pickup").isNull() | F.col("dropoff").isNull(), "missing timestamp").when(~shaped, "timestamp of another shape").otherwise("no such time")
    rejects = typed.where(~exists).select("raw_id", reason.alias("reason"), "pickup", "dropoff")
    columns = [*(number(F.col(c)).alias(c) for c in MONEY), *(whole(F.col(c)).alias(c) for c in INTEGERS), number(F.col("distance"), "decimal(10,2)").alias("distance")]
    read = accounting.reads(typed, exists) if accounting else typed
    fact = enrich(derive(read.where(exists).select("raw_id", "pickup_ts", "dropoff_ts", "store_and_fwd", *columns)), zones)
    if check:
        # Each landed row is kept or rejected by one condition, so only an id that the dimension has twice could add rows.
        twice = zones.where("location_id is not null").groupBy("location_id").count().where("count > 1").limit(5).collect()
        if twice:
            raise RuntimeError(f"the dimension has ids several times: {sorted(r['location_id'] for r in twice)}")
    return accounting.keeps(fact) if accounting else fact, rejects


def first_rejects(rejects: DataFrame, limit: int = 20) -> DataFrame:
    return rejects.orderBy("raw_id").limit(limit)


def profile_checks() -> list[tuple[str, Column]]:
    def parses(c: Column) -> Column:
        return c.try_cast("decimal(38,10)").isNotNull()

    shaped = F.coalesce(F.col("pickup").like(STAMP_SHAPE) & F.col("dropoff").like(STAMP_SHAPE), F.lit(False))
    checks = [("timestamps of another shape", ~shaped)]
    checks += [(f"{c} missing", F.col(c).isNull()) for c in ("ehail_fee", "passengers", "store_and_fwd", "congestion")]
    bare = {c: F.replace(F.col(c), F.lit(","), F.lit("")) for c in PROFILED}
    checks += [(f"{c}: thousands separated by commas", F.col(c).isNotNull() & ~parses(F.col(c)) & parses(bare[c])) for c in PROFILED]
    return checks + [(f"{c}: no number even without commas", F.col(c).isNotNull() & ~parses(bare[c])) for c in PROFILED]


def profile_raw(raw: DataFrame) -> DataFrame:
    """One pass over the landing table: the problems that occur, with rows and their share."""
    checks = profile_checks()
    one = raw.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(f"c{k}") for k, (_, c) in enumerate(checks)))
    items = F.array(*(F.struct(F.lit(name).alias("issue"), F.col(f"c{k}").alias("rows")) for k, (name, _) in enumerate(checks)))
    rows = one.select("total", F.explode(items).alias("x")).select("total", "x.*").where("rows > 0")
    return rows.select("issue", "rows", percent(F.col("rows"), F.col("total"), 3).alias("pct")).orderBy(F.desc("rows"), "issue")


LOSS_COLUMNS = ("distance", *MONEY, "passengers", "rate_code", "payment_type")


def cast_losses(raw: DataFrame, fact: DataFrame) -> DataFrame:
    """Each kept row's text against its value, by raw_id: how many texts there are for each column, and how many became no value.

    Joins whole tables; where both are in buckets by raw_id it shuffles nothing but the counts.
    """
    checked = LOSS_COLUMNS
    texts = raw.select("raw_id", *(F.col(c).alias(f"text_{c}") for c in checked))
    both = fact.select("raw_id", *checked).join(texts, "raw_id")
    counts = [F.struct(F.lit(c).alias("column"), F.count(f"text_{c}").alias("texts"), F.count_if(F.col(f"text_{c}").isNotNull() & F.col(c).isNull()).alias("lost")) for c in checked]
    return both.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))
