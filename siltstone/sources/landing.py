"""Landing delimited text as strings: nothing can fail here, columns are matched by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources import snapshots

#: The column that holds a line whose number of fields isn't the header's; null for the others.
LINE = "line"


def land_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """``columns``: target -> header name; and ``line``. Empty fields are null. A header that lacks one of them raises, in a folder so do files with other headers."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := set(columns.values()) - set(header):
        raise KeyError(f"the file has no columns {sorted(missing)}")
    if LINE in columns or LINE in header:
        raise KeyError(f"{LINE} is the name of the column for malformed lines")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, LINE)])
    read = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, enforceSchema=False).schema(schema).csv(path)
    return read.select(*(F.col(f"`{source}`").alias(target) for target, source in columns.items()), LINE)


class Landed(NamedTuple):
    """``raw``: the well-formed rows; ``malformed``: (raw_id, line); ``counts``: of lines that were ``read`` and are ``malformed``."""

    raw: DataFrame
    malformed: DataFrame
    counts: dict[str, int]


def keep_landed(df: DataFrame, path: str, id_col: str | None = None, write: Callable[..., DataFrame] = snapshots.publish, first_id: int = 0) -> Landed:
    """Writes what ``land_csv`` gives as a new version (or adds it, as ``write`` does), in one pass that counts and sets malformed lines apart.

    A raw_id stays with each row from then on: the source's own number where ``id_col`` names it, else a new one
    from ``first_id`` on.
    """
    number = F.monotonically_increasing_id() + first_id if id_col is None else F.col(id_col).try_cast("long")
    seen = Observation()
    rows = df.withColumns({"raw_id": number, "is_malformed": F.col(LINE).isNotNull()})
    counts = [F.count(F.lit(1)).alias("read"), F.count_if("is_malformed").alias("malformed")]
    kept = write(rows.observe(seen, *counts), path, ("is_malformed",))
    return Landed(kept.where("NOT is_malformed").drop("is_malformed", LINE), kept.where("is_malformed").select("raw_id", LINE), seen.get)


def diagnostics(landed: Landed, limit: int = 100) -> DataFrame:
    """Lines whose number of fields isn't the header's, as many as ``limit``, in order; from the table that the landing has set them apart in."""
    return landed.malformed.select(LINE).orderBy(LINE).limit(limit)


def zones(raw: DataFrame) -> DataFrame:
    """The dimension: location_id, borough, zone, service_zone; rows without a numeric id go."""
    return raw.select(F.col("location_id").try_cast("int").alias("location_id"), "borough", "zone", "service_zone").where("location_id is not null")
