"""A fare model: least squares on distance and time, flat fares by rate code, deployed as a UDF, an expression or a SQL function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.expressions import mean, percent
from siltstone.operators.ranks import percentiles
from siltstone.operators.registry import strict
from siltstone.sources import snapshots

METERED, FLAT_CODES, OFF_TARIFF = 1, (2,), 5.00


@dataclass(frozen=True)
class Tariff:
    base: float
    per_mile: float
    per_minute: float
    flat: dict[int, float]
    rows_fitted: int
    median_error: float
    p95_error: float


@dataclass(frozen=True)
class Bounds:
    miles: tuple[float, float] = (0.1, 30)
    minutes: tuple[float, float] = (1, 120)


def fitted_rows(fact: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    return fact.where((F.col("rate_code") == METERED) & strict() & F.col("distance").between(*bounds.miles) & F.col("minutes").between(*bounds.minutes) & (F.col("fare") > 0))


def solve(x: float, z: float, y: float, xx: float, xz: float, zz: float, xy: float, zy: float) -> tuple[float, float, float]:
    """Intercept and slopes from means and (co)variances; a predictor that doesn't vary, or only as the other does, gets slope 0."""
    det = xx * zz - xz * xz
    if xx > 0 and zz > 0 and det > 1e-9 * xx * zz:
        a, b = (xy * zz - zy * xz) / det, (zy * xx - xy * xz) / det
    else:
        a, b = (xy / xx, 0.0) if xx > 0 else (0.0, zy / zz if zz > 0 else 0.0)
    return y - a * x - b * z, a, b


def moments(rows: DataFrame, x: Column, z: Column, y: Column) -> tuple[int, list[float]]:
    """The number of rows, and what ``solve`` takes. Spark merges moments about the means, so nothing cancels however far the values are from zero."""
    x, z, y = (c.cast("double") for c in (x, z, y))
    figures = [F.avg(x), F.avg(z), F.avg(y), F.var_pop(x), F.covar_pop(x, z), F.var_pop(z), F.covar_pop(x, y), F.covar_pop(z, y)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(f.alias(f"m{k}") for k, f in enumerate(figures))).first()
    return found["n"], [found[f"m{k}"] for k in range(8)]


def calibrate(fact: DataFrame, bounds: Bounds = Bounds()) -> Tariff:
    """``fact`` is read several times, for moments, errors and flat fares, so it is best stored."""
    rows = fitted_rows(fact, bounds)
    x, z, y = F.col("distance"), F.col("minutes"), F.col("fare")
    n, found = moments(rows, x, z, y)
    if not n:
        raise RuntimeError("no rows to fit the tariff on")
    base, per_mile, per_minute = solve(*found)
    off = F.abs(y.cast("double") - (base + per_mile * x.cast("double") + per_minute * z.cast("double")))
    median, p95 = percentiles(rows, off, n, [0.5, 0.95])
    modes = flat_fares(fact).collect()
    return Tariff(base, per_mile, per_minute, {r["rate_code"]: float(r["fare"]) for r in modes}, n, median, p95)


def flat_fares(fact: DataFrame, codes: tuple[int, ...] = FLAT_CODES) -> DataFrame:
    """The most frequent positive fare of each flat code; of equally frequent ones the least."""
    counts = fact.where(F.col("rate_code").isin(*codes) & (F.col("fare") > 0)).groupBy("rate_code", "fare").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("rate_code").agg(F.max_by("fare", F.struct("n", -F.col("fare"))).alias("fare"))


def fares(tariff: Tariff, code: np.ndarray, miles: np.ndarray, minutes: np.ndarray) -> np.ndarray:
    """The tariff over whole columns; what is no number stands for null. Halves of a cent go up, as in SQL."""
    base, per_mile, per_minute = (round(v, 6) for v in (tariff.base, tariff.per_mile, tariff.per_minute))
    metered = np.maximum(base + per_mile * miles + per_minute * minutes, 0.0)
    out = np.where(code == METERED, np.floor(np.round(metered * 100, 6) + 0.5) / 100, np.nan)
    for flat_code, fare in tariff.flat.items():
        out = np.where(code == flat_code, fare, out)
    return out


def python_fare(tariff: Tariff) -> Callable[[int | None, float | None, float | None], float | None]:
    """The function that is deployed as a UDF, for direct calls."""

    def expected(*values: float | None) -> float | None:
        found = fares(tariff, *(np.array([np.nan if v is None else v], float) for v in values))[0]
        return None if np.isnan(found) else float(found)

    return expected


def deploy(spark: SparkSession, tariff: Tariff, name: str = "expected_fare") -> Callable[..., Column]:
    """Registers the model for SQL, by Arrow batches, and returns it for DataFrames."""

    @F.pandas_udf("double")
    def udf(code: pd.Series, miles: pd.Series, minutes: pd.Series) -> pd.Series:
        found = pd.Series(fares(tariff, *(c.to_numpy(float, na_value=np.nan) for c in (code, miles, minutes))))
        return found.astype("Float64").where(found.notna())

    spark.udf.register(name, udf)
    return udf


_SCHEMA = "base double, per_mile double, per_minute double, flat map<int,double>, rows_fitted long, median_error double, p95_error double"


def publish(spark: SparkSession, tariff: Tariff, path: str) -> None:
    """Stores the tariff as the newest version of the table at ``path``, for other sessions."""
    snapshots.publish(spark.createDataFrame([astuple(tariff)], _SCHEMA), path)


def published(spark: SparkSession, path: str) -> Tariff:
    return Tariff(**snapshots.current(spark, path).first().asDict())


def deploy_sql(spark: SparkSession, tariff: Tariff, name: str = "tariff_fare", lasting: bool = False) -> None:
    """Defines the tariff as a SQL function, which the optimiser puts into the query that calls it: no Python, no fit.

    ``lasting``: in the catalog, and so for every session where the catalog outlives them; else for this session.
    """
    cases = "".join(f" WHEN code = {code} THEN {fare!r}D" for code, fare in tariff.flat.items())
    base, per_mile, per_minute = (f"{round(v, 6)!r}D" for v in (tariff.base, tariff.per_mile, tariff.per_minute))
    metered = f"round(greatest({base} + {per_mile} * miles + {per_minute} * minutes, 0D), 2)"
    kind = "FUNCTION" if lasting else "TEMPORARY FUNCTION"
    spark.sql(f"""CREATE OR REPLACE {kind} {name}(code INT, miles DOUBLE, minutes DOUBLE) RETURNS DOUBLE
                  RETURN CASE{cases} WHEN code = {METERED} AND miles IS NOT NULL AND minutes IS NOT NULL THEN {metered} END""")


def expected_fare(tariff: Tariff) -> Column:
    """The same as an expression; it stays on the JVM."""
    base, per_mile, per_minute = (F.lit(round(v, 6)) for v in (tariff.base, tariff.per_mile, tariff.per_minute))
    metered = base + per_mile * F.col("distance").cast("double") + per_minute * F.col("minutes").cast("double")
    out = F.when((F.col("rate_code") == METERED) & metered.isNotNull(), F.round(F.greatest(metered, F.lit(0.0)), 2))
    for code, fare in tariff.flat.items():
        out = F.when(F.col("rate_code") == code, F.lit(fare)).otherwise(out)
    return out


def tariff_rows(fact: DataFrame, codes: tuple[int, ...] = (METERED, *FLAT_CODES)) -> DataFrame:
    """The rows that the tariff can be held against."""
    return fact.where(F.col("rate_code").isin(*codes) & strict() & (F.col("fare") > 0))


def gap_by_rate_code(fact: DataFrame, expected: Column, codes: tuple[int, ...] = (METERED, *FLAT_CODES)) -> DataFrame:
    """How far fares are from the tariff. The gap is rounded before it meets the threshold."""
    rows = tariff_rows(fact, codes)
    gaps = rows.select("rate_code", F.round(F.abs(F.col("fare").cast("double") - expected), 2).cast("decimal(18,2)").alias("gap"))
    out = gaps.groupBy("rate_code").agg(F.count(F.lit(1)).alias("trips"), mean(F.col("gap"), 2).alias("mean_gap"), F.count_if(F.col("gap") > OFF_TARIFF).alias("off_tariff"))
    return out.withColumn("pct_off_tariff", percent(F.col("off_tariff"), F.col("trips"), 2)).orderBy("rate_code")
