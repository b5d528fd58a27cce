"""Push-down against pull-out: the same answers by Spark SQL, by pandas on the driver and by Arrow on the executors.

And three ways to land rows. Answers are compared before any time is reported.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tariff import Tariff, deploy, python_fare, tariff_rows

#: Question: key, value and the rows it is asked of. The last one's value is a fare's distance from the tariff, by the UDF.
QUESTIONS = {"revenue_by_borough": ("pu_borough", "total"), "distance_by_hour": ("hour", "distance"), "flagged_distribution": ("issue_count", "fare"), "fare_vs_tariff": ("rate_code", "gap")}


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns in lower case and order, numbers to 2 places, rows sorted."""
    frame = frame.rename(columns=str.lower)[sorted(c.lower() for c in frame.columns)]
    frame = frame.apply(lambda c: pd.to_numeric(c).astype(float).round(2) if c.map(lambda v: not isinstance(v, str)).all() else c)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _timed(f: Callable[[], pd.DataFrame], repeat: int) -> tuple[float, pd.DataFrame]:
    took, out = [], None
    for _ in range(repeat):
        began = time.perf_counter()
        out = f()
        took.append(time.perf_counter() - began)
    return median(took), out


def _reduced(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.groupby("key", dropna=False)["value"].agg(n="size", total="sum").reset_index()


def _in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _reduced(batch)


def _rows_of(fact: DataFrame, question: str, tariff: Tariff | None) -> DataFrame:
    """(key, value) of the question's rows, in Spark."""
    key, value = QUESTIONS[question]
    if question == "fare_vs_tariff":
        expected = deploy(fact.sparkSession, tariff)(F.col("rate_code"), F.col("distance").cast("double"), F.col("minutes").cast("double"))
        fact = tariff_rows(fact).withColumn("gap", F.round(F.abs(F.col("fare").cast("double") - expected), 2))
    return fact.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))


def _pulled(fact: DataFrame, question: str, tariff: Tariff | None) -> tuple[Callable[[], pd.DataFrame], Callable[[pd.DataFrame], pd.DataFrame]]:
    """The pandas arm's two halves: what fetches the rows to the driver, and what reduces them there."""
    if question != "fare_vs_tariff":
        return _rows_of(fact, question, tariff).toPandas, _reduced
    narrow = tariff_rows(fact).select("rate_code", *(F.col(c).cast("double").alias(c) for c in ("distance", "minutes", "fare")))
    expected = python_fare(tariff)

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        gaps = [round(abs(r.fare - expected(r.rate_code, r.distance, r.minutes)), 2) for r in frame.itertuples()]
        return _reduced(pd.DataFrame({"key": frame["rate_code"], "value": pd.Series(gaps, frame.index, "float64")}))

    return narrow.toPandas, reduce


def compare_aggregation(fact: DataFrame, repeat: int = 3, tariff: Tariff | None = None, most_rows: int = 0) -> pd.DataFrame:
    """A row a question and arm: medians of all, of fetching and of reducing, and the rows that reach the driver.

    The pandas arm measures what pulling the fact's rows to the driver costs, so it runs only where they are at most
    ``most_rows``; by default it doesn't. Without a tariff its question is left out.
    """
    rows, pulls = [], bool(most_rows) and fact.limit(most_rows + 1).count() <= most_rows
    for name in QUESTIONS:
        if name == "fare_vs_tariff" and tariff is None:
            continue
        narrow = _rows_of(fact, name, tariff)
        kind = narrow.schema["key"].dataType.simpleString()
        fetch, reduce = _pulled(fact, name, tariff)
        asked = {
            "sql": narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")),
            "arrow": narrow.mapInPandas(_in_batches, f"key {kind}, n long, total double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")),
        }
        found = {}
        for arm in ("sql", "pandas", "arrow"):
            if arm == "pandas" and not pulls:
                rows.append({"question": name, "arm": arm, "seconds": None, "fetch": None, "reduce": None, "rows_moved": None, "note": f"not run: more than {most_rows} rows"})
                continue
            try:
                if arm == "pandas":
                    fetched, frame = _timed(fetch, repeat)
                    reduced, answer = _timed(lambda: reduce(frame), repeat)
                    found[arm] = (fetched, reduced, len(frame), answer)
                else:
                    seconds, answer = _timed(asked[arm].toPandas, repeat)
                    found[arm] = (seconds, 0.0, len(answer), answer)
            except Exception as error:  # noqa: BLE001  an arm that can't run is reported, the others go on
                rows.append({"question": name, "arm": arm, "seconds": None, "fetch": None, "reduce": None, "rows_moved": None, "note": str(error)[:200]})
        for arm, (fetched, reduced, moved, answer) in found.items():
            pd.testing.assert_frame_equal(normalised(found["sql"][3]), normalised(answer))
            rows.append({"question": name, "arm": arm, "seconds": fetched + reduced, "fetch": fetched, "reduce": reduced, "rows_moved": moved, "note": ""})
    return pd.DataFrame(rows)


def compare_ingest(spark: SparkSession, csv: str, out: str, rows: int = 50_000, batch: int = 5_000, single_rows: int = 20) -> pd.DataFrame:
    """Bulk read, batches through the driver, and a write for each row (few of them), with the seconds that the whole file would take.

    ``rows`` bounds what goes through the driver.
    """
    source = spark.read.option("header", True).csv(csv)
    whole = source.count()
    part = source.limit(rows)
    local = part.toPandas()

    def batches(size: int, most: int) -> int:
        for k in range(0, min(most, len(local)), size):
            piece = local[k : min(k + size, most)].astype(object).where(lambda f: f.notna(), None)
            spark.createDataFrame(piece, source.schema).write.mode("append").parquet(f"{out}/batch{size}")
        return min(most, len(local))

    def bulk() -> int:
        part.write.mode("overwrite").parquet(f"{out}/bulk")
        return len(local)

    report = []
    for name, run in {"bulk": bulk, "batched": lambda: batches(batch, rows), "row at a time": lambda: batches(1, single_rows)}.items():
        began = time.perf_counter()
        n = run()
        seconds = time.perf_counter() - began
        report.append({"approach": name, "rows": n, "seconds": seconds, "rows_per_second": n / seconds, "projected_seconds": whole * seconds / max(n, 1)})
    return pd.DataFrame(report)
