"""Tables that can be replaced, or added to, while others read them.

Data lie in folders that are never written again. A version is a small file that lists the folders which
make it up; it appears under its name all at once, after they are written. Readers take the newest version and
stay with it; a writer that is killed leaves a folder that no version lists. Adding rows writes a folder and a
version that lists it beside those of the version before, so nothing is copied. Of two writers at once both
versions are whole, and the later name's is the current one; who adds at once with another is told so.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSIONS = "_versions"


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the table's versions, oldest first; none if it was never published."""
    fs, target = _at(spark, f"{path}/{VERSIONS}")
    if not fs.exists(target):
        return []
    return sorted(name for s in fs.listStatus(target) if not (name := s.getPath().getName()).startswith("."))


def folders(spark: SparkSession, path: str, version: str) -> list[str]:
    """Names of the folders that make up a version."""
    fs, target = _at(spark, f"{path}/{VERSIONS}/{version}")
    jvm = spark._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(target)))
    try:
        return list(iter(reader.readLine, None))
    finally:
        reader.close()


def _read(spark: SparkSession, path: str, names: list[str], schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if len(names) == 1:
        return reader.parquet(f"{path}/{names[0]}")
    # One scan of all folders; the part of their paths that says which is one partition more.
    return reader.option("basePath", path).parquet(*(f"{path}/{n}" for n in names)).drop("data")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; the reader stays with it whatever is published later."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version has been published at {path}")
    return _read(spark, path, folders(spark, path, known[-1]))


def _announce(spark: SparkSession, path: str, names: list[str], after: str | None) -> None:
    """Makes a version of these folders known: written aside, then given its name."""
    number = int(after.split("-")[0]) + 1 if after else 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    fs, aside = _at(spark, f"{path}/{VERSIONS}/.{name}")
    stream = fs.create(aside, False)
    stream.write(bytearray("".join(f"{n}\n" for n in names).encode()))
    stream.close()
    if not fs.rename(aside, _at(spark, f"{path}/{VERSIONS}/{name}")[1]):
        raise RuntimeError(f"version {name} of {path} could not be given its name")


def _written(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> str:
    name = f"data={uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    return name


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as the new version of the table at ``path``, and returns that version."""
    spark, name = df.sparkSession, _written(df, path, partition_by)
    _announce(spark, path, [name], max(versions(spark, path), default=None))
    return _read(spark, path, [name], df.schema)


def add(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes the rows of ``df`` beside those of the current version, makes both the new version and returns the rows added.

    Raises, and adds nothing, if another version was published meanwhile. ``df`` may read the table itself.
    """
    spark, before = df.sparkSession, max(versions(df.sparkSession, path), default=None)
    name = _written(df, path, partition_by)
    if max(versions(spark, path), default=None) != before:
        raise RuntimeError(f"another version of {path} has been published meanwhile")
    _announce(spark, path, [*(folders(spark, path, before) if before else []), name], before)
    return _read(spark, path, [name], df.schema)


def prune(spark: SparkSession, path: str, keep: int = 2, stale_hours: float = 24) -> None:
    """Deletes all but the newest ``keep`` versions, with the folders that none of those lists, and what killed writers left over ``stale_hours`` ago."""
    known = versions(spark, path)
    old, held = known[: max(0, len(known) - keep)], {n for v in known[-keep:] for n in folders(spark, path, v)}
    gone = {n for v in old for n in folders(spark, path, v)} - held
    for name in [*(f"{VERSIONS}/{v}" for v in old), *gone]:  # versions first, so that no reader finds one that is half gone
        fs, target = _at(spark, f"{path}/{name}")
        fs.delete(target, True)
    fs, target = _at(spark, path)
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("data=") and name not in held and status.getModificationTime() < 1000 * (time.time() - 3600 * stale_hours):
            fs.delete(status.getPath(), True)
