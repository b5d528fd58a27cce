"""Tables that are written to a shared folder, read again and at last deleted."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_log = logging.getLogger(__name__)
#: path -> (file system, path) of the JVM, which outlive the session.
_scratch: dict[str, tuple] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one (``spark.checkpoint.dir``).

    Where that is unset, a temporary one if all of Spark is this machine's one process, as in tests; on a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/siltstone"
    path = f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scratch[path] = (target.getFileSystem(spark._jsc.hadoopConfiguration()), target)
    return path


def kept(df: DataFrame, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and where: cuts the lineage, survives a lost executor."""
    path = scratch_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return kept(df)[0]


def settled(build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """As ``kept`` for what ``build`` gives; the scratch tables that it made on the way are deleted, since no other plan reads them."""
    before = set(_scratch)
    out, path = kept(build())
    discard(*(set(_scratch) - before - {path}))
    return out, path


def there(path: str) -> bool:
    return path in _scratch


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def discard(*paths: str) -> None:
    """Deletes scratch tables that no plan reads any more."""
    for path in paths:
        fs, target = _scratch.pop(path)
        try:
            fs.delete(target, True)
        except Exception as error:  # noqa: BLE001  what can't be deleted is reported, and costs space alone
            _log.warning("scratch table %s is left behind: %s", path, error)


def release() -> None:
    """Deletes every scratch table written so far. Call it when the results that read them are no longer needed."""
    discard(*list(_scratch))


atexit.register(release)
