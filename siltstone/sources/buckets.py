"""Tables dealt to buckets by a key when they are written, so that joins on the key need no shuffle afterwards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from siltstone.sources.scratch import scratch_dir

#: Rows of a bucket, about.
BUCKET_ROWS = 4_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that tables of different sizes still have buckets that fit each other."""
    return max(4, 1 << (max(1, rows // bucket_rows) - 1).bit_length())


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a catalog table ``name`` at ``path`` (a scratch folder if not given) in buckets by ``key``.

    One file a bucket: rows are dealt by the key before they are written. Tables with as many buckets join on
    the key where they lie; of two numbers of buckets Spark reads the larger coarser if told to
    (``spark.sql.bucketing.coalesceBucketsInJoin.enabled``).
    """
    spark = df.sparkSession
    name, path = name or f"siltstone_{uuid.uuid4().hex}", path or scratch_dir(spark)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
