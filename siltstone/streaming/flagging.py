"""Flagging a stream. Rules look at one row each, so a stream needs no state for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.flags import apply_rules
from siltstone.operators.registry import Registry


def flag_stream(stream: DataFrame, registry: Registry, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the flagged rows to Parquet at ``path``, all that is there now, and ends."""
    return apply_rules(stream, registry).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
