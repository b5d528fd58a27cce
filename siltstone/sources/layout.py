"""How a fact lies on disk: a folder a month, and in each the rows that share flags and places beside each other.

A question about a month reads its folder; one about a rule reads the pages whose statistics say that it fired
there, which lie together; one about a zone those of the zone. A key with very many rows takes several
files, since rows are dealt by ranges that go on into ``tie``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.registry import Registry

PLACES = ("pu_borough", "pu_zone")


def clustered(flagged: DataFrame, registry: Registry, by: str = "month", places: tuple[str, ...] = PLACES, tie: str = "raw_id", frequent_first: list[str] | None = None) -> DataFrame:
    """The rows dealt and sorted for ``partitionBy(by)``. Null months come first and are a folder of their own.

    ``frequent_first``: the rules from the most to the least frequent, as a summary of an earlier version has them, in the
    registry's order if not given. Rows are sorted by the rarest rule that fired, then the next one, so the rows of each rule
    lie in few pieces.
    """
    rules = [registry.rule(n) for n in frequent_first] if frequent_first else registry.rules
    fired = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.col(r.flag), k) for k, r in enumerate(rules)))
    order = [F.col(by), F.col("__fired"), *map(F.col, places), F.col(tie)]
    return flagged.withColumn("__fired", fired).repartitionByRange(*order).sortWithinPartitions(*order).drop("__fired")
