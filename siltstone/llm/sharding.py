"""Placing documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: an offset and a step
from its name's hash. The shards take turns, each claiming its next free slot, until all are taken, so
shards get equally many slots (within one) and a shard that comes or goes moves few others. A document's
hash picks a slot. The table has a fixed size and is broadcast, so placing a row is one lookup without a
shuffle; the rows of a hot source spread by their own ids.

A null key is hashed as the empty string; repeated rows get the same shard; texts aren't read. Other
columns pass through; the output columns must not exist already.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import named_apart, table

#: A prime well over a hundred times the number of shards; the broadcast table has as many rows.
SLOTS = 65_537
SHARDS = tuple(f"shard-{n:04d}" for n in range(256))


def lookup(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot. ``slots`` is prime and not less than the number of shards."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards need distinct names, one at least and at most one for each slot")
    taken = [-1] * slots
    at, step = [], []
    for name in shards:
        digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    free = slots
    while True:
        for k in range(len(shards)):
            while taken[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            taken[at[k]] = k
            free -= 1
            if not free:
                return taken


def slot_table(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    rows = [(slot, k, shards[k]) for slot, k in enumerate(lookup(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot, shard and shard_name."""
    named_apart(df, "slot", "shard", "shard_name")
    hashed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = df.withColumn("slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(slot_table(df.sparkSession, shards, slots)), "slot").select(*df.columns, "slot", "shard", "shard_name")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS) -> None:
    """Writes one folder a shard. Tasks write what they have read, without a shuffle."""
    place(df, key, shards).write.partitionBy("shard_name").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "slot", "shard", "shard_name")
