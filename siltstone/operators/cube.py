"""Sums that every guarded figure can be had from: a row for each set of flags and group.

Whether a row counts for a figure depends on which rules have flagged it, so a fact of any size is added up once
by its flags (a mask of one bit a rule) and group; a population or a guard is then a choice of masks. All figures
kept merge: counts, exact sums of decimals, least and greatest values, and bitmaps of numbered names for
exact distinct counts. So a new day's rows are added up alone, and their cube is merged into the one there is.

A cube holds several grains, each with group columns of its own, made in one scan. Its size follows the groups
and the sets of flags that occur, not the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.registry import Registry, Scope


@dataclass(frozen=True)
class Spec:
    """``positive``: columns whose being above zero is a choice too. ``distinct``: the column whose values are counted."""

    grains: dict[str, tuple[str, ...]]
    sums: tuple[str, ...]
    positive: tuple[str, ...]
    greatest: tuple[str, ...]
    least: tuple[str, ...]
    distinct: str

    def keys(self) -> list[str]:
        return sorted({c for keys in self.grains.values() for c in keys})

    def fixed(self) -> list[str]:
        return ["mask", *(f"{c}_positive" for c in self.positive)]


def mask(registry: Registry) -> Column:
    """One bit for each rule, in the registry's order."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.col(r.flag), k) for k, r in enumerate(registry.rules)))


def _merged(rows: DataFrame, by: list[str], spec: Spec) -> DataFrame:
    def total(name: str) -> Column:
        return F.sum(name).cast(rows.schema[name].dataType).alias(name)

    kept = [total("n"), *(x for c in spec.sums for x in (total(f"sum_{c}"), total(f"count_{c}")))]
    kept += [F.max(f"greatest_{c}").alias(f"greatest_{c}") for c in spec.greatest] + [F.min(f"least_{c}").alias(f"least_{c}") for c in spec.least]
    return rows.groupBy(*by).agg(*kept, F.bitmap_or_agg("names").alias("names"))


def numbers(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, number) for each name of a dimension-sized column ``name``; those ``known`` keep theirs, new ones go on from there."""
    fresh, last = names.where("name is not null").distinct(), 0
    if known is not None:
        fresh, last = fresh.join(known, "name", "left_anti"), (known.agg(F.max("number")).first()[0] or 0)
    numbered = fresh.select("name", (F.row_number().over(Window.orderBy("name")) + last).cast("long").alias("number"))
    return numbered if known is None else known.unionByName(numbered)


def build(flagged: DataFrame, registry: Registry, spec: Spec, known: DataFrame) -> DataFrame:
    """The cube of ``flagged``. ``known``: the numbers of the distinct column's names."""
    decimals = {c: F.col(c) for c in spec.sums}
    rows = flagged.select(*spec.keys(), *({*spec.sums, *spec.greatest, *spec.least, spec.distinct} - {*spec.keys()}), mask(registry).alias("mask"), *(F.coalesce(F.col(c) > 0, F.lit(False)).alias(f"{c}_positive") for c in spec.positive))
    sets = [[*keys, *spec.fixed()] for keys in spec.grains.values()]
    sets.append([spec.distinct, *spec.fixed()])
    grouped = list(dict.fromkeys([*spec.keys(), spec.distinct, *spec.fixed()]))
    kept = [F.count(F.lit(1)).alias("n"), *(x for c, v in decimals.items() for x in (F.sum(v).alias(f"sum_{c}"), F.count(v).alias(f"count_{c}")))]
    kept += [F.max(c).alias(f"greatest_{c}") for c in spec.greatest] + [F.min(c).alias(f"least_{c}") for c in spec.least]
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in grouped)).agg(*kept, F.grouping_id().alias("__id"))
    # grouping_id has a bit for each column that is left out, the first column's the highest.
    ids = [sum(1 << (len(grouped) - 1 - k) for k, c in enumerate(grouped) if c not in s) for s in sets]
    grain = F.lit(None).cast("string")
    for name, number in zip([*spec.grains, "names"], ids):
        grain = F.when(F.col("__id") == number, F.lit(name)).otherwise(grain)
    found = found.withColumn("grain", grain).drop("__id")
    named = found.where("grain = 'names'").join(known, F.col(spec.distinct) == F.col("name"))
    bitmaps = named.groupBy(*spec.fixed(), F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("names"))
    sums = found.where("grain <> 'names'").withColumns({"bucket": F.lit(None).cast("long"), "names": F.lit(None).cast("binary")})
    return sums.drop(*({spec.distinct} - {*spec.keys()})).unionByName(bitmaps.withColumn("grain", F.lit("names")), allowMissingColumns=True)


def merge(cubes: list[DataFrame], spec: Spec) -> DataFrame:
    """One cube of several, of days say, that have been made with the same numbers."""
    return _merged(reduce(DataFrame.unionByName, cubes), ["grain", "bucket", *spec.keys(), *spec.fixed()], spec)


@dataclass(frozen=True)
class Cube:
    """A cube to ask: workflows take it in a fact's place."""

    rows: DataFrame
    registry: Registry

    def grain(self, name: str) -> DataFrame:
        """Its rows, with the flags that the mask stands for."""
        flags = {r.flag: F.shiftright("mask", k).bitwiseAND(F.lit(1)) for k, r in enumerate(self.registry.rules)}
        return self.rows.where(F.col("grain") == name).withColumns(flags | {"issue_count": F.bit_count("mask")})

    def distinct(self) -> Column:
        """How many names of the distinct column there are, exactly."""
        parts = self.rows.where("grain = 'names'").groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("names")).alias("n"))
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()


def asked(fact: DataFrame | Cube, grain: str, registry: Registry, exclude_invalid: bool = True) -> tuple[DataFrame, Scope]:
    """The rows to ask, the fact's or those of one of its cube's grains, and how."""
    cubed = isinstance(fact, Cube)
    return fact.grain(grain) if cubed else fact, Scope(registry, exclude_invalid, cubed)
