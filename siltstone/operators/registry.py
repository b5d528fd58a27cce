"""Rules, the measures that they make unusable, and what follows for a query's rows and aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``predicate`` is a SQL condition in which {name} stands for a threshold; unknown counts as not fired.

    ``tested`` names the columns that show why it fired: always these, or each under its own condition.
    """

    name: str
    severity: str
    description: str
    predicate: str
    invalidates: tuple[str, ...]
    tested: tuple[tuple[str, str], ...]

    @property
    def flag(self) -> str:
        return f"q_{self.name}"


@dataclass(frozen=True)
class Registry:
    measures: dict[str, str]
    rules: tuple[Rule, ...]
    thresholds: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule in self.rules:
            if not rule.invalidates or not rule.tested:
                raise ValueError(f"rule {rule.name} invalidates nothing or shows nothing")
            if unknown := set(rule.invalidates) - self.measures.keys():
                raise KeyError(f"rule {rule.name}: no such measures: {sorted(unknown)}")

    def limits(self, overrides: dict | None = None) -> dict:
        if unknown := set(overrides or {}) - self.thresholds.keys():
            raise KeyError(f"no such thresholds: {sorted(unknown)}")
        return {**self.thresholds, **(overrides or {})}

    def with_limits(self, **overrides) -> Registry:
        return Registry(self.measures, self.rules, self.limits(overrides))

    def rule(self, name: str) -> Rule:
        return {r.name: r for r in self.rules}[name]

    def predicate_sql(self, rule: Rule, overrides: dict | None = None) -> str:
        return rule.predicate.format(**self.limits(overrides))

    def description(self, rule: Rule, overrides: dict | None = None) -> str:
        return rule.description.format(**self.limits(overrides))

    def affecting(self, *measures: str) -> list[Rule]:
        if unknown := set(measures) - self.measures.keys():
            raise KeyError(f"no such measures: {sorted(unknown)}")
        return [r for r in self.rules if set(r.invalidates) & set(measures)]

    def invalidating_columns(self, *measures: str) -> list[str]:
        """The flags of the rules that bear on the measures."""
        return [r.flag for r in self.affecting(*measures)]

    def condition_sql(self, *measures: str) -> str:
        """That no rule that bears on the measures has fired; empty if none does."""
        return " AND ".join(f"{flag} = 0" for flag in self.invalidating_columns(*measures))

    def condition(self, *measures: str) -> Column | None:
        return F.expr(sql) if (sql := self.condition_sql(*measures)) else None

    def guard(self, x: Column, *measures: str) -> Column:
        return x if (usable := self.condition(*measures)) is None else F.when(usable, x)


def strict() -> Column:
    return F.col("issue_count") == 0


def all_of(*conditions: Column | None) -> Column:
    given = [c for c in conditions if c is not None]
    return reduce(Column.__and__, given) if given else F.lit(True)


@dataclass(frozen=True)
class Scope:
    """One switch for the row filter and the guards of a query, and the same figures from rows or from a cube's sums."""

    registry: Registry
    exclude_invalid: bool = True
    cubed: bool = False

    def population(self, *measures: str) -> Column | None:
        """The condition of a row filter, and of a guard (``when``) for the figures below; None for no condition."""
        return self.registry.condition(*measures) if self.exclude_invalid else None

    def count(self, when: Column | None = None) -> Column:
        """Of the rows, or of those for which ``when`` holds."""
        if self.cubed:
            return F.coalesce(F.sum("n" if when is None else F.when(when, F.col("n"))), F.lit(0))
        return F.count(F.lit(1)) if when is None else F.count_if(when)

    def sum(self, column: str, when: Column | None = None) -> Column:
        x = F.col(f"sum_{column}" if self.cubed else column)
        return F.sum(x if when is None else F.when(when, x)).cast("double")

    def values(self, column: str, when: Column | None = None) -> Column:
        """How many there are."""
        x = F.col(f"count_{column}" if self.cubed else column)
        x = x if when is None else F.when(when, x)
        return F.sum(x) if self.cubed else F.count(x)

    def mean(self, column: str, places: int, when: Column | None = None) -> Column:
        """The exact sum as a double over the count, rounded; null for no values."""
        return F.round(F.try_divide(self.sum(column, when), self.values(column, when)), places)

    def greatest(self, column: str, when: Column | None = None) -> Column:
        x = F.col(f"greatest_{column}" if self.cubed else column)
        return F.max(x if when is None else F.when(when, x))

    def least(self, column: str) -> Column:
        return F.min(f"least_{column}" if self.cubed else column)

    def positive(self, column: str) -> Column:
        return F.col(f"{column}_positive") if self.cubed else F.col(column) > 0
