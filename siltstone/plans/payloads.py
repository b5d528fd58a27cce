"""What a dashboard is told: each page's figures as plain lists and dictionaries, ready for JSON.

All of them are bounded by what they show (boroughs, hours, rules, a limit), so they are collected. The work
over rows stays in Spark; ``fact`` is best stored, or a cube where no single rows are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstone.functions.expressions import DAYS, plain
from siltstone.operators import flags
from siltstone.operators.cube import Cube
from siltstone.operators.registry import Registry
from siltstone.plans import workflows as w

# The names of a shown row's cells, in a sample and in the row viewer (texts as the source has them).
SAMPLE_NAMES = {
    "pickup_ts": "PickupDateTime",
    "dropoff_ts": "DropoffDateTime",
    "minutes": "TripMinutes",
    "distance": "TripDistance",
    "mph": "AvgMph",
    "fare": "FareAmount",
    "tip": "TipAmount",
    "total": "TotalAmount",
    "pu_zone": "PUZoneName",
    "do_zone": "DOZoneName",
    "issue_count": "QualityIssueCount",
}
ROW_NAMES = {
    "pickup_text": "PickupDateTime",
    "dropoff_text": "DropoffDateTime",
    "pu_zone": "PUZoneName",
    "do_zone": "DOZoneName",
    "passengers_text": "PassengerCount",
    "distance_text": "TripDistance",
    "minutes": "TripMinutes",
    "mph": "AvgMph",
    "fare_text": "FareAmount",
    "tip_text": "TipAmount",
    "total_text": "TotalAmount",
    "flags": "Flags",
    "issues": "Issues",
    "tested": "Tested",
}


def records(df: DataFrame) -> list[dict]:
    return [plain(r.asDict(recursive=True)) for r in df.collect()]


def _named(df: DataFrame, names: dict[str, str]) -> list[dict]:
    """The cells of ``names`` that there are, by their shown names."""
    return records(df.select(*(df[c].alias(n) for c, n in names.items() if c in df.columns)))


def matrix(heat: DataFrame) -> dict:
    """Rows a day, Sunday first; columns an hour."""
    by_day = {r["day"]: [r[f"h{h:02d}"] for h in range(24)] for r in heat.collect()}
    days = [d for d in DAYS if d in by_day]
    return {"days": days, "hours": list(range(24)), "matrix": [by_day[d] for d in days]}


def overview(fact: DataFrame | Cube, registry: Registry) -> dict:
    return {
        "headline": records(w.headline(fact, registry))[0],
        "cleaning_impact": records(w.cleaning_impact(fact, registry)),
        "issue_distribution": records(flags.issue_distribution(fact, registry)),
        "boroughs": records(w.borough_summary(fact, registry)),
        "coverage": records(flags.measure_coverage(fact, registry)),
    }


def quality(fact: DataFrame, registry: Registry, min_trips: int = 500, cube: Cube | None = None) -> dict:
    """``cube``: of the fact, to count from; only the reconciliation needs rows."""
    counted = fact if cube is None else cube
    limits = {k: float(v) for k, v in registry.limits().items() if isinstance(v, (int, float))}
    return {
        "rules": records(flags.summary(counted, registry)),
        "issue_distribution": records(flags.issue_distribution(counted, registry)),
        "reconciliation": records(w.reconciliation(fact, min_trips)),
        "thresholds": limits,
        "coverage": records(flags.measure_coverage(counted, registry)),
    }


def sample(fact: DataFrame, registry: Registry, rule: str, limit: int = 12) -> dict:
    return {"rule": rule, "rows": _named(flags.sample(fact, registry, rule, min(max(limit, 1), 100)), SAMPLE_NAMES)}


def rows(fact: DataFrame, registry: Registry, selector: str = "flagged", limit: int = 25, raw: DataFrame | None = None) -> dict:
    """``raw``: the landed texts by raw_id; without it the cells that quote the source are left out."""
    shown = flags.browse(fact, registry, selector, min(max(limit, 1), 200), raw)
    matching = flags.browse_count(fact, registry, selector).first()["matching"]
    rules = [{"name": r.name, "severity": r.severity, "description": registry.description(r)} for r in registry.rules]
    return {"rule": selector, "matching": matching, "rows": _named(shown, ROW_NAMES), "rules": rules}


def zones(fact: DataFrame | Cube, registry: Registry, clean: bool = True, limit: int = 15) -> dict:
    limit = min(max(limit, 1), 50)
    busiest = {d: records(w.busiest_zones(fact, registry, d, limit, clean)) for d in ("pickup", "dropoff")}
    return {"exclude_invalid": clean, **busiest, "boroughs": records(w.borough_summary(fact, registry, clean)), "fare_per_mile": records(w.fare_per_mile(fact, registry, limit, exclude_invalid=clean))}


def times(fact: DataFrame | Cube, registry: Registry, clean: bool = True) -> dict:
    by = {"hour": w.activity_by_hour, "day_of_week": w.activity_by_dow, "month": w.activity_by_month}
    return {"exclude_invalid": clean, **{n: records(f(fact, registry, clean)) for n, f in by.items()}, "heatmap": matrix(w.hourly_heatmap(fact, registry, clean))}


def pairs(fact: DataFrame | Cube, registry: Registry, clean: bool = True, cross_borough_only: bool = False, limit: int = 20) -> dict:
    found = records(w.od_pairs(fact, registry, min(max(limit, 1), 50), cross_borough_only, clean))
    return {"exclude_invalid": clean, "cross_borough_only": cross_borough_only, "pairs": found}


def tipping(fact: DataFrame | Cube, registry: Registry, clean: bool = True, min_trips: int = 500) -> dict:
    return {"tipping": records(w.tipping_by_borough(fact, registry, min_trips, clean))}
