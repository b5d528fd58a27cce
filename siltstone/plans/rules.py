"""The fourteen rules over trips, their measures and thresholds."""

from __future__ import annotations

from siltstone.operators.registry import Registry, Rule

# What measures there are, each rule's condition and what it invalidates, and the limits.
MEASURES = {
    "trip_count": "that the row is one trip",
    "location": "where it began and ended",
    "time": "when it began",
    "distance": "how far it went",
    "duration": "how long it took",
    "speed": "distance over duration",
    "fare": "the fare, and shares of it",
    "tip": "the tip",
    "total": "the total and the revenue",
    "fee_breakdown": "the single fees",
    "passengers": "how many people rode",
}
THRESHOLDS = {
    "min_minutes": 0.5,
    "max_minutes": 720,
    "max_distance": 150,
    "max_fare": 500,
    "max_mph": 80,
    "min_mph": 0.5,
    "total_tolerance": 1.00,
    "max_tip_ratio": 3,
    "period_start": "2023-01-01 00:00:00",
    "period_end": "2024-01-01 00:00:00",
}
COMPONENTS = ("fare", "extra", "mta_tax", "tip", "tolls", "improvement", "congestion")
_SUM = " + ".join(f"coalesce({c}, 0)" for c in COMPONENTS)
DISCREPANCY = f"total - ({_SUM})"
_NOWHERE = "({0} IS NULL OR {0} IN ('Unknown', 'N/A'))"


def _always(*columns: str) -> tuple[tuple[str, str], ...]:
    return tuple((c, "true") for c in columns)


RULES = (
    Rule("non_positive_distance", "error", "No distance, or none above zero", "distance IS NULL OR distance <= 0", ("distance", "speed"), _always("distance")),
    Rule("non_positive_duration", "error", "Ends no later than it begins", "minutes IS NULL OR minutes <= 0", ("duration", "speed", "time"), _always("minutes")),
    Rule("implausibly_short", "warn", "Went some way in under {min_minutes} minutes", "minutes > 0 AND minutes < {min_minutes} AND distance > 0", ("distance", "duration", "speed"), _always("minutes")),
    Rule("excessive_duration", "error", "Took over {max_minutes} minutes", "minutes > {max_minutes}", ("duration", "speed"), _always("minutes")),
    Rule("excessive_distance", "error", "Went over {max_distance} miles", "distance > {max_distance}", ("distance", "speed"), _always("distance")),
    Rule("negative_amount", "error", "A negative fare or total", "fare < 0 OR total < 0", ("trip_count", "fare", "tip", "total", "fee_breakdown"), (("fare", "fare < 0"), ("total", "total < 0"))),
    Rule("excessive_fare", "warn", "A fare over {max_fare}", "fare > {max_fare}", ("fare", "total"), _always("fare")),
    Rule("implausible_speed", "error", "Faster than {max_mph} mph", "mph > {max_mph}", ("distance", "duration", "speed"), _always("mph")),
    Rule("stalled_trip", "warn", "Slower than {min_mph} mph", "distance > 0 AND minutes > 0 AND mph < {min_mph}", ("duration", "speed"), _always("mph")),
    Rule("total_mismatch", "warn", "The parts differ from the total by over {total_tolerance}", f"total IS NOT NULL AND abs({DISCREPANCY}) > {{total_tolerance}}", ("fee_breakdown",), _always("total")),
    Rule("disproportionate_tip", "warn", "A tip over {max_tip_ratio} times the fare", "fare > 0 AND tip > {max_tip_ratio} * fare", ("tip", "total"), _always("tip")),
    Rule("outside_period", "error", "Begins outside {period_start} to {period_end}", "pickup_ts IS NULL OR pickup_ts < TIMESTAMP '{period_start}' OR pickup_ts >= TIMESTAMP '{period_end}'", ("time",), _always("pickup_ts")),
    Rule("unknown_zone", "warn", "An end at no known zone", f"{_NOWHERE.format('pu_borough')} OR {_NOWHERE.format('do_borough')}", ("location",), (("pu_zone", _NOWHERE.format("pu_borough")), ("do_zone", _NOWHERE.format("do_borough")))),
    Rule("missing_passengers", "warn", "No number of passengers, or zero", "passengers IS NULL OR passengers = 0", ("passengers",), _always("passengers")),
)
TRIPS = Registry(MEASURES, RULES, THRESHOLDS)
