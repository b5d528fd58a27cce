"""Column expressions that several plans share."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days and months, and the codes of the trip records.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PAYMENTS = {1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 5: "Unknown", 6: "Voided trip"}

STAMP_SHAPE = "__/__/____ __:__:__ _M"
STAMP_FORMAT = "MM/dd/yyyy hh:mm:ss a"


def stamp(text: Column) -> Column:
    """A 12-hour clock time; null where the text doesn't hold one, the right shape or not."""
    return F.when(text.like(STAMP_SHAPE), F.try_to_timestamp(text, F.lit(STAMP_FORMAT)).cast("timestamp_ntz"))


def number(text: Column, kind: str = "decimal(12,2)") -> Column:
    """Without thousands separators; null where that is no number or doesn't fit."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(kind)


def whole(text: Column) -> Column:
    """An integer, also from a number with a fraction, which is cut off."""
    return number(text, "decimal(20,4)").try_cast("int")


def mean(x: Column, places: int) -> Column:
    """The exact sum as a double over the count, rounded; null for no values."""
    return F.round(F.try_divide(F.sum(x).cast("double"), F.count(x)), places)


def percent(part: Column, of: Column, places: int) -> Column:
    """0 when there is nothing to take a share of."""
    return F.round(F.coalesce(F.try_divide(100.0 * part, of), F.lit(0.0)), places)


def label(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.element_at(F.create_map(*pairs), code)


def day_name(dow: Column) -> Column:
    return label(dow, dict(enumerate(DAYS, 1)))


def month_name(month: Column) -> Column:
    return label(month, dict(enumerate(MONTHS, 1)))


def payment_name(code: Column) -> Column:
    return F.coalesce(label(code, PAYMENTS), F.lit("Other"))


def plain(value: object) -> object:
    """A value as JSON can say it: decimals as floats, times as ISO text, what is no finite number as null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, Decimal):
        value = float(value)
    return None if isinstance(value, float) and not isfinite(value) else value
