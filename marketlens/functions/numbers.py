"""Numbers: lenient parsing, rounding, distances, bands and badges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


def parse_price(s: Column) -> Column:
    """Digits and points are kept, the longest number at the front is read; 0 and nothing are null."""
    kept = F.regexp_replace(s, "[^0-9.]", "")
    return F.nullif(F.regexp_extract(kept, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))


def parse_count(s: Column, default: int | None = None) -> Column:
    """The integer that a text begins with ('12 boxes' is 12), or the default."""
    return F.coalesce(F.regexp_extract(F.trim(s), r"^([+-]?[0-9]{1,9})", 1).try_cast("int"), F.lit(default).cast("int"))


def half_up(x: Column) -> Column:
    """To the nearest integer, halves upwards also below zero."""
    return F.floor(x + 0.5)


def tenth(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def or_default(x: Column, default: Column) -> Column:
    """default where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0)), default)


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(EARTH_MILES) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def located(lat: Column, lng: Column) -> Column:
    """Whether there are coordinates; 0 counts as none."""
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


def ladder(x: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first step that x reaches; steps from the highest down."""
    out: Column | None = None
    for least, name in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return F.lit(last) if out is None else out.otherwise(last)


def ordinal(x: Column, order: Sequence[str]) -> Column:
    """Place of x in a fixed order from 1; null for other values."""
    out: Column | None = None
    for i, name in enumerate(order, 1):
        out = F.when(x == name, i) if out is None else out.when(x == name, i)
    return F.lit(None).cast("int") if out is None else out


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 where the whole is 0; it may exceed 100."""
    return F.when(whole > 0, half_up(part * 100.0 / whole)).otherwise(0).cast("long")
