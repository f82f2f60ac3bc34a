"""Rounding, clamps, ladders and readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5): halves go up, also below zero, unlike round()."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, lo: float, hi: float) -> Column:
    """lo..hi; a null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ladder(steps: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def reading(x: Column, lo: float | None = None, hi: float | None = None, sentinels: Sequence[float] = ()) -> Column:
    """A reading or null: sentinels and implausible values are missing, and missing is never zero."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double"))
    if sentinels:
        ok &= ~x.isin(*sentinels)
    if lo is not None:
        ok &= x >= lo
    if hi is not None:
        ok &= x <= hi
    return F.when(ok, x)


def compare(value: Column, op: str, threshold: object) -> Column:
    """gte, lte, gt, lt or eq; any other operator is false, and so is a null value."""
    ops = {"gte": value >= threshold, "lte": value <= threshold, "gt": value > threshold, "lt": value < threshold, "eq": value == threshold}
    return F.coalesce(ops.get(op, F.lit(False)), F.lit(False))


def magnitude(text: Column) -> Column:
    """'1.5M' as 1500000.0: a number with an optional K, M or B; null if it is none."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[KMBkmb]?\s*$", 1)
    suffix = F.upper(F.regexp_extract(text, r"([KMBkmb])\s*$", 1))
    scale = ladder([(suffix == "K", 1e3), (suffix == "M", 1e6), (suffix == "B", 1e9)], 1.0)
    return F.when(number != "", number.cast("double") * scale)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def compass(degrees: Column, names: Sequence[str] = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")) -> Column:
    step = 360.0 / len(names)
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(degrees / step + 0.5), F.lit(len(names))) + 1).cast("int"))


def escaped_like(column: Column, words: str) -> Column:
    """Contains the words, in any case; % and _ are ordinary characters."""
    quoted = words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{quoted}%")
