"""Day-of-year conventions, each a column function of its own: they disagree around 29 February on purpose.

=================  ==========  ================================================
function           range       29 February
=================  ==========  ================================================
doy_common         1..365      as 1 March
doy_leap           1..366      60, in every year
doy_index          0..365      59, distance modulo 366
doy_frost          1..365      as 28 February
=================  ==========  ================================================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a common year before each month.
BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def _ordinal(month: Column, day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BEFORE_MONTH)), month) + day


def doy_common(d: Column) -> Column:
    return _ordinal(F.month(d), F.dayofmonth(d))


def doy_leap(d: Column) -> Column:
    return _ordinal(F.month(d), F.dayofmonth(d)) + F.when(F.month(d) > 2, 1).otherwise(0)


def doy_index(d: Column) -> Column:
    return doy_leap(d) - 1


def doy_frost(d: Column) -> Column:
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), 59).otherwise(doy_common(d))


def circular(a: Column, b: Column, length: int) -> Column:
    """Distance of two days of the year around the turn of the year."""
    away = F.abs(a - b)
    return F.when(away > length // 2, length - away).otherwise(away)


def doy_offset(a: Column, b: Column) -> Column:
    """Calendar distance of two dates without their years, wrapping at 182 of 365."""
    return circular(doy_common(a), doy_common(b), 365)


def season_year(d: Column) -> Column:
    """July to June, named by the year it begins in."""
    return F.year(d) - F.when(F.month(d) < 7, 1).otherwise(0)


def month_day(d: Column) -> Column:
    return F.date_format(d, "MM-dd")
