"""Sun and moon as column arithmetic: no Python runs a row.

Angles are in degrees; the series are the short ones of the astronomical almanacs, good to about a minute of time
for the sun and half a day's fraction for the moon's phase.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean length of a lunation in days, and a new moon (Julian day) that phases count from.
SYNODIC, NEW_MOON = 29.530588861, 2451550.09766


def julian_day(d: Column) -> Column:
    """Of a date at noon UTC."""
    return F.datediff(d, F.lit("2000-01-01").cast("date")) + F.lit(2451545.0)


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def moon_age(d: Column) -> Column:
    """Days since the last mean new moon."""
    return F.pmod(julian_day(d) - NEW_MOON, F.lit(SYNODIC))


def moon_lit(d: Column) -> Column:
    """Share of the disc that is lit, 0..1."""
    return (1 - F.cos(2 * math.pi * moon_age(d) / SYNODIC)) / 2


def moon_phase(d: Column) -> Column:
    """full above 0.96 lit, new below 0.04, quarter within a day and a half of one, else waxing or waning."""
    age, lit = moon_age(d), moon_lit(d)
    near = F.least(F.abs(age - SYNODIC / 4), F.abs(age - 3 * SYNODIC / 4))
    return F.when(lit > 0.96, "full").when(lit < 0.04, "new").when(near < 1.5, "quarter").when(age < SYNODIC / 2, "waxing").otherwise("waning")


def circular_moon_distance(a: Column, b: Column) -> Column:
    """Days between two dates' places in the lunation, around its end."""
    away = F.abs(moon_age(a) - moon_age(b))
    return F.least(away, SYNODIC - away)


def solar_declination(d: Column) -> Column:
    n = julian_day(d) - 2451545.0
    g = F.pmod(357.528 + 0.9856003 * n, F.lit(360.0))
    longitude = F.pmod(280.460 + 0.9856474 * n + 1.915 * _sin(g) + 0.020 * _sin(2 * g), F.lit(360.0))
    return F.degrees(F.asin(_sin(F.lit(23.439)) * _sin(longitude)))


def day_length_hours(d: Column, latitude: Column) -> Column:
    """Between sunrise and sunset with the usual refraction; 0 in the polar night, 24 in the polar day."""
    dec = solar_declination(d)
    h = (_sin(F.lit(-0.833)) - _sin(latitude) * _sin(dec)) / (_cos(latitude) * _cos(dec))
    return F.when(h >= 1, 0.0).when(h <= -1, 24.0).otherwise(2 * F.degrees(F.acos(h)) / 15)


# --- rising and setting ---

#: Fixed values. Zenith distance of the sun's centre at rise and set; altitude of the moon's centre at rise and set, its
#: mean parallax, refraction and radius taken together.
SUN_ZENITH, MOON_HORIZON = 90.833, 0.125

#: Degrees of the moon's longitude and latitude for the sines of sums of (its mean anomaly, its mean elongation from
#: the sun, its argument of latitude, the sun's mean anomaly).
MOON_LONGITUDE = (
    (-1.274, 1, -2, 0, 0), (0.658, 0, 2, 0, 0), (-0.186, 0, 0, 0, 1), (-0.059, 2, -2, 0, 0), (-0.057, 1, -2, 0, 1), (0.053, 1, 2, 0, 0),
    (0.046, 0, 2, 0, -1), (0.041, 1, 0, 0, -1), (-0.035, 0, 1, 0, 0), (-0.031, 1, 0, 0, 1), (-0.015, 0, -2, 2, 0), (0.011, 1, -4, 0, 0),
)
MOON_LATITUDE = ((-0.173, 0, -2, 1, 0), (-0.055, 1, -2, -1, 0), (-0.046, 1, -2, 1, 0), (0.033, 0, 2, 1, 0), (0.017, 2, 0, 1, 0))


def _turn(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _tan(x: Column) -> Column:
    return F.tan(F.radians(x))


def sun_times(day: Column, latitude: Column, longitude: Column) -> Column:
    """state (day, polar day, polar night), noon, rise and set in minutes UTC of the date; no rise or set in the other states.

    The elements are those of the date's noon; rise and set lie an hour angle before and after the sun's noon, which the
    equation of time moves. Minutes may lie before 0 or after 1440: the event of that solar day."""
    century = (julian_day(day) - 2451545.0) / 36525.0
    mean_longitude = _turn(280.46646 + century * (36000.76983 + 0.0003032 * century))
    anomaly = 357.52911 + century * (35999.05029 - 0.0001537 * century)
    flat = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    centre = _sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + _sin(2 * anomaly) * (0.019993 - 0.000101 * century) + _sin(3 * anomaly) * 0.000289
    node = 125.04 - 1934.136 * century
    apparent = mean_longitude + centre - 0.00569 - 0.00478 * _sin(node)
    tilt = 23 + (26 + 21.448 / 60) / 60 - (46.815 * century + 0.00059 * century * century - 0.001813 * century * century * century) / 3600 + 0.00256 * _cos(node)
    declination = F.degrees(F.asin(_sin(tilt) * _sin(apparent)))
    y = _tan(tilt / 2) * _tan(tilt / 2)
    time = y * _sin(2 * mean_longitude) - 2 * flat * _sin(anomaly) + 4 * flat * y * _sin(anomaly) * _cos(2 * mean_longitude) - 0.5 * y * y * _sin(4 * mean_longitude) - 1.25 * flat * flat * _sin(2 * anomaly)
    noon = 720 - 4 * longitude - 4 * F.degrees(time)
    meets = (math.cos(math.radians(SUN_ZENITH)) - _sin(latitude) * _sin(declination)) / (_cos(latitude) * _cos(declination))
    state = F.when(meets > 1, "polar night").when(meets < -1, "polar day").otherwise("day")
    away = F.when(F.abs(meets) <= 1, 4 * F.degrees(F.acos(meets)))
    return F.struct(state.alias("state"), noon.alias("noon"), (noon - away).alias("rise"), (noon + away).alias("set"))


def _true_anomaly(mean: Column, e: float) -> Column:
    """Kepler's equation solved as a series in the sines of the mean anomaly, to the sixth power of the eccentricity."""
    terms = (
        2 * e - e**3 / 4 + 5 * e**5 / 96, 5 * e**2 / 4 - 11 * e**4 / 24 + 17 * e**6 / 192, 13 * e**3 / 12 - 43 * e**5 / 64,
        103 * e**4 / 96 - 451 * e**6 / 480, 1097 * e**5 / 960, 1223 * e**6 / 960,
    )
    return mean + sum((math.degrees(c) * _sin(k * mean) for k, c in enumerate(terms, 1)), F.lit(0.0))


def with_moon(df: DataFrame, jd: Column) -> DataFrame:
    """The rows with the moon's right ascension, declination and longitude at a Julian day (UTC), `moon_ra`, `moon_dec` and
    `moon_longitude`, the sun's longitude and the sidereal time at Greenwich in degrees, `sun_longitude` and `sidereal`.

    In steps of columns that build on each other, so that no part of the series is worked out twice."""
    d = F.col("_d")
    df = df.withColumn("_d", jd - 2451543.5)
    df = df.withColumns({"_n": 125.1228 - 0.0529538083 * d, "_w": 318.0634 + 0.1643573223 * d, "_m": _turn(115.3654 + 13.0649929509 * d), "_sw": 282.9404 + 4.70935e-5 * d, "_sm": _turn(356.047 + 0.9856002585 * d)})
    n, w, m, sw, sm = (F.col(c) for c in ("_n", "_w", "_m", "_sw", "_sm"))
    df = df.withColumns({"_u": _true_anomaly(m, 0.0549) + w, "_ls": _turn(sw + sm), "_lm": _turn(n + w + m), "sun_longitude": _turn(_true_anomaly(sm, 0.016709) + sw)})
    u, ls, lm, i = F.col("_u"), F.col("_ls"), F.col("_lm"), F.lit(5.1454)
    df = df.withColumns({"_el": _turn(lm - ls), "_f": _turn(lm - n), "_x": _cos(n) * _cos(u) - _sin(n) * _sin(u) * _cos(i), "_y": _sin(n) * _cos(u) + _cos(n) * _sin(u) * _cos(i), "_z": _sin(u) * _sin(i)})
    el, f, x, y, z = (F.col(c) for c in ("_el", "_f", "_x", "_y", "_z"))
    moved = lambda table: sum((c * _sin(a * m + b * el + g * f + h * sm) for c, a, b, g, h in table), F.lit(0.0))
    df = df.withColumns({"moon_longitude": _turn(F.degrees(F.atan2(y, x)) + moved(MOON_LONGITUDE)), "_lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))) + moved(MOON_LATITUDE)})
    lon, lat = F.col("moon_longitude"), F.col("_lat")
    df = df.withColumns({"_tilt": 23.4393 - 3.563e-7 * d, "_gx": _cos(lon) * _cos(lat), "_gy": _sin(lon) * _cos(lat), "_gz": _sin(lat)})
    gx, gy, gz, tilt = (F.col(c) for c in ("_gx", "_gy", "_gz", "_tilt"))
    df = df.withColumns({"_ey": gy * _cos(tilt) - gz * _sin(tilt), "_ez": gy * _sin(tilt) + gz * _cos(tilt)})
    turn = (jd + 0.5 - F.floor(jd + 0.5)) * 360
    df = df.withColumns({"moon_ra": _turn(F.degrees(F.atan2("_ey", "_gx"))), "moon_dec": F.degrees(F.atan2(F.col("_ez"), F.sqrt(gx * gx + F.col("_ey") * F.col("_ey")))), "sidereal": _turn(ls + 180) + turn})
    return df.drop(*(c for c in df.columns if c in {"_d", "_n", "_w", "_m", "_sw", "_sm", "_u", "_ls", "_lm", "_el", "_f", "_x", "_y", "_z", "_lat", "_tilt", "_gx", "_gy", "_gz", "_ey", "_ez"}))


def moon_state(df: DataFrame, day: str) -> DataFrame:
    """The rows with the moon of the date's noon: `elongation` from the sun (0 new, 180 full), `lit` (share of the disc), `age` in
    days and `days_to_full`."""
    out = with_moon(df, julian_day(F.col(day)))
    e = _turn(F.col("moon_longitude") - F.col("sun_longitude"))
    out = out.withColumn("elongation", e).withColumns({"lit": (1 - _cos(F.col("elongation"))) / 2, "age": F.col("elongation") / 360 * SYNODIC, "days_to_full": _turn(180 - F.col("elongation")) / 360 * SYNODIC})
    return out.drop("moon_ra", "moon_dec", "moon_longitude", "sun_longitude", "sidereal")


def moon_times(places: DataFrame, key: Sequence[str], day: str, latitude: str, longitude: str, step: int = 5) -> DataFrame:
    """Per place and date, in minutes UTC: first rise and set (altitude crosses the horizon, on a line between samples of
    `step` minutes), transit (highest turning point, if above the horizon) and underfoot (lowest turning point); null where the
    date has none. A turning point is a sample with no higher (lower) one beside it, and the samples just outside the date
    are looked at too, so that its ends are no turning points by themselves. One row for each key and date goes in."""
    last = 1440 // step
    rows = places.select(*key, day, latitude, longitude, F.explode(F.sequence(F.lit(-1), F.lit(last + 1))).alias("_s"))
    jd = F.datediff(F.col(day), F.lit("2000-01-01").cast("date")) + F.lit(2451544.5) + F.col("_s") * step / 1440
    rows = with_moon(rows, jd)
    angle = F.col("sidereal") + F.col(longitude) - F.col("moon_ra")
    lat, dec = F.col(latitude), F.col("moon_dec")
    up = F.degrees(F.asin(_sin(lat) * _sin(dec) + _cos(lat) * _cos(dec) * _cos(angle)))
    curve = rows.select(*key, day, F.struct("_s", up.alias("up")).alias("p")).groupBy(*key, day).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["up"]).alias("up"))
    # Entry s + 2 (counted from 1) is sample s.
    at = lambda s: F.element_at("up", s.cast("int") + 2)
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))

    def crossing(rising: bool) -> Column:
        def place(s: Column) -> Column:
            a, b = at(s - 1) - MOON_HORIZON, at(s) - MOON_HORIZON
            crossed = (a <= 0) & (b > 0) if rising else (a >= 0) & (b < 0)
            return F.when(crossed, (s - 1) * step + a / (a - b) * step)

        return first(F.transform(F.sequence(F.lit(1), F.lit(last)), place))

    def turning(sign: int) -> Column:
        """Of the turning points the most extreme, of equal ones the first: {how extreme, -sample}."""
        point = lambda s: F.when((sign * at(s) >= sign * at(s - 1)) & (sign * at(s) >= sign * at(s + 1)), F.struct((sign * at(s)).alias("v"), (-s).alias("s")))
        return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(last)), point))

    out = curve.withColumns({"rise": crossing(True), "set": crossing(False), "_high": turning(1), "_low": turning(-1)})
    transit = F.when(F.col("_high.v") > MOON_HORIZON, -F.col("_high.s") * step)
    return out.select(*key, day, "rise", "set", transit.cast("double").alias("transit"), (-F.col("_low.s") * step).cast("double").alias("underfoot"))


def solunar_windows(times: DataFrame, major: int = 60, minor: int = 30) -> DataFrame:
    """A row for each event of moon_times() that is there: kind, from and until in minutes UTC; major ones around transit and
    underfoot, minor ones around rise and set."""
    event = lambda name, half, kind: F.struct(F.lit(name).alias("event"), F.lit(kind).alias("kind"), (F.col(name) - half).alias("from_minute"), (F.col(name) + half).alias("to_minute"))
    events = F.array(event("transit", major, "major"), event("underfoot", major, "major"), event("rise", minor, "minor"), event("set", minor, "minor"))
    keep = [c for c in times.columns if c not in ("rise", "set", "transit", "underfoot")]
    return times.select(*keep, F.explode(events).alias("e")).select(*keep, "e.*").where("from_minute is not null")
