"""Sun, moon and solunar windows of every nation on the days it ordered, as places spread over the latitudes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from .common import query, t

_PLACES = """places AS (SELECT DISTINCT c_nationkey AS place, CAST(o_orderdate AS DATE) AS day, CAST(c_nationkey * 7 % 141 - 70 AS DOUBLE) AS lat, CAST(c_nationkey * 29 % 360 - 180 AS DOUBLE) AS lng FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _places(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("place"), F.to_date("o_orderdate").alias("day")).distinct()
    return rows.withColumns({"lat": (F.col("place") * 7 % 141 - 70).cast("double"), "lng": (F.col("place") * 29 % 360 - 180).cast("double")})


def _rev(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360.0))"


def _s(x: str) -> str:
    return f"sin(radians({x}))"


def _c(x: str) -> str:
    return f"cos(radians({x}))"


_SUN = f"""t AS (SELECT *, ((day - DATE '2000-01-01') + 2451545.0 - 2451545.0) / 36525.0 AS c FROM places),
e AS (SELECT *, {_rev('280.46646 + c * (36000.76983 + 0.0003032 * c)')} AS l, 357.52911 + c * (35999.05029 - 0.0001537 * c) AS m, 0.016708634 - c * (0.000042037 + 0.0000001267 * c) AS flat, 125.04 - 1934.136 * c AS node FROM t),
f AS (SELECT *, l + {_s('m')} * (1.914602 - c * (0.004817 + 0.000014 * c)) + {_s('2 * m')} * (0.019993 - 0.000101 * c) + {_s('3 * m')} * 0.000289 - 0.00569 - 0.00478 * {_s('node')} AS apparent,
23 + (26 + 21.448 / 60) / 60 - (46.815 * c + 0.00059 * c * c - 0.001813 * c * c * c) / 3600 + 0.00256 * {_c('node')} AS tilt FROM e),
g AS (SELECT *, degrees(asin({_s('tilt')} * {_s('apparent')})) AS decl, tan(radians(tilt / 2)) * tan(radians(tilt / 2)) AS y FROM f),
h AS (SELECT *, 720 - 4 * lng - 4 * degrees(y * {_s('2 * l')} - 2 * flat * {_s('m')} + 4 * flat * y * {_s('m')} * {_c('2 * l')} - 0.5 * y * y * {_s('4 * l')} - 1.25 * flat * flat * {_s('2 * m')}) AS noon,
({_c('90.833')} - {_s('lat')} * {_s('decl')}) / ({_c('lat')} * {_c('decl')}) AS meets FROM g),
i AS (SELECT *, CASE WHEN abs(meets) <= 1 THEN 4 * degrees(acos(meets)) END AS away FROM h)"""


@query(f"""WITH {_PLACES}, {_SUN} SELECT place, day, CASE WHEN meets > 1 THEN 'polar night' WHEN meets < -1 THEN 'polar day' ELSE 'day' END AS state, round(noon, 4) AS noon, round(noon - away, 4) AS rise, round(noon + away, 4) AS "set" FROM i""")
def sun_by_place(spark, d):
    rows = _places(spark, d).withColumn("sun", sky.sun_times(F.col("day"), F.col("lat"), F.col("lng")))
    return rows.select("place", "day", "sun.state", *(F.round(f"sun.{c}", 4).alias(c) for c in ("noon", "rise", "set")))


def _anomaly(mean: str, e: float) -> str:
    """The equation of the centre in SQL, to the sixth power of the eccentricity."""
    import math

    terms = (2 * e - e**3 / 4 + 5 * e**5 / 96, 5 * e**2 / 4 - 11 * e**4 / 24 + 17 * e**6 / 192, 13 * e**3 / 12 - 43 * e**5 / 64, 103 * e**4 / 96 - 451 * e**6 / 480, 1097 * e**5 / 960, 1223 * e**6 / 960)
    return f"({mean} + {' + '.join(f'{math.degrees(c)!r} * {_s(f'{k} * {mean}')}' for k, c in enumerate(terms, 1))})"


def _moved(table) -> str:
    return " + ".join(f"({c} * {_s(f'{a} * m + {b} * el + {g} * f + {h} * sm')})" for c, a, b, g, h in table)


def _moon(rows: str) -> str:
    """Steps over rows with a Julian day jd, to m8 with moon_ra, moon_dec, moon_longitude, sun_longitude and sidereal."""
    return f"""m1 AS (SELECT *, jd - 2451543.5 AS d FROM {rows}),
m2 AS (SELECT *, 125.1228 - 0.0529538083 * d AS n, 318.0634 + 0.1643573223 * d AS w, {_rev('115.3654 + 13.0649929509 * d')} AS m, 282.9404 + 4.70935e-5 * d AS sw, {_rev('356.047 + 0.9856002585 * d')} AS sm FROM m1),
m3 AS (SELECT *, {_anomaly('m', 0.0549)} + w AS u, {_rev('sw + sm')} AS ls, {_rev('n + w + m')} AS lm, {_rev(_anomaly('sm', 0.016709) + ' + sw')} AS sun_longitude FROM m2),
m4 AS (SELECT *, {_rev('lm - ls')} AS el, {_rev('lm - n')} AS f, {_c('n')} * {_c('u')} - {_s('n')} * {_s('u')} * {_c('5.1454')} AS x, {_s('n')} * {_c('u')} + {_c('n')} * {_s('u')} * {_c('5.1454')} AS y, {_s('u')} * {_s('5.1454')} AS z FROM m3),
m5 AS (SELECT *, {_rev(f'degrees(atan2(y, x)) + {_moved(sky.MOON_LONGITUDE)}')} AS moon_longitude, degrees(atan2(z, sqrt(x * x + y * y))) + {_moved(sky.MOON_LATITUDE)} AS beta FROM m4),
m6 AS (SELECT *, 23.4393 - 3.563e-7 * d AS tilt, {_c('moon_longitude')} * {_c('beta')} AS gx, {_s('moon_longitude')} * {_c('beta')} AS gy, {_s('beta')} AS gz FROM m5),
m7 AS (SELECT *, gy * {_c('tilt')} - gz * {_s('tilt')} AS ey, gy * {_s('tilt')} + gz * {_c('tilt')} AS ez FROM m6),
m8 AS (SELECT *, {_rev('degrees(atan2(ey, gx))')} AS moon_ra, degrees(atan2(ez, sqrt(gx * gx + ey * ey))) AS moon_dec, {_rev('ls + 180')} + (jd + 0.5 - floor(jd + 0.5)) * 360 AS sidereal FROM m7)"""


@query(f"""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), j AS (SELECT day, (day - DATE '2000-01-01') + 2451545.0 AS jd FROM days), {_moon('j')},
e AS (SELECT day, {_rev('moon_longitude - sun_longitude')} AS e FROM m8)
SELECT day, round(e, 6) AS elongation, round((1 - {_c('e')}) / 2, 6) AS lit, round(e / 360 * 29.530588861, 6) AS age, round({_rev('180 - e')} / 360 * 29.530588861, 6) AS days_to_full FROM e""")
def moon_by_day(spark, d):
    days = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return sky.moon_state(days, "day").select("day", *(F.round(c, 6).alias(c) for c in ("elongation", "lit", "age", "days_to_full")))


@query(f"""WITH {_PLACES}, j AS (SELECT place, day, lat, lng, s, (day - DATE '2000-01-01') + 2451544.5 + s * 5 / 1440.0 AS jd FROM places, range(-1, 290) t(s)), {_moon('j')},
a AS (SELECT place, day, s, degrees(asin({_s('lat')} * {_s('moon_dec')} + {_c('lat')} * {_c('moon_dec')} * {_c('sidereal + lng - moon_ra')})) AS up FROM m8),
b AS (SELECT *, lag(up) OVER w AS before, lead(up) OVER w AS after FROM a WINDOW w AS (PARTITION BY place, day ORDER BY s)),
k AS (SELECT *, before - 0.125 AS a0, up - 0.125 AS a1 FROM b WHERE s BETWEEN 0 AND 288),
v AS (SELECT place, day, min((s - 1) * 5 + a0 / (a0 - a1) * 5) FILTER (WHERE s > 0 AND a0 <= 0 AND a1 > 0) AS rise, min((s - 1) * 5 + a0 / (a0 - a1) * 5) FILTER (WHERE s > 0 AND a0 >= 0 AND a1 < 0) AS fall,
first({{'up': up, 's': s}} ORDER BY up DESC, s) FILTER (WHERE up >= before AND up >= after) AS high, first(s ORDER BY up, s) FILTER (WHERE up <= before AND up <= after) AS low FROM k GROUP BY 1, 2),
x AS (SELECT place, day, 'transit' AS event, 'major' AS kind, CASE WHEN high.up > 0.125 THEN high.s * 5.0 END AS mid, 60 AS half FROM v UNION ALL SELECT place, day, 'underfoot', 'major', low * 5.0, 60 FROM v UNION ALL SELECT place, day, 'rise', 'minor', rise, 30 FROM v UNION ALL SELECT place, day, 'set', 'minor', fall, 30 FROM v)
SELECT place, day, event, kind, round(CAST(mid AS DOUBLE) - half, 3) AS from_minute, round(CAST(mid AS DOUBLE) + half, 3) AS to_minute FROM x WHERE mid IS NOT NULL""")
def solunar_by_place(spark, d):
    windows = sky.solunar_windows(sky.moon_times(_places(spark, d), ["place"], "day", "lat", "lng"))
    return windows.withColumns({c: F.round(c, 3) for c in ("from_minute", "to_minute")})
