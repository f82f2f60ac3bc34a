"""Sensors judged in two passes, guarded frost years, and station rollups after screening, on readings made from shipments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sensors
from .common import query, t

#: Lows of a month that the made readings lie around.
_NORMAL = (20, 22, 30, 38, 48, 57, 63, 61, 53, 41, 31, 23)

#: Stations report once a day; some stick to a value for days, some report none, or values that a season doesn't have.
_READINGS = f"""ship AS (SELECT l_suppkey % 3 AS station, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CAST(list_extract({list(_NORMAL)}, CAST(month(day) AS INTEGER)) AS BIGINT) AS normal, (day - DATE '1970-01-01') // 11 AS block, CAST(month(day) AS INTEGER) AS mo FROM ship),
readings AS (SELECT 'all' AS area, station, day, mo, normal AS mean_low, normal + 20 AS mean_high,
CASE WHEN (block + station * 3) % 9 = 0 THEN 5 + 10 * (block % 4) WHEN q % 29 = 0 THEN 10 WHEN q % 31 = 1 THEN NULL ELSE normal + q % 9 - 4 END AS low,
CASE WHEN q % 37 = 0 THEN normal - 30 WHEN (block + station * 5) % 13 = 0 THEN 90 + 10 * (block % 4) WHEN q % 41 = 0 THEN 118 WHEN q % 43 = 1 THEN NULL ELSE normal + 20 + q % 7 END AS high, q % 50 AS rain FROM b)"""


def _readings(spark, d):
    li = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("station"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("long").alias("q"))
    normal = F.element_at(F.array(*(F.lit(x).cast("long") for x in _NORMAL)), F.month("day"))
    block = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 11)
    q = F.col("q")
    low = F.when((block + F.col("station") * 3) % 9 == 0, 5 + 10 * (block % 4)).when(q % 29 == 0, 10).when(q % 31 == 1, None).otherwise(normal + q % 9 - 4)
    high = F.when(q % 37 == 0, normal - 30).when((block + F.col("station") * 5) % 13 == 0, 90 + 10 * (block % 4)).when(q % 41 == 0, 118).when(q % 43 == 1, None).otherwise(normal + 20 + q % 7)
    return li.select(F.lit("all").alias("area"), "station", "day", normal.alias("mean_low"), (normal + 20).alias("mean_high"), low.cast("long").alias("low"), high.cast("long").alias("high"), (q % 50).alias("rain"))


def _sensors(low_base: str, high_base: str) -> list[sensors.Reading]:
    """A low of 15 or less from May to September needs a spread above 38 beside it; a high of 115 or more in winter needs nothing."""
    low, high = F.col("low"), F.col("high")
    below, above = F.col(low_base) - low, high - F.col(high_base)
    return [
        sensors.Reading("low", low, below, (low <= 15) & F.month("day").between(5, 9), below > 38),
        sensors.Reading("high", high, above, (high >= 115) & F.month("day").isin(12, 1, 2), F.lit(True)),
    ]


def _judged(low_base: str, high_base: str, era: str) -> str:
    """Readings one by one, runs of equal values, and which are confirmed, by themselves or by a value proven broken."""
    return f"""tall AS (SELECT area, station, day, 0 AS i, 'low' AS field, CAST(low AS DOUBLE) AS value, CAST({low_base} - low AS DOUBLE) AS spread, coalesce(low <= 15 AND mo BETWEEN 5 AND 9, false) AS impossible, coalesce({low_base} - low > 38, false) AS corroborated FROM readings
UNION ALL SELECT area, station, day, 1, 'high', CAST(high AS DOUBLE), CAST(high - {high_base} AS DOUBLE), coalesce(high >= 115 AND mo IN (12, 1, 2), false), true FROM readings),
g AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 AND value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM tall WINDOW w AS (PARTITION BY area, station, field ORDER BY day)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY area, station, field ORDER BY day) AS run FROM g),
r AS (SELECT area, station, field, run, min(value) AS value, min(day) AS start_day, max(day) AS end_day, count(*) AS days, list_sort(list(spread) FILTER (WHERE spread IS NOT NULL))[count(spread) // 2 + 1] AS median_spread, bool_or(impossible) AS impossible FROM n WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
p AS (SELECT *, coalesce(median_spread > 30 OR (days >= 10 AND median_spread > 15) OR impossible, false) AS by_itself, {era} AS era FROM r),
runs AS (SELECT *, EXISTS (SELECT 1 FROM p k WHERE k.by_itself AND k.area = p.area AND k.station = p.station AND k.field = p.field AND k.value = p.value AND k.era = p.era) AS confirmed FROM p)"""


@query(f"""WITH {_READINGS}, {_judged('mean_low', 'mean_high', '0')},
f AS (SELECT n.area, n.station, n.day, CASE WHEN c.run IS NOT NULL THEN 1 + i ELSE 3 + i END AS rank, n.field || CASE WHEN c.run IS NOT NULL THEN ' stuck' ELSE ' seasonal' END AS flag, n.value, c.days, c.median_spread, c.by_itself
FROM n LEFT JOIN runs c ON c.confirmed AND c.area = n.area AND c.station = n.station AND c.field = n.field AND c.run = n.run WHERE c.run IS NOT NULL OR (n.impossible AND n.corroborated)
UNION ALL SELECT area, station, day, 0, 'inversion', CAST(low AS DOUBLE), NULL, NULL, NULL FROM readings WHERE low > high)
SELECT area, station, day, flag, value, days, median_spread, by_itself FROM f QUALIFY row_number() OVER (PARTITION BY area, station, day ORDER BY rank) = 1""")
def sensor_scan(spark, d):
    rows = _readings(spark, d).withColumn("id", F.lit(0))
    return sensors.sensor_scan(rows, ["area", "station"], "day", "id", "low", "high", _sensors("mean_low", "mean_high")).drop("id")


@query(f"""WITH {_READINGS}, {_judged('mean_low', 'mean_high', '0')}
SELECT area, station, field, 'run' AS kind, value, start_day, end_day, days, median_spread FROM runs WHERE NOT confirmed
UNION ALL SELECT n.area, n.station, n.field, 'season', n.value, n.day, n.day, 1, n.spread FROM n WHERE n.impossible AND NOT n.corroborated AND NOT EXISTS (SELECT 1 FROM runs c WHERE c.confirmed AND c.area = n.area AND c.station = n.station AND c.field = n.field AND c.run = n.run)""")
def sensor_suspects(spark, d):
    rows = _readings(spark, d).withColumn("id", F.lit(0))
    return sensors.suspects(rows, ["area", "station"], "day", "id", _sensors("mean_low", "mean_high"))


_GUARDS = sensors.FrostGuards(stuck=8, stuck_spread=25.0)


@query(f"""WITH {_READINGS}, cold AS (SELECT station, CAST(year(day) AS INTEGER) AS year, day, low, mean_low - low AS spread, low <= 32 AS frost FROM readings WHERE low <= 36),
far AS (SELECT *, frost AND spread > 38 AS far FROM cold),
v AS (SELECT station, year, low FROM far WHERE frost AND NOT far GROUP BY 1, 2, 3 HAVING count(*) >= 8 AND list_sort(list(spread))[count(*) // 2 + 1] > 25),
s AS (SELECT far.*, CASE WHEN far.far THEN 'spread' WHEN far.frost AND v.low IS NOT NULL THEN 'stuck' END AS guard FROM far LEFT JOIN v USING (station, year, low)),
a AS (SELECT s.*, CASE WHEN guard IS NOT NULL THEN guard WHEN frost AND NOT EXISTS (SELECT 1 FROM s o WHERE o.station = s.station AND o.year = s.year AND o.day <> s.day AND abs(o.day - s.day) <= 10 AND o.guard IS NULL) THEN 'alone' END AS last_guard,
CASE WHEN month(day) = 2 AND day(day) = 29 THEN 59 ELSE list_extract([0,31,59,90,120,151,181,212,243,273,304,334], CAST(month(day) AS INTEGER)) + day(day) END AS doy FROM s),
y AS (SELECT station, year, count(*) AS frosts, count(*) FILTER (WHERE last_guard = 'spread') AS spread, count(*) FILTER (WHERE last_guard = 'stuck') AS stuck, count(*) FILTER (WHERE last_guard = 'alone') AS alone,
max(doy) FILTER (WHERE last_guard IS NULL AND month(day) < 7) AS last_spring, min(doy) FILTER (WHERE last_guard IS NULL AND month(day) >= 7) AS first_fall FROM a WHERE frost GROUP BY 1, 2),
c AS (SELECT DISTINCT station, CAST(year(day) AS INTEGER) AS year FROM readings WHERE low IS NOT NULL)
SELECT station, year, coalesce(frosts, 0) AS frosts, coalesce(spread, 0) AS spread, coalesce(stuck, 0) AS stuck, coalesce(alone, 0) AS alone, last_spring, first_fall, first_fall - last_spring AS season_days, coalesce(spread + stuck + alone, 0) <= 0.4 * coalesce(frosts, 0) AS kept FROM c LEFT JOIN y USING (station, year)""")
def guarded_frost_years(spark, d):
    return sensors.frost_years(_readings(spark, d), ["station"], "day", "low", "mean_low", _GUARDS)


@query(f"""WITH {_READINGS.replace('readings AS', 'raw AS')}, readings AS (SELECT *, avg(low) OVER (PARTITION BY area, day) AS area_low, avg(high) OVER (PARTITION BY area, day) AS area_high FROM raw), {_judged('area_low', 'area_high', 'year(start_day)')},
w AS (SELECT n.area, n.station, n.day, n.field, CASE WHEN c.run IS NOT NULL THEN 'stuck' WHEN n.impossible AND n.corroborated THEN 'seasonal' END AS reason FROM n LEFT JOIN runs c ON c.confirmed AND c.area = n.area AND c.station = n.station AND c.field = n.field AND c.run = n.run),
s AS (SELECT x.*, l.reason AS lo, h.reason AS ho, l.reason IS NULL AND h.reason IS NULL AND coalesce(low > high, false) AS turned FROM readings x JOIN w l ON l.field = 'low' AND l.station = x.station AND l.day = x.day JOIN w h ON h.field = 'high' AND h.station = x.station AND h.day = x.day),
k AS (SELECT area, station, day, rain, CASE WHEN turned THEN 'inversion' ELSE lo END AS lo, CASE WHEN turned THEN 'inversion' ELSE ho END AS ho, CASE WHEN lo IS NULL AND NOT turned THEN low END AS low, CASE WHEN ho IS NULL AND NOT turned THEN high END AS high FROM s),
c AS (SELECT *, low IS NOT NULL OR high IS NOT NULL AS there FROM k)
SELECT area, day, round(avg(low), 6) AS mean_low, round(avg(high), 6) AS mean_high, min(low) AS low, first(station ORDER BY low, station) FILTER (WHERE low IS NOT NULL) AS low_station, max(high) AS high, first(station ORDER BY high DESC, station) FILTER (WHERE high IS NOT NULL) AS high_station,
max(rain) FILTER (WHERE there) AS most_rain, first(station ORDER BY rain DESC, station) FILTER (WHERE there) AS most_station, count(*) FILTER (WHERE there) AS stations, {', '.join(f"count(*) FILTER (WHERE lo = '{x}') + count(*) FILTER (WHERE ho = '{x}') AS {x}" for x in ('stuck', 'seasonal', 'inversion'))} FROM c GROUP BY 1, 2 HAVING count(*) FILTER (WHERE there) > 0""")
def screened_rollup(spark, d):
    rows = sensors.with_area_mean(_readings(spark, d), ["area"], "day", "low", "high")
    rows = sensors.screened(rows, ["area"], "station", "day", "low", "high", _sensors("area_low", "area_high"))
    out = sensors.rollup(rows, ["area"], "station", "day", "low", "high", "rain")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_low", "mean_high")})
