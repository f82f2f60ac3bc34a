"""Windows, episodes, day-of-year pools, frames and anomalies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendars as cal
from ..functions import numbers as num
from ..operators import frames, pools, series
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t

DOY = "list_extract([0,31,59,90,120,151,181,212,243,273,304,334], CAST(month({0}) AS INTEGER)) + day({0})"
#: Every day joined with every day of its pool: the plain definition, against which the engine's pools are held.
POOL = f"""{DAILY}, x AS (SELECT *, {DOY.format('day')} AS doy FROM daily),
pool AS (SELECT a.region, a.day, a.value, count(*) AS n, count(*) FILTER (WHERE b.value < a.value) AS below, count(DISTINCT year(b.day)) AS years
FROM x a JOIN x b ON a.region = b.region AND least(abs(a.doy - b.doy), 365 - abs(a.doy - b.doy)) <= 10 GROUP BY 1, 2, 3)"""


def _depth(min_years: int) -> str:
    return f"""WITH {POOL} SELECT region, day, value, n AS pool_n, CAST(years AS BIGINT) AS years,
floor(CASE WHEN years < {min_years} THEN least(0.6, greatest(1 - below / n, below / n)) ELSE greatest(1 - below / n, below / n) END * 1000 + 0.5) / 1000 AS pct,
CASE WHEN 1 - below / n >= below / n THEN 'low' ELSE 'high' END AS won, years < {min_years} AS low_confidence FROM pool"""


def _tail(spark, d, min_years):
    x = pools.tail_depth(daily(spark, d).drop("n"), ["region"], "day", "value", min_years=min_years)
    return x.select("region", "day", "value", F.col("n").alias("pool_n"), "years", "pct", "won", "low_confidence")


@query(_depth(5) + " ORDER BY pct DESC, value, day, region LIMIT 20")
def tail_depth(spark, d):
    return _tail(spark, d, 5).orderBy(F.desc("pct"), "value", "day", "region").limit(20)


@query(_depth(10))
def tail_depth_capped(spark, d):
    return _tail(spark, d, 10)


@query(f"""WITH {DAILY} SELECT DISTINCT day, {DOY.format('day')} AS common,
dayofyear(make_date(2000, month(day), day(day))) AS leap, dayofyear(make_date(2000, month(day), day(day))) - 1 AS index,
CASE WHEN month(day) = 2 AND day(day) = 29 THEN 59 ELSE {DOY.format('day')} END AS frost,
least(abs({DOY.format('day')} - 74), 365 - abs({DOY.format('day')} - 74)) AS from_march_15, year(day) - CASE WHEN month(day) < 7 THEN 1 ELSE 0 END AS season FROM daily""")
def doy_conventions(spark, d):
    x = F.col("day")
    days = daily(spark, d).select("day").distinct()
    return days.select("day", cal.doy_common(x).alias("common"), cal.doy_leap(x).alias("leap"), cal.doy_index(x).alias("index"), cal.doy_frost(x).alias("frost"), cal.doy_offset(x, F.lit("1999-03-15").cast("date")).alias("from_march_15"), cal.season_year(x).alias("season"))


_LUT = f"""{DAILY}, x AS (SELECT *, {DOY.format('day')} AS doy FROM daily),
m AS (SELECT region, p AS pool_doy, value, day FROM x, range(1, 366) r(p) WHERE least(abs(doy - p), 365 - abs(doy - p)) <= 10),
c AS (SELECT region, pool_doy, value, count(*) AS c FROM m GROUP BY 1, 2, 3),
e AS (SELECT region, pool_doy, value, coalesce(sum(c) OVER (PARTITION BY region, pool_doy ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(c) OVER (PARTITION BY region, pool_doy) AS n FROM c)"""


@query(f"""WITH {_LUT} SELECT region, CAST(pool_doy AS INTEGER) AS pool_doy, count(*) AS entries, CAST(max(n) AS BIGINT) AS n, min(value) AS lowest, CAST(max(below) AS BIGINT) AS below_top FROM e GROUP BY 1, 2""")
def pool_luts(spark, d):
    lut = pools.pool_lut(daily(spark, d).drop("n"), ["region"], "day", "value")
    return lut.select("region", "pool_doy", F.size("vals").cast("long").alias("entries"), "n", F.element_at("vals", 1).alias("lowest"), F.element_at("below", -1).alias("below_top"))


@query(f"""WITH {POOL} SELECT region, day, CAST(floor(floor(CASE WHEN years < 5 THEN least(0.6, below / n) ELSE below / n END * 1000 + 0.5) / 1000 * 254 + 0.5) AS INTEGER) AS byte FROM pool""")
def lut_bytes(spark, d):
    x = daily(spark, d).drop("n")
    lut = pools.pool_lut(x, ["region"], "day", "value")
    rows = x.withColumn("pool_doy", cal.doy_common(F.col("day"))).join(lut, ["region", "pool_doy"])
    return rows.select("region", "day", pools.lut_byte(F.col("vals"), F.col("below"), F.col("n"), F.col("years"), F.col("value"), "high", 5).alias("byte"))


@query(f"""WITH {_LUT} SELECT region, CAST(pool_doy AS INTEGER) AS pool_doy, max(value) AS value FROM e WHERE below <= 0.9 * n GROUP BY 1, 2""")
def invert_percentile(spark, d):
    lut = pools.pool_lut(daily(spark, d).drop("n"), ["region"], "day", "value")
    return lut.select("region", "pool_doy", pools.invert_pct(F.col("vals"), F.col("below"), F.col("n"), F.lit(0.9)).alias("value"))


def _census(order: str, edge: str) -> str:
    return f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value{order}, day{order}) AS k, count(*) OVER (PARTITION BY region) AS pool_n FROM daily),
m AS (SELECT * FROM r WHERE k <= ceil(0.05 * pool_n)), g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY region ORDER BY day) <= 8 THEN 0 ELSE 1 END AS new FROM m),
h AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY day) AS run FROM g), e AS (SELECT region, run, min(day) AS start FROM h GROUP BY 1, 2),
f AS (SELECT region, {edge}(value) AS threshold, count(*) AS matched_days, max(pool_n) AS pool_n FROM m GROUP BY 1)
SELECT f.region, threshold, matched_days, pool_n, (SELECT count(*) FROM daily x WHERE x.region = f.region AND x.value = threshold) AS ties, count(*) AS episodes, count(DISTINCT year(start)) AS years, max(start) AS last_occurrence
FROM f JOIN e ON f.region = e.region GROUP BY ALL"""


@query(_census("", "max"))
def band_census_low(spark, d):
    return pools.band_census(daily(spark, d).drop("n"), ["region"], "day", "value", 0.05)


@query(_census(" DESC", "min"))
def band_census_high(spark, d):
    return pools.band_census(daily(spark, d).drop("n"), ["region"], "day", "value", 0.05, "high")


@query(f"""WITH {DAILY}, x AS (SELECT *, dayofyear(make_date(2000, month(day), day(day))) - 1 AS i FROM daily),
s AS (SELECT a.region, a.i, count(*) AS n, avg(b.value) AS mean, stddev_samp(b.value) AS sd FROM (SELECT DISTINCT region, i FROM x) a JOIN x b ON a.region = b.region AND least(abs(a.i - b.i), 366 - abs(a.i - b.i)) <= 7 GROUP BY 1, 2)
SELECT region, day, greatest(-10.0, least(10.0, floor((value - mean) / greatest(sd, 1000.0) * 100 + 0.5) / 100)) AS z FROM x JOIN s USING (region, i)""")
def climatology_z(spark, d):
    # Per calendar day (n, sum, sum of squares about a per-region centre), then fifteen neighbours: no day meets its pool.
    x = daily(spark, d).withColumn("i", cal.doy_index(F.col("day")))
    x = x.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("region")))
    per = x.groupBy("region", "i").agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    near = per.withColumn("k", F.explode(F.sequence(F.lit(-7), F.lit(7)))).withColumn("i", F.pmod(F.col("i") + F.col("k"), F.lit(366)))
    p = near.groupBy("region", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean, sd = F.col("s") / F.col("n"), F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    z = num.round_half_up((F.col("c") - mean) / F.greatest(sd, F.lit(1000.0)), 2)
    return x.drop("n").join(p, ["region", "i"]).select("region", "day", num.clamp(z, -10.0, 10.0).alias("z"))


@query(f"""WITH {DAILY}, x AS (SELECT region, day, value, strftime(day, '%m-%d') AS md FROM daily WHERE month(day) = 5),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY region, md ORDER BY day DESC) = 1), b AS (SELECT x.* FROM x JOIN l USING (region, md) WHERE x.day < l.day)
SELECT l.region, l.day, l.value, round(avg(b.value) + 1e-6, 3) AS mean, round((l.value - avg(b.value)) / stddev_samp(b.value), 6) AS z FROM l JOIN b USING (region, md) GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def same_day_anomaly(spark, d):
    x = daily(spark, d).where("month(day) = 5").withColumn("md", cal.month_day(F.col("day")))
    k = F.row_number().over(Window.partitionBy("region", "md").orderBy(F.desc("day")))
    base = F.when(F.col("k") > 1, F.col("value"))
    now = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    g = x.withColumn("k", k).groupBy("region", "md").agg(now("day").alias("day"), now("value").alias("value"), F.avg(base).alias("m"), F.stddev_samp(base).alias("sd"), F.count(base).alias("n"))
    return g.where("n >= 5").select("region", "day", "value", F.round(F.col("m") + 1e-6, 3).alias("mean"), F.round((F.col("value") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query(f"""WITH {DAILY}, p AS (SELECT region, month(day) AS month, quantile_disc(value, 0.9) AS q, count(*) AS n FROM daily GROUP BY 1, 2), a AS (SELECT region, quantile_disc(value, 0.9) AS q FROM daily GROUP BY 1)
SELECT p.region, CAST(month AS INTEGER) AS month, greatest(CASE WHEN n < 60 THEN a.q ELSE p.q END, 0.25) AS threshold, n < 60 AS fallback FROM p JOIN a ON p.region = a.region""")
def month_thresholds(spark, d):
    x = daily(spark, d).withColumn("month", F.month("day"))
    q = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)")
    p, a = x.groupBy("region", "month").agg(q.alias("q"), F.count("*").alias("cnt")), x.groupBy("region").agg(q.alias("all_q"))
    thin = F.col("cnt") < 60
    return p.join(a, "region").select("region", "month", F.greatest(F.when(thin, F.col("all_q")).otherwise(F.col("q")), F.lit(0.25)).alias("threshold"), thin.alias("fallback"))


@query(f"""WITH {DAILY}, y AS (SELECT region, strftime(day, '%m-%d') AS md, year(day) AS year, avg(value) AS v FROM daily GROUP BY 1, 2, 3)
SELECT region, md, CAST(year AS INTEGER) AS year, round((sum(v) OVER w - v) / (count(*) OVER w - 1) + 1e-6, 3) AS baseline FROM y WHERE md < '02-01' WINDOW w AS (PARTITION BY region, md) QUALIFY count(*) OVER w > 5""")
def leave_one_year_out(spark, d):
    y = daily(spark, d).groupBy("region", cal.month_day(F.col("day")).alias("md"), F.year("day").alias("year")).agg(F.avg("value").alias("v")).where("md < '02-01'")
    w = Window.partitionBy("region", "md")
    y = y.withColumn("s", F.sum("v").over(w)).withColumn("k", F.count("*").over(w)).where("k > 5")
    return y.select("region", "md", "year", F.round((F.col("s") - F.col("v")) / (F.col("k") - 1) + 1e-6, 3).alias("baseline"))


@query(f"""WITH {DAILY}, m AS (SELECT region, date_trunc('month', day)::DATE AS month, round(avg(value) + 1e-6, 3) AS v FROM daily WHERE year(day) = 1996 GROUP BY 1, 2)
SELECT region, CAST(unnest(generate_series(month, CAST(month + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), INTERVAL 1 DAY)) AS DATE) AS day, v FROM m""")
def month_hold(spark, d):
    m = daily(spark, d).where("year(day) = 1996").groupBy("region", F.trunc("day", "month").alias("month")).agg(F.round(F.avg("value") + 1e-6, 3).alias("v"))
    return m.select("region", F.explode(F.sequence("month", F.last_day("month"))).alias("day"), "v")


# --- windows


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def dedupe_newest(spark, d):
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


@query(f"""WITH {EVENT_DAYS}, l AS (SELECT *, lag(n) OVER w AS pn, lag(max_value) OVER w AS pm, lag(users) OVER w AS pu, lag(day) OVER w AS pd FROM event_days WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, unnest(list_filter([CASE WHEN pn - n > 15 THEN 'drop' END, CASE WHEN n - pn > 15 THEN 'rise' END, CASE WHEN pm >= 95 AND max_value < 95 THEN 'crossing' END, CASE WHEN users > 45 THEN 'crowd' END], lambda x: x IS NOT NULL)) AS event FROM l WHERE pd IS NOT NULL""")
def day_over_day_events(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    n, pn, m, pm = F.col("n"), F.lag("n").over(w), F.col("max_value"), F.lag("max_value").over(w)
    x = event_days(spark, d).withColumns({"pn": pn, "pm": pm, "pd": F.lag("day").over(w)}).where("pd is not null")
    pn, pm = F.col("pn"), F.col("pm")
    rules = F.array(F.when(pn - n > 15, "drop"), F.when(n - pn > 15, "rise"), F.when((pm >= 95) & (m < 95), "crossing"), F.when(F.col("users") > 45, "crowd"))
    return x.select("event_type", "day", F.explode(F.array_compact(rules)).alias("event"))


@query(f"""WITH {DAILY} SELECT region, day, CASE WHEN day - lag(day) OVER w = 1 THEN round(value - lag(value) OVER w, 2) END AS delta FROM daily WINDOW w AS (PARTITION BY region ORDER BY day)""")
def gap_aware_delta(spark, d):
    return series.gap_delta(daily(spark, d), ["region"], "day", "value").select("region", "day", F.round("delta", 2).alias("delta"))


@query(f"""WITH {DAILY} SELECT region, day, CASE WHEN count(*) OVER w = 3 THEN round(sum(value) OVER w, 2) END AS rolled FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""")
def rolling_three_days(spark, d):
    return series.rolling(daily(spark, d), ["region"], "day", "value", 3).select("region", "day", F.round("rolled", 2).alias("rolled"))


@query(f"""WITH {DAILY} SELECT region, day, CASE WHEN count(value) OVER w >= 10 THEN round(greatest(-8.0, least(8.0, (value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 0.5))), 6) END AS z
FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def trailing_z(spark, d):
    return series.trailing_z(daily(spark, d), ["region"], "day", "value").select("region", "day", F.round("z", 6).alias("z"))


@query(f"""WITH {EVENT_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM event_days),
g AS (SELECT event_type, max(n) FILTER (WHERE k = 1) AS newest, avg(n) FILTER (WHERE k > 1) AS mean, stddev_pop(n) FILTER (WHERE k > 1) AS sd, count(*) AS n FROM r GROUP BY 1)
SELECT event_type, newest, round(mean + 1e-9, 6) AS mean, n, round((newest - mean) / sd, 6) AS z, CASE WHEN abs((newest - mean) / sd) >= 3 THEN 'high' WHEN abs((newest - mean) / sd) >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM g WHERE n >= 4 AND sd > 0 AND abs((newest - mean) / sd) >= 0.1""")
def latest_against_history(spark, d):
    z = series.latest_z(event_days(spark, d), ["event_type"], [F.desc("day")], "n", threshold=0.1)
    return z.select("event_type", "newest", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "n", F.round("z", 6).alias("z"), "severity")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24' AND event_type = 'view') AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24' AND ts >= TIMESTAMP '2024-01-03' AND event_type = 'view') / 3.0 AS baseline FROM events GROUP BY 1)
SELECT user_id, recent, round(baseline + 1e-9, 6) AS baseline FROM c WHERE baseline >= 3 AND recent < 0.5 * baseline""")
def rate_drop(spark, d):
    view, ts = F.col("event_type") == "view", F.col("ts")
    at = lambda x: F.lit(x).cast("timestamp")
    c = t(spark, d, "events").groupBy("user_id").agg(F.count_if(view & (ts >= at("2024-01-24"))).alias("recent"), (F.count_if(view & (ts < at("2024-01-24")) & (ts >= at("2024-01-03"))) / 3.0).alias("baseline"))
    return c.where("baseline >= 3 and recent < 0.5 * baseline").select("user_id", "recent", F.round(F.col("baseline") + 1e-9, 6).alias("baseline"))


@query(f"""WITH {EVENT_DAYS}, l AS (SELECT *, lag(n) OVER w AS a, lag(n, 2) OVER w AS b, lag(day, 2) OVER w AS d2 FROM event_days WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, n FROM l WHERE n - a >= 3 AND a - b >= 3 AND day - d2 = 2""")
def strict_ramp(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    x = event_days(spark, d).withColumns({"a": F.lag("n").over(w), "b": F.lag("n", 2).over(w), "d2": F.lag("day", 2).over(w)})
    return x.where("n - a >= 3 and a - b >= 3 and datediff(day, d2) = 2").select("event_type", "day", "n")


@query(f"""WITH {DAILY}, s AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY region ORDER BY day)) AS direction FROM daily),
n AS (SELECT *, CASE WHEN direction = lag(direction) OVER (PARTITION BY region ORDER BY day) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY day) AS grp FROM n)
SELECT region, day, CAST(direction AS DOUBLE) AS direction, CASE WHEN direction IS NOT NULL THEN row_number() OVER (PARTITION BY region, grp ORDER BY day) END AS run FROM g""")
def run_lengths(spark, d):
    return series.sign_runs(daily(spark, d), ["region"], "day", "value").select("region", "day", "direction", "run")


@query(f"""WITH {DAILY}, p AS (SELECT a.region, a.day, a.value, b.day AS d, b.value AS v, lag(b.value) OVER w AS v1, lag(b.value, 2) OVER w AS v2, row_number() OVER w AS i FROM daily a JOIN daily b ON a.region = b.region AND a.day - b.day BETWEEN 0 AND 4 WINDOW w AS (PARTITION BY a.region, a.day ORDER BY b.day)),
g AS (SELECT region, day, any_value(value) AS value, count(*) AS n, max(v) AS peak, coalesce(bool_or(v > v1 AND v1 > v2), false) AS two, coalesce(max(i) FILTER (WHERE v <= v1), 1) AS last_fall FROM p GROUP BY 1, 2)
SELECT region, day, value, peak, CAST(n - last_fall AS INTEGER) AS run, CASE WHEN value >= 500000 THEN 'step' ELSE 'trend' END AS arm FROM g WHERE n >= 3 AND (value >= 500000 OR (two AND value >= 300000))""")
def step_or_trend(spark, d):
    return series.step_or_trend(daily(spark, d).select("region", "day", "value"), ["region"], "day", "value", 5, 300000.0, 500000.0)


@query(f"""WITH {DAILY}, m AS (SELECT region, day FROM daily WHERE value > 300000), g AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 3 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY region ORDER BY day)),
h AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY day) AS run FROM g) SELECT region, min(day) AS start_day, max(day) AS end_day, count(*) AS matched_days FROM h GROUP BY region, run""")
def gap_episodes(spark, d):
    return series.episodes(daily(spark, d).where("value > 300000"), ["region"], "day", 2)


@query(f"""WITH {EVENT_DAYS}, x AS (SELECT event_type, day, users // 20 AS level FROM event_days), g AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 AND level = lag(level) OVER w THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY event_type ORDER BY day)),
h AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY day) AS run FROM g) SELECT event_type, min(day) AS start_day, max(day) AS end_day, count(*) AS days, min(level) AS level FROM h GROUP BY event_type, run HAVING count(*) >= 5""")
def stuck_runs(spark, d):
    x = event_days(spark, d).select("event_type", "day", F.floor(F.col("users") / 20).alias("level"))
    return series.equal_runs(x, ["event_type"], "day", "level")


@query(f"""WITH {DAILY}, p AS (SELECT a.region, a.day, b.day - a.day AS k, b.value - a.value AS change FROM daily a JOIN daily b ON a.region = b.region AND b.day - a.day BETWEEN 1 AND 7 WHERE a.value > 500000)
SELECT region, day, count(*) AS recorded, round(min(change), 2) AS max_drop, CAST(min_by(k, (change, k)) AS INTEGER) AS drop_day, round(max(change), 2) AS max_rise FROM p GROUP BY 1, 2 HAVING count(*) >= 3""")
def aftermath_trace(spark, d):
    w = Window.partitionBy("region").orderBy(series.day_number("day")).rangeBetween(1, 7)
    x = daily(spark, d).withColumn("after", F.collect_list(F.struct("day", "value")).over(w)).where("value > 500000")
    p = x.select("region", "day", F.explode("after").alias("a"), F.col("value").alias("v")).select("region", "day", F.datediff("a.day", "day").alias("k"), (F.col("a.value") - F.col("v")).alias("change"))
    out = p.groupBy("region", "day").agg(F.count("*").alias("recorded"), F.round(F.min("change"), 2).alias("max_drop"), F.min_by("k", F.struct("change", "k")).alias("drop_day"), F.round(F.max("change"), 2).alias("max_rise"))
    return out.where("recorded >= 3")


@query(f"""WITH {DAILY}, q AS (SELECT *, CAST(value >= 250000 AS INTEGER) AS hit FROM daily) SELECT region, day FROM q
QUALIFY hit = 1 AND sum(hit) OVER (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) >= 4 AND month(day) BETWEEN 4 AND 9""")
def rolling_fire_days(spark, d):
    w = Window.partitionBy("region").orderBy(series.day_number("day")).rangeBetween(-6, 0)
    x = daily(spark, d).withColumn("k", F.sum((F.col("value") >= 250000).cast("int")).over(w))
    return x.where("value >= 250000 and k >= 4 and month(day) between 4 and 9").select("region", "day")


@query(f"""WITH {DAILY}, f AS (SELECT region, day FROM daily WHERE value >= 400000) SELECT region, day FROM daily a WHERE value >= 350000 AND value < 400000 AND NOT EXISTS (SELECT 1 FROM f WHERE f.region = a.region AND abs(f.day - a.day) <= 7)""")
def near_miss_days(spark, d):
    w = Window.partitionBy("region").orderBy(series.day_number("day")).rangeBetween(-7, 7)
    x = daily(spark, d).withColumn("near", F.max((F.col("value") >= 400000).cast("int")).over(w))
    return x.where("value >= 350000 and value < 400000 and near = 0").select("region", "day")


@query(f"""WITH {DAILY}, r AS (SELECT month(day) AS month, value, n, row_number() OVER (PARTITION BY month(day) ORDER BY value, day, region) - 1 AS i, count(*) OVER (PARTITION BY month(day)) AS c FROM daily)
SELECT CAST(least(9, floor(10 * i / c)) AS BIGINT) AS decile, count(*) AS days, round(avg(n) + 1e-9, 6) AS mean_n FROM r GROUP BY 1""")
def decile_within_month(spark, d):
    w = Window.partitionBy(F.month("day"))
    r = daily(spark, d).select("n", (F.row_number().over(w.orderBy("value", "day", "region")) - 1).alias("i"), F.count("*").over(w).alias("c"))
    return r.groupBy(F.least(F.lit(9), F.floor(10 * F.col("i") / F.col("c"))).alias("decile")).agg(F.count("*").alias("days"), F.round(F.avg("n") + 1e-9, 6).alias("mean_n"))


@query(f"""WITH {DAILY} SELECT region, day, CASE WHEN count(*) FILTER (WHERE n >= 1 AND value < 600000) OVER w >= 10 THEN round(avg(value) FILTER (WHERE n >= 1 AND value < 600000) OVER w + 1e-6, 3) END AS mean
FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def masked_trailing_mean(spark, d):
    x = series.masked_mean(daily(spark, d), ["region"], "day", "value", (F.col("n") >= 1) & (F.col("value") < 600000))
    return x.select("region", "day", F.round(F.col("mean") + 1e-6, 3).alias("mean"))


@query(f"""WITH {EVENT_DAYS}, x AS (SELECT event_type, day, n FROM event_days WHERE day(day) % 3 <> 0), s AS (SELECT event_type, min(day) AS a, max(day) AS b FROM x GROUP BY 1),
f AS (SELECT event_type, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s), j AS (SELECT f.event_type, f.day, x.n FROM f LEFT JOIN x USING (event_type, day)),
k AS (SELECT *, last_value(n IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN n IS NOT NULL THEN day END IGNORE NULLS) OVER p AS pd, first_value(n IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN n IS NOT NULL THEN day END IGNORE NULLS) OVER q AS nd FROM j
WINDOW p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, day, round(coalesce(CAST(n AS DOUBLE), pv + (nv - pv) * (day - pd) / (nd - pd)), 6) AS n, n IS NULL AS filled FROM k""")
def densify_interpolate(spark, d):
    x = event_days(spark, d).where("dayofmonth(day) % 3 <> 0").select("event_type", "day", F.col("n").cast("double").alias("n"))
    return series.densify(x, ["event_type"], "day", "n").select("event_type", "day", F.round("n", 6).alias("n"), "filled")


@query(f"""WITH {DAILY} SELECT threshold, count(*) AS days, round(avg(CAST(value >= threshold * 1.2 AS INTEGER)) + 1e-9, 6) AS rate FROM daily, (VALUES (200000.0), (300000.0), (400000.0), (500000.0)) v(threshold) WHERE value >= threshold GROUP BY 1""")
def knife_edge_sweep(spark, d):
    steps = F.explode(F.array(*(F.lit(x) for x in (200000.0, 300000.0, 400000.0, 500000.0))))
    x = daily(spark, d).withColumn("threshold", steps).where("value >= threshold")
    return x.groupBy("threshold").agg(F.count("*").alias("days"), F.round(F.avg((F.col("value") >= F.col("threshold") * 1.2).cast("int")) + 1e-9, 6).alias("rate"))


# --- frames

_FRAMES = """weekly AS (SELECT n_nationkey AS nation, CAST(date_trunc('week', o_orderdate) AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
ranked AS (SELECT nation, day, (rank() OVER (PARTITION BY nation ORDER BY value) - 1) / count(*) OVER (PARTITION BY nation) AS high FROM weekly),
slots AS (SELECT day, CAST(nation * 2 AS INTEGER) AS slot, CAST(floor(high * 254 + 0.5) AS INTEGER) AS byte FROM ranked UNION ALL SELECT day, CAST(nation * 2 + 1 AS INTEGER), CAST(floor((1 - high) * 254 + 0.5) AS INTEGER) FROM ranked)"""


def _slots(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    weekly = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    w = Window.partitionBy("nation")
    high = (F.rank().over(w.orderBy("value")) - 1) / F.count("*").over(w)
    r = weekly.select("nation", "day", high.alias("high"))
    both = F.explode(F.array(F.struct((F.col("nation") * 2).alias("slot"), frames.to_byte(F.col("high")).alias("byte")), F.struct((F.col("nation") * 2 + 1).alias("slot"), frames.to_byte(1 - F.col("high")).alias("byte"))))
    return r.select("day", both.alias("s")).select("day", "s.slot", "s.byte")


@query(f"""WITH {_FRAMES} SELECT s.day, string_agg(printf('%02X', coalesce(byte, 255)), '' ORDER BY i) AS dots FROM (SELECT DISTINCT day FROM slots) s CROSS JOIN range(0, 50) r(i) LEFT JOIN slots ON slots.day = s.day AND slot = i GROUP BY 1""")
def pack_frames(spark, d):
    return frames.pack(_slots(spark, d), "day", "slot", "byte", 50)


@query(f"""WITH {_FRAMES} SELECT s.day, CAST(i AS INTEGER) AS slot, byte FROM (SELECT DISTINCT day FROM slots) s CROSS JOIN range(0, 50) r(i) LEFT JOIN slots ON slots.day = s.day AND slot = i""")
def unpack_frames(spark, d):
    return frames.unpack(frames.pack(_slots(spark, d), "day", "slot", "byte", 50), "day", "dots")


@query(f"""WITH {_FRAMES}, l AS (SELECT *, CASE WHEN year(day) < 1995 THEN 1 ELSE 2 END AS layout FROM (SELECT DISTINCT day FROM slots)) SELECT l.day, string_agg(printf('%02X', coalesce(byte, 255)), '' ORDER BY i) AS dots FROM l CROSS JOIN range(0, 50) r(i) LEFT JOIN slots ON slots.day = l.day AND slot = i
WHERE layout = 2 AND l.day BETWEEN DATE '1994-12-01' AND DATE '1995-03-31' GROUP BY 1""")
def frame_range(spark, d):
    """A range of frames of the current layout: the range is the feature, and earlier frames of an older layout are left out."""
    packed = frames.pack(_slots(spark, d), "day", "slot", "byte", 50).withColumn("layout", F.when(F.year("day") < 1995, 1).otherwise(2))
    return frames.serve(packed, "1994-12-01", "1995-03-31", 2).drop("layout")


_MATCH = f"""WITH {_FRAMES}, v AS (SELECT day, slot, sign(2 * byte / 254.0 - 1) * pow(abs(2 * byte / 254.0 - 1), 1.5) AS y FROM slots),
s AS (SELECT a.day AS target, b.day, sum(a.y * b.y) AS xy, sum(a.y * a.y) AS xx, sum(b.y * b.y) AS yy, count(*) AS overlap FROM v a JOIN v b ON a.slot = b.slot WHERE a.day IN ({{days}}) AND abs(a.day - b.day) > 21 GROUP BY 1, 2 HAVING count(*) >= 30),
r AS (SELECT target, day, xy / sqrt(xx * yy) AS cos, least(sqrt(xx / yy), sqrt(yy / xx)) AS mag, overlap FROM s WHERE xx > 0 AND yy > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(cos * mag, 9) DESC, day) AS rank FROM r)
SELECT target, day, round(cos * mag, 6) AS score, round(cos, 6) AS cos, overlap, rank FROM k WHERE rank <= {{top}}"""


@query(_MATCH.format(days="DATE '2000-05-01'", top=12))
def frame_match(spark, d):
    target = spark.createDataFrame([("2000-05-01",)], "day string").selectExpr("cast(day as date) as day")
    m = frames.match(_slots(spark, d), target, 30, 12, 21)
    return m.select("target", "day", F.round("score", 6).alias("score"), F.round("cos", 6).alias("cos"), "overlap", "rank")


@query(_MATCH.format(days="SELECT day FROM slots WHERE year(day) = 2001", top=5))
def frame_match_many(spark, d):
    s = _slots(spark, d)
    m = frames.match(s, s.where("year(day) = 2001").select("day").distinct(), 30, 5, 21)
    return m.select("target", "day", F.round("score", 6).alias("score"), F.round("cos", 6).alias("cos"), "overlap", "rank")
