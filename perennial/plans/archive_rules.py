"""Sensor guards, frost dates, tides, the moon, banding, signatures and search by lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import sky
from ..operators import ann, quality, ranks, scoring, series
from ..operators import statistics as st
from ..sources import archive
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t

#: A daily low and high, made of order totals: region, day, low and high in degrees.
_WEATHER = f"""{DAILY}, weather AS (SELECT region, day, floor(value / 10000) % 60 - 5 AS low, floor(value / 10000) % 60 - 5 + n * 9 % 47 - 2 AS high FROM daily)"""


def _weather(spark, d):
    low = F.floor(F.col("value") / 10000) % 60 - 5
    return daily(spark, d).select("region", "day", low.cast("double").alias("low"), (low + F.col("n") * 9 % 47 - 2).cast("double").alias("high"))


@query(f"""WITH {_WEATHER}, g AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 AND high = lag(high) OVER w THEN 0 ELSE 1 END AS new FROM weather WINDOW w AS (PARTITION BY region ORDER BY day)),
h AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY day) AS run FROM g), r AS (SELECT *, count(*) OVER (PARTITION BY region, run) AS len FROM h)
SELECT region, day, CASE WHEN low > high THEN 'inversion' WHEN len >= 2 THEN 'stuck' WHEN month(day) IN (1, 2) AND low > 50 THEN 'season' END AS flag FROM r WHERE low > high OR len >= 2 OR (month(day) IN (1, 2) AND low > 50)""")
def sensor_flags(spark, d):
    return quality.sensor_flags(_weather(spark, d), ["region"], "day", "low", "high", 2, F.month("day").isin(1, 2) & (F.col("low") > 50)).select("region", "day", "flag")


_FROST = f"""{_WEATHER}, ok AS (SELECT *, year(day) AS year, high - low BETWEEN 0 AND 38 AS ok, CASE WHEN month(day) = 2 AND day(day) = 29 THEN 59 ELSE list_extract([0,31,59,90,120,151,181,212,243,273,304,334], CAST(month(day) AS INTEGER)) + day(day) END AS doy FROM weather),
s AS (SELECT region, year FROM ok GROUP BY 1, 2 HAVING avg(CAST(NOT ok AS INTEGER)) <= 0.4),
frost AS (SELECT region, year, max(doy) FILTER (WHERE month(day) < 7) AS last_spring, min(doy) FILTER (WHERE month(day) >= 7) AS first_fall FROM ok JOIN s USING (region, year) WHERE ok AND low <= 32 GROUP BY 1, 2)"""


@query(f"WITH {_FROST} SELECT region, CAST(year AS INTEGER) AS year, last_spring, first_fall, first_fall - last_spring AS season_days FROM frost")
def frost_dates(spark, d):
    return quality.frost_dates(_weather(spark, d), ["region"], "day", "low", "high").select("region", "year", "last_spring", "first_fall", "season_days")


@query(f"""WITH {_FROST} SELECT region, count(*) AS years, {', '.join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{int(q * 100)}" for c in ('last_spring', 'first_fall') for q in (0.1, 0.5, 0.9))} FROM frost GROUP BY 1 HAVING count(*) >= 5""")
def frost_climatology(spark, d):
    c = quality.frost_climatology(quality.frost_dates(_weather(spark, d), ["region"], "day", "low", "high"), ["region"])
    return c.select("region", "years", *(F.round(x, 6).alias(x) for x in c.columns if x not in ("region", "years")))


@query("""WITH c AS (SELECT user_id % 5 AS station, ts AS moment, max(value) AS h FROM events WHERE event_type = 'view' GROUP BY 1, 2), a AS (SELECT DISTINCT user_id % 5 AS station, ts AS moment FROM events WHERE event_type = 'purchase'),
b AS (SELECT a.station, a.moment, c.moment AS t0, c.h AS h0 FROM a ASOF LEFT JOIN c ON a.station = c.station AND a.moment >= c.moment), e AS (SELECT b.*, c.moment AS t1, c.h AS h1 FROM b ASOF LEFT JOIN c ON b.station = c.station AND b.moment <= c.moment),
s AS (SELECT *, CASE WHEN moment = t0 AND h0 IS NOT NULL THEN 'ok' WHEN t0 IS NULL OR t1 IS NULL THEN 'out of range' WHEN epoch_us(t1) - epoch_us(t0) > 7200000000 THEN 'gap' WHEN h0 IS NULL OR h1 IS NULL THEN 'missing' ELSE 'ok' END AS status FROM e)
SELECT station, moment, CASE WHEN status = 'ok' THEN round(CASE WHEN moment = t0 THEN h0 ELSE h0 + (h1 - h0) * (epoch_us(moment) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) END AS h, status FROM s""")
def tide_interpolation(spark, d):
    e = t(spark, d, "events").withColumn("station", F.col("user_id") % 5).withColumnRenamed("ts", "at")
    curve = e.where("event_type = 'view'").groupBy("station", "at").agg(F.max("value").alias("h"))
    out = quality.tide_at(curve, e.where("event_type = 'purchase'").select("station", "at").distinct(), ["station"], "at", "h", 60)
    return out.select("station", F.col("at").cast("timestamp_ntz").alias("moment"), F.round("h", 6).alias("h"), "status")


_AGE = "((day - DATE '2000-01-01') + 2451545.0 - 2451550.09766) - 29.530588861 * floor(((day - DATE '2000-01-01') + 2451545.0 - 2451550.09766) / 29.530588861)"


@query(f"""WITH {DAILY}, m AS (SELECT region, day, value, {_AGE} AS age FROM daily), l AS (SELECT *, (1 - cos(2 * pi() * age / 29.530588861)) / 2 AS lit FROM m)
SELECT CASE WHEN lit > 0.96 THEN 'full' WHEN lit < 0.04 THEN 'new' WHEN least(abs(age - 29.530588861 / 4), abs(age - 3 * 29.530588861 / 4)) < 1.5 THEN 'quarter' WHEN age < 29.530588861 / 2 THEN 'waxing' ELSE 'waning' END AS phase, count(*) AS days, round(avg(value) + 1e-6, 2) AS mean FROM l GROUP BY 1""")
def lunar_clock(spark, d):
    return daily(spark, d).groupBy(sky.moon_phase(F.col("day")).alias("phase")).agg(F.count("*").alias("days"), F.round(F.avg("value") + 1e-6, 2).alias("mean"))


@query(f"""WITH {DAILY}, p AS (SELECT median(value) AS mid FROM daily) SELECT region, day, round(CASE WHEN value >= mid THEN (SELECT count(*) FROM daily b WHERE b.value >= a.value) ELSE (SELECT count(*) FROM daily b WHERE b.value <= a.value) END / (SELECT count(*) FROM daily), 6) AS share FROM daily a, p""")
def tail_base_rate(spark, d):
    # One distribution by value, its sums by ranges, then an equi-join: the share at or beyond each value on its side.
    x = daily(spark, d)
    archive.shared_folder(spark)
    pivot = x.agg(F.median("value").alias("pivot"), F.count("*").alias("all"))
    upto = ranks.cumulative(x, "value").select("value", "le", "ge")
    j = x.join(upto, "value").crossJoin(F.broadcast(pivot))  # one row
    return j.select("region", "day", F.round(F.when(F.col("value") >= F.col("pivot"), F.col("ge")).otherwise(F.col("le")) / F.col("all"), 6).alias("share"))


@query(f"""WITH {EVENT_DAYS}, u AS (SELECT day, event_type, 'rise' AS axis FROM event_days WHERE n > 70 UNION ALL SELECT day, event_type, 'fall' FROM event_days WHERE max_value < 90 UNION ALL SELECT day, event_type, 'rise' FROM event_days WHERE users > 45)
SELECT day, CASE WHEN count(DISTINCT axis) > 1 THEN NULL ELSE min(axis) END AS axis, least(3, count(DISTINCT event_type)) AS band FROM u GROUP BY 1""")
def live_bands(spark, d):
    e = event_days(spark, d)
    u = e.where("n > 70").select("day", "event_type", F.lit("rise").alias("axis")).unionByName(e.where("max_value < 90").select("day", "event_type", F.lit("fall").alias("axis"))).unionByName(e.where("users > 45").select("day", "event_type", F.lit("rise").alias("axis")))
    return u.groupBy("day").agg(F.when(F.countDistinct("axis") > 1, F.lit(None)).otherwise(F.min("axis")).alias("axis"), F.least(F.lit(3), F.countDistinct("event_type")).alias("band"))


@query(f"""WITH {EVENT_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM event_days), a AS (SELECT event_type, list(n ORDER BY day) AS v, min(n) AS lo, count(*) FILTER (WHERE n > 60) AS high FROM r WHERE k <= 8 GROUP BY 1)
SELECT event_type, CAST(least(100, CASE WHEN v[8] > v[1] THEN 30 ELSE 0 END + CASE WHEN lo > 40 THEN 30 ELSE 0 END + high * 5) AS BIGINT) AS confidence FROM a WHERE len(v) = 8 AND CASE WHEN v[8] > v[1] THEN 30 ELSE 0 END + CASE WHEN lo > 40 THEN 30 ELSE 0 END + high * 5 >= 20""")
def signature_match(spark, d):
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))
    a = event_days(spark, d).withColumn("k", k).where("k <= 8").groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))
    c = F.when(F.try_element_at("v", F.lit(8)) > F.try_element_at("v", F.lit(1)), 30).otherwise(0) + F.when(F.array_min("v") > 40, 30).otherwise(0) + F.size(F.filter("v", lambda x: x > 60)) * 5
    return a.where(F.size("v") == 8).select("event_type", F.least(F.lit(100), c).cast("long").alias("confidence")).where("confidence >= 20")


@query(f"""WITH {EVENT_DAYS}, w AS (SELECT day FROM event_days WHERE event_type = 'click' AND n >= 60), f AS (SELECT DISTINCT day FROM event_days WHERE event_type = 'error' AND n >= 60)
SELECT count(*) AS watches, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f WHERE f.day - w.day BETWEEN 1 AND 3)) AS escalated FROM w WHERE w.day <= DATE '2024-01-27'""")
def watch_escalation(spark, d):
    e = event_days(spark, d)
    w = e.where("event_type = 'click' and n >= 60 and day <= date'2024-01-27'").select("day")
    f = e.where("event_type = 'error' and n >= 60").select(F.explode(F.sequence(F.date_sub("day", 3), F.date_sub("day", 1))).alias("day")).distinct().withColumn("hit", F.lit(1))
    return w.join(f, "day", "left").agg(F.count("*").alias("watches"), F.count("hit").alias("escalated"))


@query(f"""WITH {EVENT_DAYS}, l AS (SELECT *, n - lag(n, 7) OVER (PARTITION BY event_type ORDER BY day) AS change, lag(day, 7) OVER (PARTITION BY event_type ORDER BY day) AS d7, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM event_days) SELECT event_type, day, n, change FROM l WHERE k = 1 AND n >= 20 AND change > 0 AND day - d7 = 7""")
def expansion_lead(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    x = event_days(spark, d).withColumns({"change": F.col("n") - F.lag("n", 7).over(w), "d7": F.lag("day", 7).over(w), "k": F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))})
    return x.where("k = 1 and n >= 20 and change > 0 and datediff(day, d7) = 7").select("event_type", "day", "n", "change")


@query("""WITH c AS (SELECT s * 3 AS start FROM range(0, 120) r(s)), e AS (SELECT epoch(ts) / 3600 - epoch(TIMESTAMP '2024-01-01') / 3600 AS h FROM events WHERE event_type = 'purchase' AND value > 95),
k AS (SELECT start, (start * 7919) % 1009 AS r FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE h >= start AND h < start + 3)) SELECT start FROM k ORDER BY r, start LIMIT 10""")
def control_windows(spark, d):
    c = spark.range(0, 120).select((F.col("id") * 3).alias("start"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    taken = t(spark, d, "events").where("event_type = 'purchase' and value > 95").select((F.floor(micros / 10_800_000_000) * 3).alias("start")).distinct()
    return c.join(taken, "start", "left_anti").orderBy((F.col("start") * 7919) % 1009, "start").limit(10)


@query("""WITH r AS (SELECT user_id, ts, event_id, coalesce(datediff('day', CAST(ts AS DATE), DATE '2024-01-31'), 0) AS age, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS newer, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 0.5 WHEN age > 25 AND newer = 0 THEN 0.25 ELSE least(2.0, 1.0 + CASE WHEN newer > 5 THEN 0.1 ELSE 0 END + CASE WHEN event_type = 'purchase' THEN 0.05 ELSE 0 END) END AS weight FROM r""")
def signal_weights(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    r = t(spark, d, "events").withColumns({"age": F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")), "newer": F.count("*").over(w)})
    up = F.least(F.lit(2.0), 1.0 + F.when(F.col("newer") > 5, 0.1).otherwise(0.0) + F.when(F.col("event_type") == "purchase", 0.05).otherwise(0.0))
    return r.select("event_id", F.when(F.col("event_type") == "error", 0.5).when((F.col("age") > 25) & (F.col("newer") == 0), 0.25).otherwise(up).alias("weight"))


@query("""WITH j AS (SELECT event_type AS job, max(ts) AS latest FROM events GROUP BY 1), h AS (SELECT job, latest, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(latest)) / 3.6e9 AS hours FROM j)
SELECT job, latest, round(hours, 4) AS hours_ago, CASE WHEN hours > CASE WHEN job = 'click' THEN 1 ELSE 26 END THEN 'late' ELSE 'ok' END AS status FROM h""")
def job_health(spark, d):
    j = t(spark, d, "events").groupBy(F.col("event_type").alias("job")).agg(F.max("ts").alias("latest"))
    hours = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 3.6e9
    return j.select("job", "latest", F.round(hours, 4).alias("hours_ago"), F.when(hours > F.when(F.col("job") == "click", 1).otherwise(26), "late").otherwise("ok").alias("status"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS hits, count(*) FILTER (WHERE event_type = 'error') AS misses, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'hit'
WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'mixed' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'miss' ELSE 'quiet' END AS grade FROM events GROUP BY 1, 2""")
def report_cards(spark, d):
    p, e = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    g = t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(p.alias("hits"), e.alias("misses"))
    return g.withColumn("grade", num.ladder([((F.col("hits") > 0) & (F.col("misses") == 0), "hit"), (F.col("hits") > 0, "mixed"), (F.col("misses") > 0, "miss")], "quiet"))


@query("""WITH s AS (SELECT event_id, least(5, coalesce(value, 0) / 20) + CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 0 END + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS score FROM events) SELECT event_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, event_id LIMIT 50""")
def interestingness(spark, d):
    k = F.col("event_type")
    s = F.least(F.lit(5.0), F.coalesce("value", F.lit(0.0)) / 20) + F.when(k == "error", 3).when(k == "purchase", 2).otherwise(0) + F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)
    return t(spark, d, "events").select("event_id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(50)


@query()
def list_search(spark, d):
    e = t(spark, d, "embeddings")
    index = ann.fit(e, lists=20)
    return ann.search(ann.assign(e, index), e.where("vec_id % 20 = 0"), index, top=10, probes=15)


@query(f"""WITH {DAILY}, v AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day) AS i FROM daily), c AS (SELECT tau, count(*) FILTER (WHERE a.value >= t.tau) AS fires, count(*) FILTER (WHERE a.value >= t.tau AND EXISTS (SELECT 1 FROM daily b WHERE b.region = a.region AND b.day = a.day + 1 AND b.value >= 300000)) AS followed
FROM v a, (SELECT 250000.0 + k * 10000.0 AS tau FROM range(-8, 5) r(k)) t GROUP BY 1) SELECT tau, fires, followed, CASE WHEN fires > 0 THEN round(followed / fires, 6) END AS rate FROM c""")
def cliff_sweep(spark, d):
    w = Window.partitionBy("region").orderBy(series.day_number("day")).rangeBetween(1, 1)
    x = daily(spark, d).withColumn("next", F.max("value").over(w)).withColumn("tau", F.explode(F.array(*(F.lit(250000.0 + k * 10000.0) for k in range(-8, 5)))))
    g = x.groupBy("tau").agg(F.count_if(F.col("value") >= F.col("tau")).alias("fires"), F.count_if((F.col("value") >= F.col("tau")) & (F.col("next") >= 300000)).alias("followed"))
    return g.withColumn("rate", F.when(F.col("fires") > 0, F.round(F.col("followed") / F.col("fires"), 6)))


@query("""WITH a AS (SELECT event_type, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT event_type, after, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS pct, round(avg((epoch_us(nxt) - epoch_us(ts)) / 3.6e9), 6) AS lead_hours FROM a WHERE after IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""")
def sensor_profile(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = t(spark, d, "events").withColumns({"nxt": F.lead("ts").over(w), "after": F.lead("event_type").over(w)}).where("after is not null")
    hours = (F.unix_micros(F.col("nxt").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    g = a.groupBy("event_type", "after").agg(F.count("*").alias("n"), F.round(F.avg(hours), 6).alias("lead_hours"))
    g = g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))
    return g.where("n >= 5").select("event_type", "after", "n", "pct", "lead_hours")


@query(f"""WITH {DAILY}, f AS (SELECT region AS state, day FROM daily WHERE value > 700000), p AS (SELECT f.state, f.day, CASE WHEN d.day IS NULL THEN 'hole' WHEN d.value > 300000 THEN 'hit' ELSE 'quiet' END AS s FROM f CROSS JOIN range(1, 4) r(k) LEFT JOIN daily d ON d.region = f.state AND d.day = f.day + CAST(k AS INTEGER))
SELECT state, day, CASE WHEN bool_or(s = 'hit') THEN 'hit' WHEN bool_or(s = 'hole') THEN 'ungradeable' ELSE 'miss' END AS grade FROM p GROUP BY 1, 2""")
def aftermath_grade(spark, d):
    x = daily(spark, d)
    f = x.where("value > 700000").select("region", "day").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    j = f.withColumn("on", F.expr("date_add(day, k)")).join(x.select("region", F.col("day").alias("on"), F.col("value").alias("v")), ["region", "on"], "left")
    hit, hole = F.max((F.col("v") > 300000).cast("int")), F.max(F.col("v").isNull().cast("int"))
    return j.groupBy(F.col("region").alias("state"), "day").agg(scoring.first_rule([("hit", hit == 1), ("ungradeable", hole == 1), ("miss", F.lit(True))]).alias("grade"))
