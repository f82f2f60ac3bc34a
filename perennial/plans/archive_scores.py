"""The full convergence score and the signatures of indices, on feeds made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky
from ..operators import convergence
from .common import DAILY, daily, query, t

#: Per nation and day a number that stands for what its feeds say; some days say nothing in a feed.
_SAID = """said AS (SELECT c_nationkey AS state, CAST(o_orderdate AS DATE) AS day, CAST(floor(sum(o_totalprice)) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _said(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    # Prices are decimals: as doubles, a sum of whole units comes out just below or above by the order of its rows, and its floor with it.
    price = F.col("o_totalprice").try_cast("decimal(28,10)")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("state"), F.to_date("o_orderdate").alias("day")).agg(F.floor(F.sum(price)).cast("long").alias("v"))


_LIT = "(1 - cos(2 * pi() * (((day - DATE '2000-01-01') + 2451545.0 - 2451550.09766) - 29.530588861 * floor(((day - DATE '2000-01-01') + 2451545.0 - 2451550.09766) / 29.530588861)) / 29.530588861)) / 2 * 100"
_W = "(PARTITION BY state ORDER BY day ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {_SAID}, f AS (SELECT *, CASE WHEN v % 5 <> 0 THEN list_extract(['rising', 'stable', 'falling', 'odd'], CAST(v % 4 + 1 AS INTEGER)) END AS trend, CASE WHEN v % 7 <> 0 THEN list_extract(['flood', 'elevated flow', 'low flow', 'normal'], CAST(v // 3 % 4 + 1 AS INTEGER)) END AS flow,
CASE WHEN v % 11 <> 0 THEN {{'class': list_extract(['exceptional_drought', 'severe_drought', 'moderate_drought', 'abnormally_dry', 'normal', 'other'], CAST(v // 5 % 6 + 1 AS INTEGER)), 'd2': CAST(v % 61 AS DOUBLE)}} END AS drought, CASE WHEN v % 13 <> 0 THEN CAST(v // 7 % 260 AS DOUBLE) END AS aqi,
CASE WHEN v % 3 <> 0 THEN {{'temp': CAST(v % 60 - 10 AS DOUBLE), 'moisture': v // 11 % 80 / 100.0}} END AS soil, CASE WHEN v % 4 <> 0 THEN {{'waves': v // 13 % 50 / 10.0, 'temp': CAST(v % 9 - 2 AS DOUBLE)}} END AS ocean, CASE WHEN v % 6 <> 0 THEN {{'b13': v // 17 % 3 > 0, 'b11': v // 17 % 3 = 2}} END AS photo, CASE WHEN v % 8 <> 0 THEN v // 19 % 100 / 10.0 END AS range FROM said),
a AS (SELECT state, day, state % 2 = 0 AS coastal, last_value(trend IGNORE NULLS) OVER w AS trend, last_value(flow IGNORE NULLS) OVER w AS flow, last_value(drought IGNORE NULLS) OVER w AS drought, last_value(aqi IGNORE NULLS) OVER w AS aqi, last_value(soil IGNORE NULLS) OVER w AS soil, last_value(ocean IGNORE NULLS) OVER w AS ocean, last_value(photo IGNORE NULLS) OVER w AS photo, last_value(range IGNORE NULLS) OVER w AS range FROM f WINDOW w AS {_W}),
ev AS (SELECT state, day, list_extract(['cold_front', 'pressure_drop', 'high_wind', 'first_freeze', 'heavy_precip', 'calm'], CAST(v // 23 % 6 + 1 AS INTEGER)) AS type FROM said WHERE v % 2 = 0),
al AS (SELECT state, day AS onset, day + CAST(v % 3 AS INTEGER) AS expires, list_extract(['winter storm warning', 'wind advisory', 'freeze watch', 'flood warning', 'fire weather', 'heat'], CAST(v // 29 % 6 + 1 AS INTEGER)) AS type FROM said WHERE v % 5 = 1),
we AS (SELECT a.state, a.day, (SELECT coalesce(sum(CASE type WHEN 'cold_front' THEN 15 WHEN 'pressure_drop' THEN 10 WHEN 'high_wind' THEN 5 WHEN 'first_freeze' THEN 10 WHEN 'heavy_precip' THEN 5 ELSE 0 END), 0) FROM (SELECT DISTINCT type FROM ev WHERE ev.state = a.state AND ev.day BETWEEN a.day AND a.day + 3))
+ (SELECT coalesce(sum(CASE WHEN contains(type, 'winter storm') THEN 10 WHEN contains(type, 'wind') THEN 5 WHEN contains(type, 'freeze') THEN 8 WHEN contains(type, 'flood') THEN 8 WHEN contains(type, 'fire') THEN 8 ELSE 0 END), 0) FROM (SELECT DISTINCT type FROM al WHERE al.state = a.state AND a.day BETWEEN onset AND expires)) AS weather,
(SELECT max(v // 31 % 150) FROM said s WHERE s.v % 6 = 0 AND s.state = a.state AND a.day - s.day BETWEEN 0 AND 7) AS deviation, (SELECT max_by({{'high': v % 2 = 1, 'birds': v * 10}}, s.day) FROM said s WHERE s.v % 3 = 1 AND s.state = a.state AND a.day - s.day BETWEEN 0 AND 3) AS flight FROM a),
g AS (SELECT day, max(v) AS v FROM said GROUP BY 1), sp AS (SELECT day, last_value(CASE WHEN v % 10 <> 0 THEN {{'kp': CAST(v % 8 AS DOUBLE), 'storm': CASE v // 37 % 7 WHEN 0 THEN 'G1' WHEN 1 THEN 'quiet' ELSE 'none' END}} END IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS sp FROM g),
l AS (SELECT day, {_LIT} AS lit FROM g),
p AS (SELECT a.state, a.day, CAST(least(20, weather) AS INTEGER) AS weather_score, least(15, CASE WHEN deviation > 100 THEN 15 WHEN deviation > 50 THEN 10 WHEN deviation > 25 THEN 5 ELSE 0 END + CASE WHEN flight.high THEN 5 ELSE 0 END + CASE WHEN flight.birds > 1000000 THEN 5 WHEN flight.birds > 100000 THEN 2 ELSE 0 END) AS biological_score,
CASE WHEN lit < 5 THEN 10 WHEN lit < 15 THEN 5 WHEN lit > 95 THEN 8 ELSE 2 END AS lunar_score, least(15, CASE trend WHEN 'rising' THEN 8 WHEN 'stable' THEN 3 WHEN 'falling' THEN 5 ELSE 0 END + CASE WHEN flow IS NULL THEN 0 WHEN flow = 'flood' THEN 7 WHEN flow = 'elevated flow' THEN 4 WHEN flow = 'low flow' THEN 5 ELSE 1 END) AS water_score,
CASE WHEN drought IS NULL THEN 0 WHEN drought.class = 'exceptional_drought' OR drought.d2 > 50 THEN 15 WHEN drought.d2 > 25 THEN 12 WHEN drought.class = 'severe_drought' THEN 10 WHEN drought.class = 'moderate_drought' THEN 7 WHEN drought.class = 'abnormally_dry' THEN 4 WHEN drought.class = 'normal' THEN 1 ELSE 2 END AS drought_score,
CASE WHEN aqi IS NULL THEN 0 WHEN aqi > 200 THEN 15 WHEN aqi > 150 THEN 12 WHEN aqi > 100 THEN 8 WHEN aqi > 50 THEN 4 ELSE 1 END AS air_score,
CASE WHEN soil IS NULL THEN 0 ELSE coalesce(nullif(CASE WHEN soil.temp < 0 OR soil.temp > 35 THEN 5 ELSE 0 END + CASE WHEN soil.moisture < 0.1 OR soil.moisture > 0.5 THEN 5 ELSE 0 END, 0), 2) END AS soil_score,
CASE WHEN ocean IS NULL OR NOT coastal THEN 0 ELSE CASE WHEN ocean.waves > 3 THEN 7 WHEN ocean.waves > 1.5 THEN 4 ELSE 1 END + CASE WHEN ocean.temp > 0 THEN 2 ELSE 0 END END AS ocean_score,
CASE WHEN sp IS NULL THEN 0 WHEN sp.storm = 'G1' OR sp.kp >= 5 THEN 10 WHEN sp.kp >= 4 THEN 6 WHEN sp.kp >= 3 THEN 3 ELSE 1 END AS space_score, CASE WHEN photo.b13 AND NOT photo.b11 THEN 8 WHEN photo.b11 THEN 5 ELSE 2 END AS photoperiod_score, CASE WHEN NOT coastal THEN 0 WHEN range > 6 THEN 8 WHEN range >= 3 THEN 5 ELSE 2 END AS tide_score
FROM a JOIN we ON we.state = a.state AND we.day = a.day JOIN sp ON sp.day = a.day JOIN l ON l.day = a.day)
SELECT *, {' + '.join(f"CAST({n}_score > {({'soil': 4, 'space': 3}).get(n, 5)} AS INTEGER)" for n in convergence.CAPS)} AS active, least(100.0, floor(({' + '.join(f'{n}_score' for n in convergence.CAPS)}) * 100 / 120.0 + 0.5)) AS score FROM p""")
def domain_scores(spark, d):
    s = _said(spark, d)
    v = F.col("v")
    whole = lambda k: F.floor(v / k)
    pick = lambda names, k: F.get(F.array(*(F.lit(n) for n in names)), (whole(k) % len(names)).cast("int"))
    feed = lambda skip, **fields: s.where(v % skip != 0).select("state", "day", *(c.alias(n) for n, c in fields.items()))
    number = lambda c: c.cast("double")
    feeds = {
        "water": feed(5, trend=pick(["rising", "stable", "falling", "odd"], 1)), "river": feed(7, flow=pick(["flood", "elevated flow", "low flow", "normal"], 3)),
        "drought": feed(11, **{"class": pick(["exceptional_drought", "severe_drought", "moderate_drought", "abnormally_dry", "normal", "other"], 5), "d2": number(v % 61)}), "air": feed(13, aqi=number(whole(7) % 260)),
        "soil": feed(3, temp=number(v % 60 - 10), moisture=whole(11) % 80 / 100.0), "ocean": feed(4, waves=whole(13) % 50 / 10.0, water_temp=number(v % 9 - 2)), "photoperiod": feed(6, below_13h=whole(17) % 3 > 0, below_11h=whole(17) % 3 == 2), "tide": feed(8, range=whole(19) % 100 / 10.0),
    }
    events = s.where("v % 2 = 0").select("state", "day", pick(["cold_front", "pressure_drop", "high_wind", "first_freeze", "heavy_precip", "calm"], 23).alias("type"))
    alerts = s.where("v % 5 = 1").select("state", F.col("day").alias("onset"), F.date_add("day", (v % 3).cast("int")).alias("expires"), pick(["winter storm warning", "wind advisory", "freeze watch", "flood warning", "fire weather", "heat"], 29).alias("type"))
    spikes = s.where("v % 6 = 0").select("state", "day", (whole(31) % 150).alias("deviation"))
    birds = s.where("v % 3 = 1").select("state", "day", (v % 2 == 1).alias("high"), (v * 10).alias("birds"))
    storm = F.when(whole(37) % 7 == 0, "G1").when(whole(37) % 7 == 1, "quiet").otherwise("none")
    space = s.groupBy("day").agg(F.max("v").alias("v")).where(v % 10 != 0).select("day", number(v % 8).alias("kp"), storm.alias("storm"))
    asked = s.select("state", "day", (F.col("state") % 2 == 0).alias("coastal"))
    return convergence.domain_scores(asked, feeds, events, alerts, spikes, birds, sky.moon_lit(F.col("day")) * 100, space)


_INDEX = f"""{DAILY}, mo AS (SELECT region, CAST(date_trunc('month', day) AS DATE) AS month, avg(value) AS m FROM daily WHERE region <> 'MIDDLE EAST' GROUP BY 1, 2),
ix AS (SELECT CASE region WHEN 'AFRICA' THEN 'AO' WHEN 'AMERICA' THEN 'NAO' WHEN 'ASIA' THEN 'ENSO' ELSE 'PDO' END AS index, month, round(2 * (m - avg(m) OVER w) / stddev_pop(m) OVER w, 3) AS value FROM mo WINDOW w AS (PARTITION BY region))"""


@query(f"""WITH {_INDEX}, pairs AS (SELECT a.month, b.index, b.month AS m, b.value, row_number() OVER (PARTITION BY a.month, b.index ORDER BY b.month DESC) AS k FROM (SELECT DISTINCT month FROM ix) a JOIN ix b ON date_diff('month', b.month, a.month) BETWEEN 0 AND 11), v AS (SELECT * FROM pairs WHERE k <= 8),
s AS (SELECT month, min(value) FILTER (WHERE index = 'AO') AS ao_lo, max(value) FILTER (WHERE index = 'AO') AS ao_hi, count(*) FILTER (WHERE index = 'AO') AS ao_n, count(*) FILTER (WHERE index = 'AO' AND value < -1) AS ao_neg, min(value) FILTER (WHERE index = 'NAO') AS nao_lo, count(*) FILTER (WHERE index = 'NAO' AND value < -0.5) AS nao_neg,
min(value) FILTER (WHERE index = 'ENSO') AS en_lo, max(value) FILTER (WHERE index = 'ENSO') AS en_hi, coalesce(avg(value) FILTER (WHERE index = 'ENSO'), 0) AS en_avg, count(*) FILTER (WHERE index = 'ENSO' AND value < -0.5) AS en_neg, count(*) FILTER (WHERE index = 'PDO' AND abs(value) > 1.5) AS pdo_wild, max(abs(value)) FILTER (WHERE index = 'PDO') AS pdo_top, count(*) FILTER (WHERE index = 'PDO' AND value > 1.5) AS pdo_warm, count(*) FILTER (WHERE index = 'PDO' AND value < -1) AS pdo_neg FROM v GROUP BY 1),
c AS (SELECT month, 'cold outbreak' AS signature, CASE WHEN ao_lo < -2 THEN 40 WHEN ao_lo < -1.5 THEN 25 WHEN ao_lo < -1 THEN 10 ELSE 0 END + CASE WHEN ao_neg >= 2 THEN 20 ELSE 0 END + CASE WHEN nao_lo < -1.5 THEN 15 WHEN nao_lo < -1 THEN 5 ELSE 0 END + CASE WHEN en_lo < -1 THEN 15 WHEN en_lo < -0.5 THEN 5 ELSE 0 END AS confidence,
concat_ws('; ', CASE WHEN ao_lo < -2 THEN 'AO extreme' WHEN ao_lo < -1.5 THEN 'AO crash' WHEN ao_lo < -1 THEN 'AO negative' END, CASE WHEN ao_neg >= 2 THEN 'AO stays negative' END, CASE WHEN nao_lo < -1.5 THEN 'NAO crash' WHEN nao_lo < -1 THEN 'NAO negative' END, CASE WHEN en_lo < -1 THEN 'La Nina' WHEN en_lo < -0.5 THEN 'ENSO falls' END) AS conditions FROM s
UNION ALL SELECT month, 'hurricane season', CASE WHEN pdo_wild >= 3 THEN 35 WHEN pdo_wild >= 1 THEN 15 ELSE 0 END + CASE WHEN pdo_top > 2.5 THEN 15 ELSE 0 END + CASE WHEN en_avg < -0.5 THEN 15 WHEN abs(en_avg) < 0.3 THEN 5 ELSE 0 END + CASE WHEN nao_neg >= 3 THEN 15 ELSE 0 END,
concat_ws('; ', CASE WHEN pdo_wild >= 3 THEN 'PDO extreme for months' WHEN pdo_wild >= 1 THEN 'PDO extreme' END, CASE WHEN pdo_top > 2.5 THEN 'PDO peak' END, CASE WHEN en_avg < -0.5 THEN 'La Nina behind' WHEN abs(en_avg) < 0.3 THEN 'ENSO neutral' END, CASE WHEN nao_neg >= 3 THEN 'NAO trends negative' END) FROM s
UNION ALL SELECT month, 'flooding', CASE WHEN en_hi > 1.5 THEN 30 WHEN en_hi > 1 THEN 15 WHEN en_hi > 0.5 THEN 5 ELSE 0 END + CASE WHEN pdo_warm >= 2 THEN 25 ELSE 0 END + CASE WHEN nao_lo < -1.5 THEN 20 ELSE 0 END,
concat_ws('; ', CASE WHEN en_hi > 1.5 THEN 'strong El Nino' WHEN en_hi > 1 THEN 'El Nino' WHEN en_hi > 0.5 THEN 'weak El Nino' END, CASE WHEN pdo_warm >= 2 THEN 'PDO warm' END, CASE WHEN nao_lo < -1.5 THEN 'NAO crash' END) FROM s
UNION ALL SELECT month, 'drought', CASE WHEN en_neg >= 4 THEN 30 WHEN en_neg >= 2 THEN 15 ELSE 0 END + CASE WHEN pdo_neg >= 3 THEN 25 ELSE 0 END + CASE WHEN ao_n >= 3 AND ao_hi - ao_lo > 3 THEN 20 ELSE 0 END,
concat_ws('; ', CASE WHEN en_neg >= 4 THEN 'La Nina lasts' WHEN en_neg >= 2 THEN 'La Nina begins' END, CASE WHEN pdo_neg >= 3 THEN 'PDO negative' END, CASE WHEN ao_n >= 3 AND ao_hi - ao_lo > 3 THEN 'AO swings' END) FROM s)
SELECT month, signature, CAST(least(100, confidence) AS INTEGER) AS confidence, conditions FROM c WHERE confidence >= 20""")
def index_signatures(spark, d):
    from pyspark.sql import Window

    m = daily(spark, d).where("region <> 'MIDDLE EAST'").groupBy("region", F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.avg("value").alias("m"))
    w = Window.partitionBy("region")
    name = F.when(F.col("region") == "AFRICA", "AO").when(F.col("region") == "AMERICA", "NAO").when(F.col("region") == "ASIA", "ENSO").otherwise("PDO")
    ix = m.select(name.alias("index"), "month", F.round(2 * (F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w), 3).alias("value"))
    found = convergence.signatures(convergence.recent_values(ix, "index", "month", "value"))
    return found.withColumn("conditions", F.array_join("conditions", "; "))


_NOW = "2024-01-20 00:00:00"
_USERS = f"""al AS (SELECT c_custkey AS alert, list_extract(['score_spike', 'weather_event', 'threshold', 'new_data'], CAST(c_custkey % 4 + 1 AS INTEGER)) AS trigger, CASE WHEN c_custkey % 3 <> 0 THEN [CAST(c_custkey % 7 AS VARCHAR), CAST(c_custkey % 11 AS VARCHAR)] END AS states,
CASE c_custkey // 4 % 5 WHEN 0 THEN 30 * 60 WHEN 1 THEN 5 * 3600 WHEN 2 THEN 2 * 86400 ELSE 3 * 3600 END AS every, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '{_NOW}' - to_hours(CAST(c_custkey % 80 AS INTEGER)) END AS last FROM customer),
du AS (SELECT *, coalesce(last, TIMESTAMP '{_NOW}' - INTERVAL 24 HOURS) AS since FROM al WHERE last IS NULL OR epoch(TIMESTAMP '{_NOW}') - epoch(last) >= every),
dn AS (SELECT CAST(user_id % 13 AS VARCHAR) AS state, CAST(ts AS DATE) AS day, CAST(sum(value) / 10 AS DOUBLE) AS score FROM events GROUP BY 1, 2),
ju AS (SELECT state, score, lag(score) OVER (PARTITION BY state ORDER BY day) AS previous, CAST(day AS TIMESTAMP) AS moment FROM dn), sc AS (SELECT state, score FROM dn QUALIFY row_number() OVER (PARTITION BY state ORDER BY day DESC) = 1)"""


@query(f"""WITH {_USERS},
a AS (SELECT alert, trigger, count(*) AS n, list_sort(list(DISTINCT state)) AS states FROM du JOIN ju ON (states IS NULL OR list_contains(states, state)) AND moment > since AND score >= 60 AND abs(score - previous) >= 15 WHERE trigger = 'score_spike' GROUP BY 1, 2),
e AS (SELECT alert, trigger, count(DISTINCT (event_type, user_id % 13, ts)) AS n, list_sort(list(DISTINCT CAST(user_id % 13 AS VARCHAR))) AS states FROM du JOIN events ON (states IS NULL OR list_contains(states, CAST(user_id % 13 AS VARCHAR))) AND ts > since AND event_type = CASE WHEN alert % 2 = 0 THEN 'error' ELSE 'signup' END WHERE trigger = 'weather_event' GROUP BY 1, 2),
b AS (SELECT alert, trigger, count(*) AS n, list_sort(list(DISTINCT state)) AS states FROM du JOIN sc ON (states IS NULL OR list_contains(states, state)) AND CASE WHEN alert % 8 < 4 THEN score < 40 ELSE score >= 75 END WHERE trigger = 'threshold' GROUP BY 1, 2),
n AS (SELECT alert, trigger, count(*) AS n, CAST([] AS VARCHAR[]) AS states FROM du JOIN events ON ts > since AND event_type = CASE WHEN alert % 3 = 0 THEN 'view' ELSE 'click' END WHERE trigger = 'new_data' GROUP BY 1, 2)
SELECT alert, trigger, n, array_to_string(states, ',') AS states FROM (FROM a UNION ALL FROM e UNION ALL FROM b UNION ALL FROM n)""")
def user_alert_fires(spark, d):
    from pyspark.sql import Window

    from ..operators import user_alerts

    k = F.col("c_custkey")
    pick = lambda names, at: F.get(F.array(*(F.lit(x) for x in names)), at.cast("int"))
    text = lambda c: c.cast("string")
    alerts = t(spark, d, "customer").select(
        k.alias("alert"), pick(["score_spike", "weather_event", "threshold", "new_data"], k % 4).alias("trigger"), F.when(k % 3 != 0, F.array_distinct(F.array(text(k % 7), text(k % 11)))).alias("states"), pick(["30min", "5h", "2d", "3hr", "soon"], F.floor(k / 4) % 5).alias("every"),
        F.when(k % 5 != 0, F.lit(_NOW).cast("timestamp") - F.make_dt_interval(hours=(k % 80).cast("int"))).alias("last"), F.lit(None).cast("double").alias("min_change"), F.lit(None).cast("double").alias("min_score"), F.array(F.when(k % 2 == 0, "error").otherwise("signup")).alias("types"),
        F.when(k % 8 < 4, "<").alias("compare"), F.when(k % 8 < 4, 40.0).alias("bound"), F.when(k % 3 == 0, "view").otherwise("click").alias("content"),
    )
    e = t(spark, d, "events").withColumn("state", text(F.col("user_id") % 13))
    daily_scores = e.groupBy("state", F.to_date("ts").alias("day")).agg((F.sum("value") / 10).alias("score"))
    w = Window.partitionBy("state").orderBy("day")
    jumps = daily_scores.select("state", "score", F.lag("score").over(w).alias("previous"), F.col("day").cast("timestamp").alias("at"))
    last = daily_scores.withColumn("r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("day")))).where("r = 1").select("state", "score")
    events = e.select(F.col("event_type").alias("type"), F.array("state").alias("states"), F.col("ts").cast("timestamp").alias("at"))
    entries = e.select(F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("at"))
    fired = user_alerts.fires(alerts, _NOW, jumps, events, last, entries)
    return fired.withColumn("states", F.array_join("states", ","))
