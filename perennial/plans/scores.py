"""Scores, alerts, claims, leads, vector search and interval rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import joins, scoring, vectors
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t


@query(f"""WITH {EVENT_DAYS}, x AS (SELECT day, least(30.0, sum(n) FILTER (WHERE event_type = 'error') * 0.4) AS a, least(25.0, max(max_value) FILTER (WHERE event_type = 'purchase') * 0.25) AS b, least(20.0, sum(users) * 0.1) AS c FROM event_days GROUP BY 1),
s AS (SELECT day, floor(greatest(0, least(100, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) * 100 / 75)) + 0.5) AS score FROM x) SELECT day, score, row_number() OVER (ORDER BY score DESC, day) AS place FROM s""")
def convergence_score(spark, d):
    k = F.col("event_type")
    x = event_days(spark, d).groupBy("day").agg((F.sum(F.when(k == "error", F.col("n"))) * 0.4).alias("a"), (F.max(F.when(k == "purchase", F.col("max_value"))) * 0.25).alias("b"), (F.sum("users") * 0.1).alias("c"))
    s = x.select("day", scoring.composite({"errors": (F.col("a"), 30.0), "sales": (F.col("b"), 25.0), "users": (F.col("c"), 20.0)}, 75.0).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "day")))


@query(f"""WITH {EVENT_DAYS}, l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM event_days)
SELECT event_type, day, CASE WHEN n - before >= 30 THEN 'jump' WHEN n >= 80 AND before < 80 THEN 'cross' WHEN max_value >= 99.9 THEN 'severe' END AS rule FROM l WHERE n - before >= 30 OR (n >= 80 AND before < 80) OR max_value >= 99.9""")
def alert_rules(spark, d):
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    n, b = F.col("n"), F.col("before")
    rule = scoring.first_rule([("jump", n - b >= 30), ("cross", (n >= 80) & (b < 80)), ("severe", F.col("max_value") >= 99.9)])
    return event_days(spark, d).withColumn("before", before).select("event_type", "day", rule.alias("rule")).where("rule is not null")


@query("""WITH RECURSIVE a AS (SELECT DISTINCT event_type, ts FROM events WHERE value > 98), k AS (SELECT event_type, min(ts) AS ts FROM a GROUP BY 1
UNION ALL SELECT k.event_type, (SELECT min(a.ts) FROM a WHERE a.event_type = k.event_type AND epoch_us(a.ts) - epoch_us(k.ts) >= 172800000000) FROM k WHERE k.ts IS NOT NULL)
SELECT event_type, ts FROM k WHERE ts IS NOT NULL""")
def throttle_alerts(spark, d):
    return scoring.throttle(t(spark, d, "events").where("value > 98"), ["event_type"], "ts", 48)


_CLAIMS = """c AS (SELECT event_id, user_id AS state, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), w AS (SELECT event_id, state, day, unnest(['click', 'error', 'view']) AS domain FROM c),
s AS (SELECT user_id AS state, CAST(ts AS DATE) AS signal_day, event_type AS domain FROM events)"""


@query(f"""WITH {_CLAIMS}, h AS (SELECT event_id, w.domain, count(*) AS n FROM w JOIN s ON w.state = s.state AND w.domain = s.domain AND signal_day - day BETWEEN 1 AND 3 GROUP BY 1, 2),
g AS (SELECT w.event_id, count(*) AS domains, count(*) FILTER (WHERE n >= 1) AS met FROM w LEFT JOIN h ON w.event_id = h.event_id AND w.domain = h.domain GROUP BY 1)
SELECT event_id, domains, met, CASE WHEN met / domains >= 0.8 THEN 'confirmed' WHEN met / domains >= 0.4 THEN 'partial' ELSE 'missed' END AS grade FROM g""")
def grade_domain_claims(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    claims = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("state"), "day", F.array(*map(F.lit, ("click", "error", "view"))).alias("domains"))
    return scoring.domain_grade(claims, e.select(F.col("user_id").alias("state"), F.col("day").alias("signal_day"), F.col("event_type").alias("domain")), "event_id", 3, 1)


@query(f"""WITH {DAILY}, z AS (SELECT region, day, CASE WHEN count(value) OVER w >= 5 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
p AS (SELECT DISTINCT a.region, a.day FROM daily a WHERE (SELECT count(*) FROM daily b WHERE b.region = a.region AND b.value > 300000 AND a.day - b.day BETWEEN 0 AND 7) >= 3)
SELECT z.region AS state, z.day FROM z JOIN p ON z.region = p.region AND z.day = p.day WHERE z.z >= 1.5""")
def claim_fires(spark, d):
    x = daily(spark, d).withColumnRenamed("region", "state")
    claim = {"mode": "all", "conditions": [{"kind": "z", "source": "revenue", "path": "value", "op": "gte", "z": 1.5, "baseline_days": 30}, {"kind": "presence", "source": "high", "lookback": 7, "min_count": 3}]}
    return scoring.claim_fires(claim, {"revenue": x, "high": x.where("value > 300000")})


@query(f"""WITH {DAILY}, f AS (SELECT region AS state, day FROM daily WHERE value > 500000), o AS (SELECT region AS state, day AS outcome_day FROM daily WHERE n >= 4), k AS (SELECT region AS state, day FROM daily WHERE day(day) = 10),
a AS (SELECT state, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.state = f.state AND outcome_day - f.day BETWEEN 1 AND 5)) AS hits, count(*) AS fires FROM f GROUP BY 1),
b AS (SELECT state, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM o WHERE o.state = k.state AND outcome_day - k.day BETWEEN 1 AND 5)) AS control_hits, count(*) AS control_days FROM k GROUP BY 1)
SELECT a.state, hits, fires, control_hits, control_days, round((hits / fires) / greatest(control_hits / control_days, 1 / (2 * control_days)), 6) AS lift FROM a LEFT JOIN b ON a.state = b.state""")
def grade_claims(spark, d):
    x = daily(spark, d).withColumnRenamed("region", "state")
    g = scoring.grade_claim(x.where("value > 500000"), x.where("n >= 4").select("state", F.col("day").alias("outcome_day")), x.where("dayofmonth(day) = 10"), 5)
    return g.withColumn("lift", F.round("lift", 6)).select("state", "hits", "fires", "control_hits", "control_days", "lift")


@query(f"""WITH {EVENT_DAYS}, f AS (SELECT event_type FROM event_days WHERE day = DATE '2024-01-20' AND n % 2 = 0), o AS (SELECT event_type, day AS opened_at FROM event_days WHERE day = DATE '2024-01-19' AND n % 3 <> 0)
SELECT coalesce(f.event_type, o.event_type) AS event_type, CASE WHEN f.event_type IS NOT NULL AND opened_at IS NULL THEN 'open' WHEN f.event_type IS NOT NULL THEN 'refresh' ELSE 'fade' END AS action, coalesce(opened_at, DATE '2024-01-20') AS opened_at FROM f FULL JOIN o ON f.event_type = o.event_type""")
def lead_lifecycle(spark, d):
    e = event_days(spark, d)
    return scoring.lead_step(e.where("day = date'2024-01-20' and n % 2 = 0"), e.where("day = date'2024-01-19' and n % 3 <> 0").select("event_type", F.col("day").alias("opened_at")), ["event_type"], "2024-01-20")


@query("""WITH g AS (SELECT l_shipmode AS source, l_discount >= 0.04 AS hit, l_tax * 30 AS lift FROM (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS l_shipmode, * FROM lineitem)) SELECT source, count(*) AS graded, count(*) FILTER (WHERE hit AND lift > 1) AS good,
round(count(*) FILTER (WHERE hit AND lift > 1) / count(*), 6) AS accuracy, count(*) >= 5 AND count(*) FILTER (WHERE hit AND lift > 1) / count(*) < 0.4 AS suppressed FROM g GROUP BY 1""")
def honest_accuracy(spark, d):
    g = t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("source"), (F.col("l_discount") >= 0.04).alias("hit"), (F.col("l_tax") * 30).alias("lift"))
    return scoring.honest_accuracy(g, ["source"]).withColumn("accuracy", F.round("accuracy", 6))


_SKILL = """f AS (SELECT event_type, CAST(ts AS DATE) + 1 AS day, avg(value) AS temp, count(*) AS wind, min(value) AS precip FROM events GROUP BY 1, 2), a AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS temp, count(*) AS wind, min(value) AS precip FROM events GROUP BY 1, 2)"""


@query(f"WITH {_SKILL} SELECT event_type, day, round(least(100, greatest(0, 100 - (2 * abs(f.temp - a.temp) + abs(f.wind - a.wind) + 3 * abs(f.precip - a.precip)))), 6) AS skill FROM f JOIN a USING (event_type, day)")
def forecast_skill(spark, d):
    a = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("temp"), F.count("*").cast("double").alias("wind"), F.min("value").alias("precip"))
    return scoring.forecast_skill(a.withColumn("day", F.date_add("day", 1)), a, ["event_type", "day"]).withColumn("skill", F.round("skill", 6))


@query("""WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) // 6 AS quarter, (ts, event_id) AS ts, ts AS moment, value AS temp, (value * 7) % 360 AS wind_dir, CASE WHEN 980 + value / 2 BETWEEN 870 AND 1100 THEN 980 + value / 2 END AS pressure FROM events),
g AS (SELECT user_id, day, quarter, min_by(temp, ts) AS t1, max_by(temp, ts) AS t2, min_by(wind_dir, ts) AS w1, max_by(wind_dir, ts) AS w2, arg_min_null(pressure, ts) AS p1, arg_max_null(pressure, ts) AS p2, epoch(max(moment)) - epoch(min(moment)) AS s FROM o GROUP BY 1, 2, 3),
h AS (SELECT *, least(abs(w2 - w1), 360 - abs(w2 - w1)) AS turn FROM g WHERE s BETWEEN 3600 AND 21600),
e AS (SELECT user_id, day, quarter, list_filter([CASE WHEN t1 - t2 > 5 THEN CASE WHEN t1 - t2 > 12 THEN 'temp-drop:high' ELSE 'temp-drop:medium' END END, CASE WHEN turn > 60 THEN CASE WHEN turn > 135 THEN 'wind-shift:high' ELSE 'wind-shift:medium' END END,
CASE WHEN p2 - p1 < -2 THEN CASE WHEN p2 - p1 < -6 THEN 'pressure-drop:high' ELSE 'pressure-drop:medium' END END, CASE WHEN p2 - p1 > 3 THEN 'pressure-rise:medium' END], lambda x: x IS NOT NULL) AS f FROM h)
SELECT user_id, day, quarter, split_part(x, ':', 1) AS event, split_part(x, ':', 2) AS severity FROM (SELECT user_id, day, quarter, unnest(CASE WHEN len(f) >= 2 THEN list_append(f, 'front-passage:high') ELSE f END) AS x FROM e)""")
def station_changes(spark, d):
    o = t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).alias("quarter"), "ts", "event_id", F.col("value").alias("temp"), ((F.col("value") * 7) % 360).alias("wind_dir"), (980 + F.col("value") / 2).alias("pressure"))
    return scoring.station_changes(o, ["user_id", "day", "quarter"], "ts", ["event_id"])


# --- vectors

_NORM = "sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * z)))"
_UNIT = f"u AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE) / {_NORM}) AS v FROM embeddings)"
_SIM = "round(list_dot_product(a.v, b.v), 9)"
_HITS = f"""{_UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_SIM} AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p)"""


def _queries(spark, d):
    return t(spark, d, "embeddings").where("vec_id % 20 = 0")


@query(f"WITH {_HITS} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM h WHERE rank <= 10")
def cosine_top_k(spark, d):
    return vectors.search(t(spark, d, "embeddings"), _queries(spark, d), 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


_W3 = """w AS (SELECT h.*, 0.5 + (id % 5) * 0.25 AS weight, CAST((id * 37) % 400 AS DOUBLE) AS age FROM h WHERE rank <= {inner}), x AS (SELECT *, similarity * weight AS weighted, round(similarity * weight * (1 + 0.5 * exp(-least(age, 365.0) / 30)), 9) AS s FROM w WHERE similarity > 0.1{extra}),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM x) SELECT query_id, id, round(weighted, 6) AS similarity, place AS rank FROM y WHERE place <= 10"""


def _weighted(spark, d, inner, extra=None):
    h = vectors.search(t(spark, d, "embeddings"), _queries(spark, d), inner).drop("rank")
    h = h.withColumns({"weight": 0.5 + (F.col("id") % 5) * 0.25, "age": ((F.col("id") * 37) % 400).cast("double")})
    return vectors.weighted(h, "similarity", F.col("weight"), F.col("age"), 0.5, 0.1, 10, inner, extra=extra).select("query_id", "id", F.round("weighted", 6).alias("similarity"), "rank")


@query(f"WITH {_HITS}, " + _W3.format(inner=40, extra=""))
def weighted_search(spark, d):
    return _weighted(spark, d, 40)


@query(f"WITH {_HITS}, " + _W3.format(inner=400, extra=" AND age < 200"))
def weighted_search_dates(spark, d):
    return _weighted(spark, d, 400, F.col("age") < 200)


@query(f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS source_id, b.vec_id AS matched_id, {_SIM} AS similarity FROM u a JOIN u b ON a.label <> b.label WHERE a.vec_id % 20 = 0)
SELECT source_id, matched_id, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.15 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, matched_id) <= 3""")
def cross_domain_matches(spark, d):
    e = t(spark, d, "embeddings")
    h = vectors.search(e, _queries(spark, d), 3, apart="label").where("similarity >= 0.15")
    return h.select(F.col("query_id").alias("source_id"), F.col("id").alias("matched_id"), F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_HITS}, g AS (SELECT query_id, id % 30 AS date_key, avg(similarity) AS m, count(*) AS entries FROM h WHERE rank <= 50 AND abs(id % 30 - query_id % 30) > 3 GROUP BY 1, 2)
SELECT query_id, date_key, round(m, 6) AS similarity, entries FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(m, 9) DESC, date_key) <= 5""")
def similar_dates(spark, d):
    h = vectors.search(t(spark, d, "embeddings"), _queries(spark, d), 50).withColumn("date_key", F.col("id") % 30)
    g = h.where(F.abs(F.col("date_key") - F.col("query_id") % 30) > 3).groupBy("query_id", "date_key").agg(F.avg("similarity").alias("m"), F.count("*").alias("entries"))
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("m", 9).desc(), "date_key"))
    return g.withColumn("k", k).where("k <= 5").select("query_id", "date_key", F.round("m", 6).alias("similarity"), "entries")


# --- classifiers and interval rules


@query(f"""WITH {EVENT_DAYS}, w AS (SELECT event_type, day, n, CASE WHEN n > 85 THEN 'd4' WHEN n > 75 THEN 'd3' WHEN n > 65 THEN 'd2' WHEN n > 55 THEN 'd1' ELSE 'normal' END AS class FROM event_days)
SELECT event_type, day, class, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM w""")
def ordered_class_with_change(spark, d):
    n = F.col("n")
    cls = num.ladder([(n > 85, "d4"), (n > 75, "d3"), (n > 65, "d2"), (n > 55, "d1")], "normal")
    return event_days(spark, d).select("event_type", "day", cls.alias("class"), (n - F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).alias("change"))


@query(f"""WITH {DAILY}, m AS (SELECT region, day, value, median(value) OVER (PARTITION BY region) AS med FROM daily) SELECT region, day, CASE WHEN med <= 0 THEN 'insufficient' WHEN value / med > 2 THEN 'much above' WHEN value / med < 0.5 THEN 'much below' WHEN value / med > 1.5 THEN 'above' WHEN value / med < 0.7 THEN 'below' ELSE 'normal' END AS class FROM m""")
def ratio_class(spark, d):
    x = daily(spark, d)
    med = x.groupBy("region").agg(F.median("value").alias("med"))
    r = F.col("value") / F.col("med")
    cls = num.ladder([(F.col("med") <= 0, "insufficient"), (r > 2, "much above"), (r < 0.5, "much below"), (r > 1.5, "above"), (r < 0.7, "below")], "normal")
    return x.join(F.broadcast(med), "region").select("region", "day", cls.alias("class"))


@query(f"""WITH {DAILY}, m AS (SELECT region, year(day) * 12 + month(day) AS m, sum(value) / 1e6 AS v FROM daily GROUP BY 1, 2), a AS (SELECT region, m, v, avg(v) OVER (PARTITION BY region ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, avg(v) OVER (PARTITION BY region ORDER BY m ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prior3 FROM m)
SELECT region, m, CASE WHEN last3 - prior3 > 0.3 THEN 'rising' WHEN last3 - prior3 < -0.3 THEN 'falling' WHEN prior3 IS NULL THEN NULL ELSE 'steady' END AS trend FROM a""")
def index_trend(spark, d):
    m = daily(spark, d).groupBy("region", (F.year("day") * 12 + F.month("day")).cast("long").alias("m")).agg((F.sum("value") / 1e6).alias("v"))
    w = Window.partitionBy("region").orderBy("m")
    change = F.avg("v").over(w.rowsBetween(-2, 0)) - F.avg("v").over(w.rowsBetween(-5, -3))
    return m.withColumn("c", change).select("region", "m", num.ladder([(F.col("c") > 0.3, "rising"), (F.col("c") < -0.3, "falling"), (F.col("c").isNotNull(), "steady")]).alias("trend"))


@query("""WITH r AS (SELECT p_brand AS anchor, p_partkey AS rule, p_size AS lo, p_size + 1 + p_partkey % 9 AS hi FROM part) SELECT anchor, min(rule) AS narrowest FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.anchor = a.anchor AND b.hi - b.lo < a.hi - a.lo) GROUP BY 1""")
def narrowest_rule(spark, d):
    r = t(spark, d, "part").select(F.col("p_brand").alias("anchor"), F.col("p_partkey").alias("rule"), (1 + F.col("p_partkey") % 9).alias("width"))
    return r.groupBy("anchor").agg(F.min_by("rule", F.struct("width", "rule")).alias("narrowest"))


@query("""WITH r AS (SELECT p_brand AS anchor, p_size AS lo, p_size + p_partkey % 9 AS hi FROM part) SELECT anchor, CAST(x AS INTEGER) AS day, count(*) AS open FROM r, range(1, 60) d(x) WHERE x BETWEEN lo AND hi GROUP BY 1, 2""")
def open_on_day(spark, d):
    r = t(spark, d, "part").select(F.col("p_brand").alias("anchor"), F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 9).cast("int").alias("hi"))
    return r.withColumn("day", F.explode(F.sequence("lo", "hi"))).where("day between 1 and 59").groupBy("anchor", "day").agg(F.count("*").alias("open"))


@query(f"""WITH {EVENT_DAYS}, c AS (SELECT event_type, day FROM event_days WHERE n < 60) SELECT event_type, q.day, min(c.day) AS next_open FROM (SELECT DISTINCT event_type, day FROM event_days WHERE n >= 60) q LEFT JOIN c USING (event_type) WHERE c.day > q.day AND c.day <= q.day + 10 GROUP BY 1, 2""")
def next_open_day(spark, d):
    e = event_days(spark, d)
    hits = joins.interval_join(e.where("n >= 60").select("event_type", "day"), e.where("n < 60").select("event_type", F.col("day").alias("open")), ["event_type"], "day", "open", 1, 10)
    return hits.groupBy("event_type", "day").agg(F.min("open").alias("next_open"))


@query("""SELECT c_nationkey AS nation, CASE WHEN count(DISTINCT c_mktsegment) = 1 AND count(*) = 1 THEN 'sole' WHEN count(DISTINCT c_mktsegment) = 1 THEN 'agreeing' ELSE 'undetermined' END AS status FROM customer WHERE c_acctbal > 9000 GROUP BY 1""")
def agreement(spark, d):
    n = F.countDistinct("c_mktsegment")
    return t(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(num.ladder([((n == 1) & (F.count("*") == 1), "sole"), (n == 1, "agreeing")], "undetermined").alias("status"))


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS freshest, date_diff('hour', date_trunc('hour', max(ts)), TIMESTAMP '2024-01-31') > 24 AS stale FROM events GROUP BY 1""")
def freshest_with_ttl(spark, d):
    hours = F.expr("timestampdiff(HOUR, date_trunc('HOUR', max(ts)), timestamp'2024-01-31')")
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("freshest"), (hours > 24).alias("stale"))
