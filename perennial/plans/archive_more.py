"""Lineups, dossiers, sweeps, strangest days, hybrid search, interval resolution and ingest classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import clusters, joins, series, vectors
from ..operators import statistics as st
from ..sources import archive
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t


@query(f"""WITH {DAILY}, a AS (SELECT region, day, value, strftime(day, '%m-%d') AS md FROM daily), l AS (SELECT * FROM a WHERE md = '05-10' QUALIFY row_number() OVER (PARTITION BY region ORDER BY day DESC) = 1)
SELECT l.region, a.day, round(abs(a.value - l.value), 2) AS away FROM l JOIN a ON a.region = l.region AND a.md = l.md AND a.day < l.day QUALIFY row_number() OVER (PARTITION BY l.region ORDER BY abs(a.value - l.value), a.day) <= 3""")
def dossier_closest_years(spark, d):
    a = daily(spark, d).where("date_format(day, 'MM-dd') = '05-10'")
    last = joins.latest(a, ["region"], [F.desc("day")]).select("region", F.col("day").alias("now"), F.col("value").alias("v"))
    c = a.join(last, "region").where("day < now").withColumn("away", F.abs(F.col("value") - F.col("v")))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy("away", "day"))).where("k <= 3").select("region", "day", F.round("away", 2).alias("away"))


@query(f"""WITH {DAILY}, x AS (SELECT region, year(day) AS year, day, value, (SELECT count(*) FROM daily b WHERE b.region = a.region AND b.day - a.day BETWEEN 1 AND 7) AS following, (SELECT min(b.value) FROM daily b WHERE b.region = a.region AND b.day - a.day BETWEEN 1 AND 7) AS low FROM daily a WHERE strftime(day, '%m-%d') BETWEEN '06-01' AND '06-05')
SELECT region, count(*) AS years, count(*) FILTER (WHERE value - low >= 100000) AS cooled FROM x WHERE following >= 3 GROUP BY 1""")
def control_line(spark, d):
    w = Window.partitionBy("region").orderBy(series.day_number("day")).rangeBetween(1, 7)
    x = daily(spark, d).withColumns({"following": F.count("*").over(w), "low": F.min("value").over(w)})
    x = x.where("date_format(day, 'MM-dd') between '06-01' and '06-05' and following >= 3")
    return x.groupBy("region").agg(F.count("*").alias("years"), F.count_if(F.col("value") - F.col("low") >= 100000).alias("cooled"))


@query(f"""WITH {DAILY}, n AS (SELECT region, day, value, avg(value) OVER (PARTITION BY region, month(day)) AS normal FROM daily), p AS (SELECT a.region, a.day, b.day AS past FROM n a JOIN n b ON a.region = b.region AND strftime(a.day, '%m-%d') = strftime(b.day, '%m-%d') AND b.day < a.day
WHERE CASE WHEN abs(a.value - a.normal) <= 50000 THEN abs(b.value - b.normal) <= 50000 ELSE sign(a.value - a.normal) = sign(b.value - b.normal) AND abs(a.value - b.value) <= 100000 END) SELECT region, day, count(*) AS alike FROM p GROUP BY 1, 2""")
def lineup_counts(spark, d):
    n = daily(spark, d).withColumn("off", F.col("value") - F.avg("value").over(Window.partitionBy("region", F.month("day")))).withColumn("md", F.date_format("day", "MM-dd"))
    b = n.select("region", "md", F.col("day").alias("past"), F.col("value").alias("v2"), F.col("off").alias("off2"))
    near, other = F.abs("off") <= 50000, (F.signum("off") == F.signum("off2")) & (F.abs(F.col("value") - F.col("v2")) <= 100000)
    hit = F.when(near, F.abs("off2") <= 50000).otherwise(other)
    return n.join(b, ["region", "md"]).where((F.col("past") < F.col("day")) & hit).groupBy("region", "day").agg(F.count("*").alias("alike"))


@query(f"""WITH {DAILY}, z AS (SELECT region, day, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM daily WINDOW w AS (PARTITION BY region, month(day))), s AS (SELECT day, threshold, count(*) FILTER (WHERE abs(z) >= threshold) AS odd, count(*) AS states FROM z, (VALUES (1.0), (1.5), (2.0), (2.5)) v(threshold) GROUP BY 1, 2)
SELECT day, threshold, odd, states, states >= 4 AS covered FROM s WHERE odd >= 2""")
def strangest_days(spark, d):
    w = Window.partitionBy("region", F.month("day"))
    z = daily(spark, d).select("day", ((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)).alias("z"))
    s = z.withColumn("threshold", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0, 2.5))))).groupBy("day", "threshold").agg(F.count_if(F.abs("z") >= F.col("threshold")).alias("odd"), F.count("*").alias("states"))
    return s.where("odd >= 2").withColumn("covered", F.col("states") >= 4)


@query(f"""WITH {DAILY}, a AS (SELECT region, day FROM daily WHERE value > 600000), c AS (SELECT DISTINCT region, CAST(day + INTERVAL 1 YEAR AS DATE) AS day FROM a WHERE (region, CAST(day + INTERVAL 1 YEAR AS DATE)) NOT IN (SELECT region, day FROM a)),
g AS (SELECT tau, lead, k FROM (VALUES (200000.0), (300000.0)) v(tau), (VALUES (7), (30)) w(lead), (VALUES (2), (5)) x(k)),
ra AS (SELECT * FROM a WHERE (SELECT count(*) FROM daily b WHERE b.region = a.region AND a.day - b.day BETWEEN 1 AND 30) >= 20), rc AS (SELECT * FROM c WHERE (SELECT count(*) FROM daily b WHERE b.region = c.region AND c.day - b.day BETWEEN 1 AND 30) >= 20),
f AS (SELECT tau, lead, k, count(*) AS n, count(DISTINCT year(a.day)) AS years, count(*) FILTER (WHERE (SELECT count(*) FROM daily b WHERE b.region = a.region AND b.value >= tau AND a.day - b.day BETWEEN 1 AND lead) >= k) AS hits FROM ra a, g GROUP BY 1, 2, 3),
h AS (SELECT tau, lead, k, count(*) AS m, count(*) FILTER (WHERE (SELECT count(*) FROM daily b WHERE b.region = c.region AND b.value >= tau AND c.day - b.day BETWEEN 1 AND lead) >= k) AS control_hits FROM rc c, g GROUP BY 1, 2, 3)
SELECT tau, lead, k, n, years, hits, m, control_hits, round((hits / n) / greatest(control_hits / m, 1 / (2 * m)), 6) AS lift, round(least(1.0, list_sum(list_transform(range(hits, least(n, hits + control_hits) + 1), lambda i:
exp(lgamma(n + 1) + lgamma(m + 1) + lgamma(hits + control_hits + 1) + lgamma(n + m - hits - control_hits + 1) - lgamma(n + m + 1) - lgamma(i + 1) - lgamma(n - i + 1) - lgamma(hits + control_hits - i + 1) - lgamma(m - hits - control_hits + i + 1))))), 6) AS p
FROM f JOIN h USING (tau, lead, k) WHERE n >= 20 AND years >= 5""")
def sweep_grid(spark, d):
    x = daily(spark, d).select("region", "day", "value")
    a = x.where("value > 600000").select("region", "day")
    c = a.select("region", F.expr("cast(day + interval 1 year as date)").alias("day")).distinct().join(a, ["region", "day"], "left_anti")
    anchors = a.withColumn("case", F.lit(1)).unionByName(c.withColumn("case", F.lit(0)))
    seen = x.select("region", F.col("day").alias("d2"), F.col("value").alias("v"))
    # All cells of the grid from one interval join: per anchor the counts of each (tau, lead), then the k's.
    hits = joins.interval_join(anchors, seen, ["region"], "day", "d2", -30, -1, "left")
    cells = [(tau, lead) for tau in (200000.0, 300000.0) for lead in (7, 30)]
    # Floors: 20 readable days of the 30 before an anchor, 20 anchors in 5 years or more.
    counts = hits.groupBy("case", "region", "day").agg(F.count("d2").alias("readable"), *(F.count_if((F.col("v") >= tau) & (F.datediff("day", "d2") <= lead)).alias(f"c{i}") for i, (tau, lead) in enumerate(cells)))
    grid = F.explode(F.array(*(F.struct(F.lit(tau).alias("tau"), F.lit(lead).alias("lead"), F.lit(k).alias("k"), (F.col(f"c{i}") >= k).alias("hit")) for i, (tau, lead) in enumerate(cells) for k in (2, 5))))
    g = counts.where("readable >= 20").select("case", "day", grid.alias("g")).groupBy("g.tau", "g.lead", "g.k")
    case, hit = F.col("case") == 1, F.col("g.hit")
    s = g.agg(F.count_if(case).alias("n"), F.countDistinct(F.when(case, F.year("day"))).alias("years"), F.count_if(case & hit).alias("hits"), F.count_if(~case).alias("m"), F.count_if(~case & hit).alias("control_hits"))
    s = s.where("n >= 20 and years >= 5").withColumn("lift", F.round(st.finite_lift(F.col("hits"), F.col("n"), F.col("control_hits"), F.col("m")), 6))
    return s.withColumn("p", F.round(st.fisher_greater(F.col("hits"), F.col("n") - F.col("hits"), F.col("control_hits"), F.col("m") - F.col("control_hits")), 6))


@query("""WITH RECURSIVE x AS (SELECT o_orderpriority AS family, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(c_nationkey % 5 AS VARCHAR) AS state, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS i FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000),
r AS (SELECT DISTINCT family, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS cluster, CAST(0 AS BIGINT) AS total, CAST([] AS STRUCT(k BIGINT, last DATE, states VARCHAR[])[]) AS live FROM x
UNION ALL SELECT family, i, id, coalesce(hit, total), total + CAST(hit IS NULL AS BIGINT), CASE WHEN hit IS NULL THEN list_append(near, {'k': total, 'last': day, 'states': [state]}) ELSE list_transform(near, lambda c: CASE WHEN c.k = hit THEN {'k': c.k, 'last': day, 'states': list_append(c.states, state)} ELSE c END) END
FROM (SELECT *, list_min(list_transform(list_filter(near, lambda c: list_contains(c.states, state)), lambda c: c.k)) AS hit FROM (SELECT r.family, x.i, x.id, x.day, x.state, r.total, list_filter(r.live, lambda c: x.day - c.last <= 7) AS near FROM r JOIN x ON x.family = r.family AND x.i = r.i + 1)))
SELECT family, id, cluster FROM r WHERE id IS NOT NULL""")
def greedy_anchors(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    x = o.where("o_totalprice > 450000").join(c, o.o_custkey == c.c_custkey)
    x = x.select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.array((F.col("c_nationkey") % 5).cast("string")).alias("states"))
    return clusters.greedy_anchors(x, "family", "id", "day", "states")


@query(f"""WITH RECURSIVE {EVENT_DAYS}, x AS (SELECT event_type, day, CAST(n AS DOUBLE) AS s, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM event_days),
r AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DATE) AS opened, CAST(NULL AS DOUBLE) AS base, CAST(NULL AS DATE) AS recognised, 0 AS calm, CAST(NULL AS DATE) AS o, CAST(NULL AS DATE) AS rec, CAST(NULL AS DATE) AS closed FROM x
UNION ALL SELECT event_type, i, s, CASE WHEN still < 2 THEN op END, CASE WHEN still < 2 THEN ba END, CASE WHEN still < 2 THEN re END, CASE WHEN still < 2 THEN still ELSE 0 END, CASE WHEN still >= 2 THEN op END, CASE WHEN still >= 2 THEN re END, CASE WHEN still >= 2 THEN day END
FROM (SELECT *, CASE WHEN op IS NOT NULL AND recognised IS NULL AND s >= 75 THEN day ELSE recognised END AS re, CASE WHEN op IS NOT NULL AND s <= ba THEN calm + 1 ELSE 0 END AS still
FROM (SELECT r.event_type, x.i, x.day, x.s, r.recognised, r.calm, CASE WHEN r.opened IS NULL AND x.s - r.last > 10 THEN x.day ELSE r.opened END AS op, CASE WHEN r.opened IS NULL AND x.s - r.last > 10 THEN r.last ELSE r.base END AS ba FROM r JOIN x ON x.event_type = r.event_type AND x.i = r.i + 1)))
SELECT event_type, o AS opened, rec AS recognised, closed FROM r WHERE closed IS NOT NULL UNION ALL SELECT event_type, opened, recognised, NULL FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i DESC) AS k FROM r) WHERE k = 1 AND opened IS NOT NULL""")
def state_arcs(spark, d):
    return clusters.arcs(event_days(spark, d), ["event_type"], "day", "n", 10.0, 75.0, 2)


@query("""WITH points AS (SELECT s_suppkey AS point, (s_suppkey * 17) % 41 + 0.5 AS x, (s_suppkey * 29) % 37 + 0.5 AS y FROM supplier), squares AS (SELECT n_nationkey AS polygon, (n_nationkey % 5) * 8.0 AS x0, (n_nationkey // 5) * 7.0 AS y0 FROM nation)
SELECT point, polygon FROM points, squares WHERE x > x0 AND x < x0 + 7 AND y > y0 AND y < y0 + 6 AND NOT (x > x0 + 2 AND x < x0 + 4 AND y > y0 + 2 AND y < y0 + 4)""")
def point_in_polygon(spark, d):
    points = t(spark, d, "supplier").selectExpr("s_suppkey as point", "(s_suppkey * 17) % 41 + 0.5d as x", "(s_suppkey * 29) % 37 + 0.5d as y")
    x, y = (F.col("n_nationkey") % 5) * 8.0, F.floor(F.col("n_nationkey") / 5) * 7.0
    ring = lambda a, b, c, e: F.array(*(F.struct((x + i).cast("double").alias("x"), (y + j).cast("double").alias("y")) for i, j in ((a, b), (c, b), (c, e), (a, e))))
    polygons = t(spark, d, "nation").select(F.col("n_nationkey").alias("polygon"), F.array(ring(0, 0, 7, 6), ring(2, 2, 4, 4)).alias("rings"))
    return clusters.points_in_polygons(points, polygons)


@query(f"""WITH {DAILY} SELECT region, year(day) AS year, max_by(day, (value, -(day - DATE '1970-01-01'))) AS peak, round(avg(value) + 1e-6, 2) AS mean FROM daily GROUP BY 1, 2""")
def peak_and_mean(spark, d):
    order = F.struct("value", -series.day_number("day"))
    return daily(spark, d).groupBy("region", F.year("day").cast("long").alias("year")).agg(F.max_by("day", order).alias("peak"), F.round(F.avg("value") + 1e-6, 2).alias("mean"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda q: CAST(q AS DOUBLE) * q)))) AS v FROM embeddings), h AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT query_id, id, 'vector' AS via FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents), qt AS (SELECT vec_id AS query_id, term FROM embeddings JOIN w ON doc_id = vec_id WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY term) <= 5),
c AS (SELECT query_id, doc_id AS id, count(*) AS shared FROM qt JOIN w USING (term) WHERE doc_id <> query_id GROUP BY 1, 2), kw AS (SELECT query_id, id, 'keyword' AS via FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) <= 5),
f AS (SELECT source, doc_id AS id FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5), fa AS (SELECT vec_id AS query_id, id, 'facts' AS via FROM embeddings JOIN documents ON doc_id = vec_id JOIN f USING (source) WHERE vec_id % 20 = 0)
SELECT via, query_id, count(*) AS hits, min(id) AS first FROM (SELECT * FROM k UNION ALL SELECT * FROM kw UNION ALL SELECT * FROM fa) GROUP BY 1, 2""")
def hybrid_search(spark, d):
    e, docs = t(spark, d, "embeddings"), t(spark, d, "documents")
    q = e.where("vec_id % 20 = 0")
    near = vectors.search(e, q, 5).select("query_id", "id", F.lit("vector").alias("via"))
    # A query's terms are the first five long words of its own document; those that share most with it are found in one pass over the texts.
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("words")
    ids = q.select(F.col("vec_id").alias("query_id"))
    texts, own = docs.select(F.col("doc_id").alias("id"), words), docs.join(ids, F.col("doc_id") == F.col("query_id")).select(F.col("query_id").alias("id"), words)
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows of one id are one document
        texts, own = (x.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")) for x in (texts, own))
    archive.shared_folder(spark)
    terms = own.select(F.col("id").alias("query_id"), F.explode(F.slice(F.sort_array("words"), 1, 5)).alias("term")).checkpoint()
    keyword = vectors.sharing_terms(texts, terms, 5).select("query_id", "id", F.lit("keyword").alias("via"))
    # Facts: the first five well-judged documents of the query's own source, picked once a source.
    good = docs.join(t(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id").select("source", F.col("doc_id").alias("id"))
    good = good.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("k <= 5")
    facts = docs.join(ids, F.col("doc_id") == F.col("query_id")).select("query_id", "source").join(good, "source").select("query_id", "id", F.lit("facts").alias("via"))
    return near.unionByName(keyword).unionByName(facts).groupBy("via", "query_id").agg(F.count("*").alias("hits"), F.min("id").alias("first"))


@query("""WITH r AS (SELECT p_partkey AS rule, CASE p_partkey % 3 WHEN 0 THEN 'sunrise' WHEN 1 THEN 'sunset' ELSE 'noon' END AS anchor, (p_size - 25) * 2 AS minutes FROM part), a AS (SELECT * FROM (VALUES ('sunrise', 372), ('sunset', 1124)) v(anchor, moment))
SELECT rule, moment + minutes AS minute_of_day, CASE WHEN moment IS NULL THEN 'refused' ELSE 'ok' END AS status FROM r LEFT JOIN a USING (anchor)""")
def anchored_intervals(spark, d):
    k = F.col("p_partkey") % 3
    r = t(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.when(k == 0, "sunrise").when(k == 1, "sunset").otherwise("noon").alias("anchor"), ((F.col("p_size") - 25) * 2).alias("minutes"))
    a = spark.createDataFrame([("sunrise", 372), ("sunset", 1124)], "anchor string, moment int")
    j = r.join(F.broadcast(a), "anchor", "left")
    return j.select("rule", (F.col("moment") + F.col("minutes")).alias("minute_of_day"), F.when(F.col("moment").isNull(), "refused").otherwise("ok").alias("status"))


@query("""SELECT event_id, CASE WHEN value BETWEEN 0 AND 99.5 THEN floor(value / 5 + 0.5) * 5 END AS step, CASE WHEN value BETWEEN 0 AND 99.5 THEN 'ok' ELSE 'refused' END AS status FROM events""")
def nearest_step(spark, d):
    ok = F.coalesce(F.col("value").between(0, 99.5), F.lit(False))
    return t(spark, d, "events").select("event_id", F.when(ok, F.floor(F.col("value") / 5 + 0.5) * 5).cast("double").alias("step"), F.when(ok, "ok").otherwise("refused").alias("status"))


@query("""SELECT user_id, CASE WHEN count(*) >= 1000 THEN 4 WHEN count(*) >= 100 THEN 3 WHEN count(*) >= 10 THEN 2 ELSE 1 END AS level, CASE WHEN max(value) >= 99 THEN 'X' WHEN max(value) >= 90 THEN 'M' WHEN max(value) >= 50 THEN 'C' ELSE 'B' END AS flux FROM events GROUP BY 1""")
def activity_levels(spark, d):
    n, v = F.count("*"), F.max("value")
    return t(spark, d, "events").groupBy("user_id").agg(num.ladder([(n >= 1000, 4), (n >= 100, 3), (n >= 10, 2)], 1).alias("level"), num.ladder([(v >= 99, "X"), (v >= 90, "M"), (v >= 50, "C")], "B").alias("flux"))


@query("""WITH x AS (SELECT c_nationkey AS region, count(*) AS out, sum(c_acctbal) AS total FROM customer GROUP BY 1), t AS (SELECT region FROM x ORDER BY out DESC, region LIMIT 10)
SELECT region, out, CASE WHEN out >= 70 THEN 'major' WHEN out >= 60 THEN 'severe' ELSE 'minor' END AS severity, CASE WHEN region IN (SELECT region FROM t) THEN round(total, 2) END AS detail FROM x""")
def outage_ladder(spark, d):
    x = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.count("*").alias("out"), F.sum("c_acctbal").alias("total"))
    top = x.orderBy(F.desc("out"), "region").limit(10).select("region", F.lit(True).alias("top"))
    sev = num.ladder([(F.col("out") >= 70, "major"), (F.col("out") >= 60, "severe")], "minor")
    return x.join(top, "region", "left").select("region", "out", sev.alias("severity"), F.when(F.col("top"), F.round("total", 2)).alias("detail"))


@query(f"""WITH {EVENT_DAYS} SELECT event_type, day, n, CASE WHEN users < 30 AND n < 50 THEN 'bare' WHEN users < 40 THEN 'patchy' WHEN n > 70 THEN 'deep' ELSE 'covered' END AS class FROM event_days""")
def two_way_class(spark, d):
    u, n = F.col("users"), F.col("n")
    return event_days(spark, d).select("event_type", "day", "n", num.ladder([((u < 30) & (n < 50), "bare"), (u < 40, "patchy"), (n > 70, "deep")], "covered").alias("class"))


@query("""SELECT event_type, round(avg(v), 6) AS mean, max(v) AS high, count(v) AS present FROM (SELECT event_type, unnest([value, CASE WHEN value > 50 THEN NULL ELSE value * 2 END]) AS v FROM events) GROUP BY 1""")
def hourly_arrays(spark, d):
    arr = F.array("value", F.when(F.col("value") > 50, F.lit(None)).otherwise(F.col("value") * 2))
    return t(spark, d, "events").select("event_type", F.explode(arr).alias("v")).groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("high"), F.count("v").alias("present"))


@query(f"""WITH {DAILY} SELECT region, day, round(value, 1) AS value FROM daily WHERE value IS NOT NULL""")
def codec_round_trip(spark, d):
    x = daily(spark, d).select("region", "day", F.round("value", 1).alias("value"))
    # Values are too large for one int16, so the codec carries them as millions, thousands and tenths apart.
    whole = F.floor(F.col("value") / 1000)
    part = lambda name, v: F.struct(F.lit(name).alias("part"), v.cast("double").alias("v"))
    split = F.array(part("m", F.floor(whole / 1000)), part("k", whole % 1000), part("r", F.round(F.col("value") - whole * 1000, 1)))
    parts = x.select("region", F.explode(split).alias("p"), "day").select("region", "p.part", "day", "p.v")
    back = archive.decode_series(archive.encode_series(parts, ["region", "part"], "day", "v"), ["region", "part"], "day", "v")
    return back.groupBy("region", "day").agg(F.round(F.sum(F.when(F.col("part") == "m", F.col("v") * 1_000_000).when(F.col("part") == "k", F.col("v") * 1000).otherwise(F.col("v"))), 1).alias("value"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS questions, max(length(text)) AS longest FROM conversations GROUP BY 1""")
def conversation_counts(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("questions"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g'))) AS text_length FROM pages""")
def page_text(spark, d):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \n\t\r]+", " "))
    return t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(text).cast("long").alias("text_length"))
