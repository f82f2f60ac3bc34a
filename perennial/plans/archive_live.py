"""Live frames, layouts, alerts of users, precedent days, links on write, false discovery and same-system merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import clusters, pools, vectors
from ..operators import statistics as st
from ..sources import archive
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t
from .timeseries import DOY, POOL


@query(f"""WITH {POOL}, d AS (SELECT DISTINCT region FROM daily), today AS (SELECT region, max(day) AS day FROM daily WHERE day <= DATE '2001-06-01' GROUP BY 1)
SELECT d.region, today.day, CAST(floor(floor(below / n * 1000 + 0.5) / 1000 * 254 + 0.5) AS INTEGER) AS byte, CASE WHEN today.day = DATE '2001-06-01' THEN 'live' WHEN today.day = DATE '2001-05-31' THEN 'yesterday' ELSE 'archive' END AS source
FROM d JOIN today ON d.region = today.region JOIN pool ON pool.region = d.region AND pool.day = today.day WHERE years >= 5""")
def live_frame(spark, d):
    x = daily(spark, d).drop("n")
    depth = pools.tail_depth(x, ["region"], "day", "value", "high", min_years=5).where("years >= 5")
    last = x.where("day <= date'2001-06-01'").groupBy("region").agg(F.max("day").alias("day"))
    label = F.when(F.col("day") == F.lit("2001-06-01").cast("date"), "live").when(F.col("day") == F.lit("2001-05-31").cast("date"), "yesterday").otherwise("archive")
    return depth.join(last, ["region", "day"]).select("region", "day", F.floor(F.col("pct") * 254 + 0.5).cast("int").alias("byte"), label.alias("source"))


@query("""WITH RECURSIVE s AS (SELECT string_agg(n_name || ':' || CAST(n_nationkey AS VARCHAR), '|' ORDER BY n_nationkey) AS m FROM nation),
h AS (SELECT 0 AS i, CAST(5381 AS BIGINT) AS v, m FROM s UNION ALL SELECT i + 1, xor((v * 33) % 4294967296, ascii(substr(m, i + 1, 1))), m FROM h WHERE i < length(m)) SELECT max_by(v, i) % 2147483647 AS version FROM h""")
def layout_version(spark, d):
    manifest = t(spark, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat(s["n_name"], F.lit(":"), s["n_nationkey"].cast("string"))), "|").alias("m"))
    step = lambda v, c: ((v * 33) % 4294967296).bitwiseXOR(F.ascii(c).cast("long"))
    return manifest.select((F.aggregate(F.split("m", ""), F.lit(5381).cast("long"), lambda v, c: F.when(c == "", v).otherwise(step(v, c))) % 2147483647).alias("version"))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'spike', 'click', 70.0), (2, 'event', 'error', 95.0), (3, 'threshold', 'view', 99.0), (4, 'new-data', 'signup', 0.0)) v(rule, kind, event_type, bound)),
e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS m FROM events GROUP BY 1, 2)
SELECT rule, day, kind FROM r JOIN e USING (event_type) WHERE CASE kind WHEN 'spike' THEN n >= bound WHEN 'event' THEN n >= 1 AND m >= bound WHEN 'threshold' THEN m >= bound ELSE n > 0 END""")
def user_alerts(spark, d):
    rules = spark.createDataFrame([(1, "spike", "click", 70.0), (2, "event", "error", 95.0), (3, "threshold", "view", 99.0), (4, "new-data", "signup", 0.0)], "rule int, kind string, event_type string, bound double")
    e = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("m"))
    k = F.col("kind")
    hit = F.when(k == "spike", F.col("n") >= F.col("bound")).when(k.isin("event", "threshold"), F.col("m") >= F.col("bound")).otherwise(F.col("n") > 0)
    return e.join(F.broadcast(rules), "event_type").where(hit).select("rule", "day", "kind")


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(z AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda q: CAST(q AS DOUBLE) * q)))) AS v FROM embeddings)"


@query(f"""WITH {_UNIT}, h AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM h), p AS (SELECT query_id, DATE '2024-01-01' + CAST(id % 60 AS INTEGER) AS day, least(1.0, max(s)) AS score, count(*) AS entries FROM k WHERE r <= 40 GROUP BY 1, 2)
SELECT query_id, day, round(score, 6) AS score, least(entries, 3) AS entries FROM p WHERE day <= DATE '2024-02-15' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, day) <= 5""")
def precedent_days(spark, d):
    e = t(spark, d, "embeddings")
    h = vectors.search(e, e.where("vec_id % 20 = 0"), 40).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")))
    p = h.groupBy("query_id", "day").agg(F.least(F.lit(1.0), F.max("similarity")).alias("score"), F.count("*").alias("entries")).where("day <= date'2024-02-15'")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "day"))
    return p.withColumn("k", k).where("k <= 5").select("query_id", "day", F.round("score", 6).alias("score"), F.least("entries", F.lit(3)).alias("entries"))


@query(f"""WITH {_UNIT}, p AS (SELECT a.vec_id AS source_id, b.vec_id AS matched_id, b.label, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0),
k AS (SELECT * FROM p WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY s DESC, matched_id) <= 5) SELECT source_id, count(*) AS links, count(DISTINCT label) >= 3 AS convergence FROM k GROUP BY 1""")
def links_on_write(spark, d):
    e = t(spark, d, "embeddings")
    new, old = e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0")
    h = vectors.search(old, new, 5).where("similarity >= 0.1").join(old.select(F.col("vec_id").alias("id"), "label"), "id")
    return h.groupBy(F.col("query_id").alias("source_id")).agg(F.count("*").alias("links"), (F.countDistinct("label") >= 3).alias("convergence"))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_orderpriority AS family, c_nationkey AS state, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS b, o_totalprice AS severity FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000),
e AS (SELECT x.id AS x, y.id AS y FROM s x JOIN s y ON x.family = y.family AND x.state = y.state AND x.a <= y.b AND y.a <= x.b), r AS (SELECT id AS x, id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS id, min(y) AS label FROM r GROUP BY 1)
SELECT label, count(*) AS members, max_by(c.id, (severity, -epoch(a), -c.id)) AS keeper FROM c JOIN s ON c.id = s.id GROUP BY 1""")
def same_system(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    day = F.to_date("o_orderdate")
    s = o.where("o_totalprice > 400000").join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.col("c_nationkey").alias("state"), day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).alias("b"), F.col("o_totalprice").alias("severity"))
    archive.shared_folder(spark)
    order = F.struct("severity", -F.datediff("a", F.lit("1970-01-01").cast("date")), -F.col("id"))
    return clusters.merged_spans(s, "id", ["family", "state"], "a", "b").groupBy("label").agg(F.count("*").alias("members"), F.max_by("id", order).alias("keeper"))


@query(f"""WITH {DAILY}, x AS (SELECT region, day, value, {DOY.format('day')} AS doy FROM daily), s AS (SELECT region, CAST(floor(doy / 30) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (WHERE value > 300000) AS hits FROM x GROUP BY 1, 2)
SELECT region, bin, n, hits, round(hits / n, 6) AS rate, rank() OVER (PARTITION BY region ORDER BY hits / n DESC) AS place FROM s""")
def season_profile(spark, d):
    from ..functions.calendars import doy_common

    s = daily(spark, d).groupBy("region", F.floor(doy_common(F.col("day")) / 30).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 300000).alias("hits"))
    rate = F.col("hits") / F.col("n")
    return s.select("region", "bin", "n", "hits", F.round(rate, 6).alias("rate"), F.rank().over(Window.partitionBy("region").orderBy(F.desc(rate))).alias("place"))


@query("""WITH w AS (SELECT doc_id, unnest(['licensed', 'warranty', 'stupid', 'password']) AS term, lower(text) AS t FROM documents) SELECT term, count(*) FILTER (WHERE contains(t, term)) AS documents FROM w GROUP BY 1""")
def query_signals(spark, d):
    terms = F.explode(F.array(*map(F.lit, ("licensed", "warranty", "stupid", "password"))))
    w = t(spark, d, "documents").select(terms.alias("term"), F.lower("text").alias("t"))
    return w.groupBy("term").agg(F.count_if(F.col("t").contains(F.col("term"))).alias("documents"))


@query(f"""WITH {EVENT_DAYS}, s AS (SELECT event_type, day, n, users FROM event_days) SELECT day, count(*) FILTER (WHERE n > 60) AS nonzero, string_agg(event_type, ',' ORDER BY n DESC, event_type) FILTER (WHERE r <= 3) AS top3 FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS r FROM s) GROUP BY 1""")
def station_top_three(spark, d):
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))), 1, 3)
    return event_days(spark, d).groupBy("day").agg(F.count_if(F.col("n") > 60).alias("nonzero"), F.array_join(F.transform(best, lambda x: x["event_type"]), ",").alias("top3"))


@query("""WITH s AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) FILTER (WHERE event_type = 'purchase') AS direct, count(*) FILTER (WHERE event_type = 'view') AS vector FROM events GROUP BY 1, 2)
SELECT user_id, week, CASE WHEN direct >= 5 OR vector >= 8 THEN 'confirmed' WHEN direct >= 2 THEN 'partial' ELSE 'missed' END AS grade FROM s""")
def signal_count_grade(spark, d):
    k = F.col("event_type")
    s = t(spark, d, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count_if(k == "purchase").alias("direct"), F.count_if(k == "view").alias("vector"))
    return s.select("user_id", "week", num.ladder([((F.col("direct") >= 5) | (F.col("vector") >= 8), "confirmed"), (F.col("direct") >= 2, "partial")], "missed").alias("grade"))
