"""Scans, predicates, joins, aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import joins, ranks
from .common import DAILY, EVENT_DAYS, daily, event_days, query, t

# --- scans


@query("""SELECT event_id, event_type, user_id FROM events
WHERE event_type IN ('click', 'error') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND user_id = 7""")
def scan_filtered(spark, d):
    e = t(spark, d, "events")
    return e.where(e.event_type.isin("click", "error") & (e.ts >= "2024-01-05") & (e.ts < F.lit("2024-01-10").cast("timestamp")) & (e.user_id == 7)).select("event_id", "event_type", "user_id")


@query(f"""WITH {DAILY} SELECT region, day, value FROM daily WHERE strftime(day, '%m-%d') = '03-14'""")
def scan_same_month_day(spark, d):
    return daily(spark, d).where(F.date_format("day", "MM-dd") == "03-14").select("region", "day", "value")


@query(f"""WITH {DAILY}, dates AS (SELECT y, make_date(CAST(y AS INTEGER), 6, 15) + CAST(k AS INTEGER) AS day, k FROM range(1995, 2002) r(y), range(-3, 11) s(k))
SELECT region, y AS year, CAST(k AS INTEGER) AS shift, daily.day, value FROM daily JOIN dates ON daily.day = dates.day""")
def scan_doy_window(spark, d):
    years = spark.range(1995, 2002).select(F.col("id").alias("year"))
    dates = years.withColumn("shift", F.explode(F.sequence(F.lit(-3), F.lit(10)))).withColumn("day", F.expr("date_add(make_date(year, 6, 15), shift)"))
    return daily(spark, d).join(F.broadcast(dates), "day").select("region", "year", "shift", "day", "value")


@query("""SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE value IS NULL) AS missing FROM events GROUP BY event_type""")
def scan_exact_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("""SELECT o_orderpriority AS priority, min(year(o_orderdate)) AS first_year FROM orders GROUP BY 1""")
def scan_earliest_year(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.min(F.year("o_orderdate")).cast("long").alias("first_year"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 20 AND 30 AND value >= 50""")
def scan_json_box(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").where(k.between(20, 30) & (F.col("value") >= 50)).select("event_id", k.alias("k"))


@query("""SELECT r_name AS name, md5(concat_ws('|', CAST(r_regionkey AS VARCHAR), r_name)) AS digest FROM region""")
def restore_row_digests(spark, d):
    return t(spark, d, "region").select(F.col("r_name").alias("name"), F.md5(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name")).alias("digest"))


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority LIKE '5%' AS superseded FROM orders""")
def mark_superseded(spark, d):
    old = (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")) & F.col("o_orderpriority").startswith("5")
    return t(spark, d, "orders").select("o_orderkey", "o_orderpriority", old.alias("superseded"))


@query("""WITH n AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, c_mktsegment, 'kept' AS origin FROM o UNION ALL SELECT c_custkey, c_mktsegment, 'inserted' FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)""")
def upsert_ignore_duplicates(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    held, new = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0")
    return held.withColumn("origin", F.lit("kept")).unionByName(new.join(held, "c_custkey", "left_anti").withColumn("origin", F.lit("inserted")))


# --- predicates and projections


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity, l_quantity NOT BETWEEN 5 AND 45 AS dropped FROM lineitem""")
def sanitise_plausible(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", num.reading(q, 5, 45).alias("quantity"), (~q.between(5, 45)).alias("dropped"))


@query("""SELECT doc_id, regexp_extract(text, '([0-9]+(?:[.][0-9]+)+)', 1) AS number, regexp_extract(text, 'Version ([0-9.]+[0-9])', 1) AS version FROM documents""")
def extract_from_prose(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_extract("text", r"([0-9]+(?:[.][0-9]+)+)", 1).alias("number"), F.regexp_extract("text", r"Version ([0-9.]+[0-9])", 1).alias("version"))


@query("""SELECT p_partkey, s, CASE upper(right(s, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END * CAST(regexp_extract(s, '^([0-9]+)', 1) AS DOUBLE) AS amount
FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'b' ELSE '' END AS s FROM part)""")
def parse_magnitudes(spark, d):
    k = F.col("p_partkey") % 4
    s = F.concat(F.col("p_size").cast("string"), F.when(k == 0, "K").when(k == 1, "M").when(k == 2, "b").otherwise(""))
    return t(spark, d, "part").select("p_partkey", s.alias("s"), num.magnitude(s).alias("amount"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'medium' WHEN c_acctbal >= 0 THEN 'low' ELSE 'debt' END AS band FROM customer""")
def threshold_ladder(spark, d):
    b = F.col("c_acctbal")
    return t(spark, d, "customer").select("c_custkey", num.ladder([(b >= 7500, "high"), (b >= 2500, "medium"), (b >= 0, "low")], "debt").alias("band"))


@query("""SELECT event_type, coalesce(m.kind, 'INTERNAL') AS kind, count(*) AS n FROM events
LEFT JOIN (VALUES ('click', 'EXTERNAL'), ('view', 'EXTERNAL'), ('purchase', 'BRIDGE')) m(event_type, kind) USING (event_type) GROUP BY 1, 2""")
def classify_content_types(spark, d):
    kinds = spark.createDataFrame([("click", "EXTERNAL"), ("view", "EXTERNAL"), ("purchase", "BRIDGE")], "event_type string, kind string")
    return t(spark, d, "events").join(F.broadcast(kinds), "event_type", "left").groupBy("event_type", F.coalesce("kind", F.lit("INTERNAL")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'the mit license') OR contains(lower(text), 'cc by')""")
def text_any(spark, d):
    text = F.lower("text")
    return t(spark, d, "documents").where(text.contains("the mit license") | text.contains("cc by")).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\'""")
def ilike_escaped(spark, d):
    return t(spark, d, "documents").where(num.escaped_like(F.col("text"), "%%%")).select("doc_id")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50, false) AS fires, false AS unknown_op FROM events""")
def dot_path_compare(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return t(spark, d, "events").select("event_id", k.alias("k"), num.compare(k, "gte", 50).alias("fires"), num.compare(k, "about", 50).alias("unknown_op"))


@query("""SELECT doc_id, state FROM documents, (VALUES ('apache', 'Apache'), ('gnu', 'GPL'), ('mit license', 'MIT'), ('creative commons', 'CC'), ('cc by', 'CC')) s(word, state)
WHERE contains(lower(text), word) GROUP BY ALL""")
def extract_keywords(spark, d):
    words = (("apache", "Apache"), ("gnu", "GPL"), ("mit license", "MIT"), ("creative commons", "CC"), ("cc by", "CC"))
    text = F.lower("text")
    found = F.array_distinct(F.array_compact(F.array(*(F.when(text.contains(w), F.lit(name)) for w, name in words))))
    return t(spark, d, "documents").select("doc_id", F.explode(found).alias("state"))


# --- joins


@query("""SELECT a.o_orderkey, a.o_custkey, b.c_mktsegment AS segment, c.n_name AS nation FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey JOIN nation c ON b.c_nationkey = c.n_nationkey
WHERE a.o_orderdate >= TIMESTAMP '2001-06-01' ORDER BY a.o_orderdate DESC, a.o_orderkey LIMIT 50""")
def double_lookup(spark, d):
    o, c, n = (t(spark, d, x) for x in ("orders", "customer", "nation"))
    rows = o.where(o.o_orderdate >= F.lit("2001-06-01").cast("timestamp")).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


@query(f"""WITH {EVENT_DAYS} SELECT a.event_type, a.day, a.n, coalesce(b.n, 0) AS yesterday, a.n - coalesce(b.n, 0) AS change
FROM event_days a LEFT JOIN event_days b ON a.event_type = b.event_type AND b.day = a.day - 1""")
def join_with_default(spark, d):
    e = event_days(spark, d).select("event_type", "day", "n")
    y = e.select("event_type", F.date_add("day", 1).alias("day"), F.col("n").alias("y"))
    return e.join(y, ["event_type", "day"], "left").select("event_type", "day", "n", F.coalesce("y", F.lit(0)).alias("yesterday"), (F.col("n") - F.coalesce("y", F.lit(0))).alias("change"))


_EVENTS = """a AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS other_id, user_id, CAST(ts AS DATE) AS other_day, value FROM events WHERE event_type = 'error')"""


def _purchases_and_errors(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "day"), e.where("event_type = 'error'").select(F.col("event_id").alias("other_id"), "user_id", F.col("day").alias("other_day"), "value")


@query(f"WITH {_EVENTS} SELECT a.event_id, other_id FROM a JOIN b ON a.user_id = b.user_id AND abs(b.other_day - a.day) <= 3")
def interval_join(spark, d):
    a, b = _purchases_and_errors(spark, d)
    return joins.interval_join(a, b, ["user_id"], "day", "other_day", -3, 3).select("event_id", "other_id")


@query(f"WITH {_EVENTS} SELECT a.event_id, count(other_id) AS n FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.other_day - a.day BETWEEN 1 AND 2 GROUP BY 1")
def interval_left_join(spark, d):
    a, b = _purchases_and_errors(spark, d)
    return joins.interval_join(a, b, ["user_id"], "day", "other_day", 1, 2, "left").groupBy("event_id").agg(F.count("other_id").alias("n"))


@query(f"""WITH {_EVENTS}, r AS (SELECT a.event_id, other_id, value, row_number() OVER (PARTITION BY a.event_id ORDER BY value DESC NULLS LAST, other_id) AS k
FROM a JOIN b ON a.user_id = b.user_id AND b.other_day - a.day BETWEEN 1 AND 5)
SELECT a.event_id, r.other_id, r.value FROM a LEFT JOIN r ON a.event_id = r.event_id AND k = 1""")
def what_followed(spark, d):
    a, b = _purchases_and_errors(spark, d)
    return joins.followed(a, b, ["user_id"], "day", "other_day", 5, [F.desc_nulls_last("value"), F.col("other_id")], ["event_id"]).select("event_id", "other_id", "value")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts AS seen, value FROM events WHERE event_type = 'view')
SELECT event_id, b.seen, b.value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.seen""")
def as_of_join(spark, d):
    e = t(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return joins.as_of(a, b, ["user_id"], "ts", "seen", ["value"]).select("event_id", "seen", "value")


@query("""SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, d):
    return joins.latest(t(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts")


@query(f"""WITH {EVENT_DAYS}, k AS (SELECT DISTINCT event_type FROM event_days), x AS (SELECT * FROM event_days WHERE day = DATE '2024-01-10' AND n % 2 = 0),
y AS (SELECT * FROM event_days WHERE day = DATE '2024-01-09' AND n % 3 <> 0), z AS (SELECT event_type, max(n) AS n FROM event_days GROUP BY 1)
SELECT k.event_type, coalesce(x.n, y.n, z.n) AS n, CASE WHEN x.n IS NOT NULL THEN 'live' WHEN y.n IS NOT NULL THEN 'yesterday' WHEN z.n IS NOT NULL THEN 'archive' END AS source
FROM k LEFT JOIN x USING (event_type) LEFT JOIN y USING (event_type) LEFT JOIN z USING (event_type)""")
def fallback_chain(spark, d):
    e = event_days(spark, d)
    live, before = e.where("day = date'2024-01-10' and n % 2 = 0"), e.where("day = date'2024-01-09' and n % 3 <> 0")
    return joins.first_of(e.select("event_type").distinct(), ["event_type"], [("live", live), ("yesterday", before), ("archive", e.groupBy("event_type").agg(F.max("n").alias("n")))], "n")


@query("""SELECT c_custkey, tag FROM (SELECT c_custkey, unnest(string_split(c_mktsegment || ',' || CAST(c_nationkey AS VARCHAR), ',')) AS tag FROM customer)""")
def unnest_arrays(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.explode(F.split(F.concat_ws(",", "c_mktsegment", F.col("c_nationkey").cast("string")), ",")).alias("tag"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_join(spark, d):
    o = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_join(spark, d):
    o = t(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


_PLACES = """places AS (SELECT n_nationkey AS place, (n_nationkey * 37) % 120 - 60.0 AS plat, (n_nationkey * 53) % 340 - 170.0 AS plon FROM nation),
points AS (SELECT s_suppkey AS point, (s_suppkey * 17) % 130 - 65.0 AS lat, (s_suppkey * 29) % 350 - 175.0 AS lon FROM supplier)"""


@query(f"""WITH {_PLACES}, x AS (SELECT point, place, 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS km FROM points, places)
SELECT point, place, round(km, 3) AS km FROM x QUALIFY row_number() OVER (PARTITION BY point ORDER BY round(km, 6), place) = 1""")
def nearest_place(spark, d):
    places = t(spark, d, "nation").selectExpr("n_nationkey as place", "(n_nationkey * 37) % 120 - 60.0d as plat", "(n_nationkey * 53) % 340 - 170.0d as plon")
    points = t(spark, d, "supplier").selectExpr("s_suppkey as point", "(s_suppkey * 17) % 130 - 65.0d as lat", "(s_suppkey * 29) % 350 - 175.0d as lon")
    km = F.round(num.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 6)
    return joins.nearest(points, places, km, ["point"], ["place"]).select("point", "place", F.round("distance", 3).alias("km"))


@query("""SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 2.2 FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def correlated_subquery(spark, d):
    o = t(spark, d, "orders").withColumn("m", F.avg("o_totalprice").over(Window.partitionBy("o_custkey")))
    return o.where(F.col("o_totalprice") > F.col("m") * 2.2).select("o_orderkey", "o_totalprice")


@query("""WITH e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT (n_nationkey + 1) % 25, n_nationkey FROM nation UNION ALL SELECT n_nationkey, n_nationkey FROM nation),
c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT CAST(a AS INTEGER) AS nation, CAST(sum(n) AS BIGINT) AS nearby FROM e JOIN c ON c_nationkey = b GROUP BY 1""")
def adjacency_join(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    edges = n.union(n.select("b", "a")).union(n.selectExpr("a", "a as b"))
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    return edges.join(c, "b").groupBy(F.col("a").alias("nation")).agg(F.sum("n").alias("nearby"))


# --- aggregations


@query("SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def group_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest")).orderBy(F.desc("n"), "event_type")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS big
FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def daily_growth_filtered(spark, d):
    e, v = F.col("event_type"), F.col("value")
    return t(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(e == "error").alias("errors"), F.count_if(v > 50).alias("high"), F.count_if((e == "purchase") & (v > 50)).alias("big"))


@query("""WITH x AS (SELECT l_returnflag AS source, l_linestatus AS state, w AS window_days, CASE WHEN l_discount >= 0.07 THEN 'confirmed' WHEN l_discount >= 0.05 THEN 'partial' WHEN l_discount >= 0.02 THEN 'missed' ELSE 'false_alarm' END AS outcome
FROM lineitem, (VALUES (30), (90), (365)) v(w) WHERE l_shipdate >= TIMESTAMP '2001-11-05' - to_days(CAST(w AS INTEGER)))
SELECT source, window_days, state, count(*) AS total, coalesce(round(100.0 * count(*) FILTER (WHERE outcome IN ('confirmed', 'partial')) / count(*), 2), 0) AS accuracy,
coalesce(round(100.0 * count(*) FILTER (WHERE outcome = 'confirmed') / nullif(count(*) FILTER (WHERE outcome IN ('confirmed', 'false_alarm')), 0), 2), 0) AS precision
FROM x GROUP BY GROUPING SETS ((source, window_days, state), (source, window_days))""")
def calibration_rollup(spark, d):
    windows = spark.createDataFrame([(30,), (90,), (365,)], "window_days int")
    x = t(spark, d, "lineitem").join(F.broadcast(windows), F.expr("l_shipdate >= timestamp'2001-11-05' - make_interval(0, 0, 0, window_days)"))
    outcome = num.ladder([(F.col("l_discount") >= 0.07, "confirmed"), (F.col("l_discount") >= 0.05, "partial"), (F.col("l_discount") >= 0.02, "missed")], "false_alarm")
    x = x.select(F.col("l_returnflag").alias("source"), "window_days", F.col("l_linestatus").alias("state"), outcome.alias("outcome"))
    o = F.col("outcome")
    decided = F.count_if(o.isin("confirmed", "false_alarm"))
    pct = lambda a, b: F.coalesce(F.round(F.when(b > 0, 100.0 * a / b), 2), F.lit(0.0))
    g = x.groupingSets([["source", "window_days", "state"], ["source", "window_days"]], "source", "window_days", "state")
    return g.agg(F.count("*").alias("total"), pct(F.count_if(o.isin("confirmed", "partial")), F.count("*")).alias("accuracy"), pct(F.count_if(o == "confirmed"), decided).alias("precision"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS low, max(value) AS high, max_by(value, event_id) AS last_value, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1, 2""")
def keep_extremes_daily(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "event_id").alias("last_value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value) + 1e-9, 6) AS mean, max(value) AS high, max_by(user_id, (value, -event_id)) AS high_user, min(value) AS low, count(DISTINCT user_id) AS stations, round(max(value) - min(value), 6) AS spread
FROM events WHERE value BETWEEN 0 AND 95 GROUP BY 1, 2""")
def station_rollup(spark, d):
    e = t(spark, d, "events").where(F.col("value").between(0, 95))
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") + 1e-9, 6).alias("mean"), F.max("value").alias("high"), F.max_by("user_id", F.struct("value", -F.col("event_id"))).alias("high_user"), F.min("value").alias("low"), F.countDistinct("user_id").alias("stations"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query(f"""WITH {DAILY}, w AS (SELECT region, weekofyear(day) AS week, isoyear(day) AS y, value, CASE WHEN isoyear(day) = 2000 THEN 2.0 WHEN isoyear(day) = 1999 THEN 1.5 ELSE 1.0 END AS weight FROM daily WHERE isoyear(day) < 2001)
SELECT region, week, round(sum(value * weight) / sum(weight) + 1e-6, 4) AS baseline, count(*) AS points FROM w GROUP BY 1, 2 HAVING count(*) >= 3""")
def weighted_week_baseline(spark, d):
    year = F.expr("extract(YEAROFWEEK FROM day)")
    w = daily(spark, d).withColumn("y", year).where("y < 2001").withColumn("weight", F.when(F.col("y") == 2000, 2.0).when(F.col("y") == 1999, 1.5).otherwise(1.0))
    out = w.groupBy("region", F.weekofyear("day").cast("long").alias("week")).agg(F.round(F.sum(F.col("value") * F.col("weight")) / F.sum("weight") + 1e-6, 4).alias("baseline"), F.count("*").alias("points"))
    return out.where("points >= 3")


@query("""WITH r AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT greatest(y - y % 3, 1995) AS bar, sum(n) AS n, count(*) AS years, max(y) AS last FROM r GROUP BY 1)
SELECT bar, CAST(n AS BIGINT) AS n, years, round(n / years, 4) AS per_year, years < 3 AS partial FROM b""")
def bars_per_year(spark, d):
    r = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    bar = F.greatest(F.col("y") - F.col("y") % 3, F.lit(1995))
    return r.groupBy(bar.alias("bar")).agg(F.sum("n").alias("n"), F.count("*").alias("years")).select("bar", "n", "years", F.round(F.col("n") / F.col("years"), 4).alias("per_year"), (F.col("years") < 3).alias("partial"))


@query("""SELECT c_nationkey AS nation, max_by(c_custkey, (c_acctbal, -c_custkey)) AS worst, round(sum(c_acctbal * 100 + c_custkey / 1e6), 2) AS score FROM customer GROUP BY 1""")
def severity_argmax(spark, d):
    return t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("worst"), F.round(F.sum(F.col("c_acctbal") * 100 + F.col("c_custkey") / 1e6), 2).alias("score"))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id, count(*) AS signals FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT day, event_type, count(*) AS entities, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) = 3 THEN 'medium' ELSE 'low' END AS level FROM a GROUP BY 1, 2 HAVING count(*) >= 2""")
def multi_entity_activity(spark, d):
    a = t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.count("*").alias("signals")).where("signals >= 2")
    out = a.groupBy("day", "event_type").agg(F.count("*").alias("entities")).where("entities >= 2")
    return out.withColumn("level", num.ladder([(F.col("entities") >= 4, "high"), (F.col("entities") == 3, "medium")], "low"))


@query(f"""WITH {EVENT_DAYS}, x AS (SELECT day, floor(least(1000, greatest(0, avg(users) * 10 + count(*) * 5 + count(*) FILTER (WHERE n > 50) * 10)) + 0.5) AS score FROM event_days GROUP BY 1)
SELECT day, score, round(100 * (score - lag(score) OVER (ORDER BY day)) / lag(score) OVER (ORDER BY day), 3) AS change FROM x""")
def composite_index(spark, d):
    raw = F.avg("users") * 10 + F.count("*") * 5 + F.count_if(F.col("n") > 50) * 10
    x = event_days(spark, d).groupBy("day").agg(F.floor(num.clamp(raw, 0.0, 1000.0) + 0.5).cast("double").alias("score"))
    before = F.lag("score").over(Window.orderBy("day"))  # one row a day: a small, bounded series
    return x.select("day", "score", F.round(100 * (F.col("score") - before) / before, 3).alias("change"))


@query("""SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(DISTINCT substr(n_name, 1, 1)) AS initials FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def ordered_documents(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.countDistinct(F.substring("n_name", 1, 1)).alias("initials"))


# --- rankings


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark, d):
    return _ranked(t(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderpriority", "o_orderkey", "o_totalprice")


def _ranked(df, key, order, k):
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


@query(f"WITH {DAILY} SELECT region, day, value FROM daily ORDER BY abs(value - 250000.0), day, region LIMIT 20")
def closest_values(spark, d):
    return daily(spark, d).orderBy(F.abs(F.col("value") - 250000.0), "day", "region").limit(20).select("region", "day", "value")


@query("""SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_type, event_id) AS place FROM events ORDER BY place LIMIT 100""")
def multi_key_order(spark, d):
    top = t(spark, d, "events").orderBy(F.desc_nulls_last("value"), "event_type", "event_id").limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("value"), "event_type", "event_id")).alias("place"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id FROM r WHERE (k - 1) % CAST(ceil(n / 40.0) AS BIGINT) = 0""")
def systematic_sample(spark, d):
    r = ranks.numbered(t(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], "k", "n")
    return r.where((F.col("k") - 1) % F.ceil(F.col("n") / 40.0) == 0).select("event_type", "event_id")


@query("""SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY (p_partkey * 7919) % 1009, p_partkey) = 1""")
def diverse_pick(spark, d):
    return _ranked(t(spark, d, "part"), ["p_type"], [(F.col("p_partkey") * 7919) % 1009, F.col("p_partkey")], 1).select("p_type", "p_partkey", "p_retailprice")


@query("""WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1), x AS (SELECT c_nationkey AS nation, day, count(*) AS same_day, min(c_custkey) AS first FROM f JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT nation, day, same_day, first FROM x QUALIFY row_number() OVER (PARTITION BY nation ORDER BY day) = 1""")
def earliest_openers(spark, d):
    f = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("day"))
    x = f.join(t(spark, d, "customer"), "c_custkey").groupBy(F.col("c_nationkey").alias("nation"), "day").agg(F.count("*").alias("same_day"), F.min("c_custkey").alias("first"))
    return _ranked(x, ["nation"], [F.col("day")], 1).select("nation", "day", "same_day", "first")


# --- sets


@query("""SELECT 'document' AS kind, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages UNION ALL SELECT 'turn', conv_id, length(text) FROM conversations""")
def union_of_scans(spark, d):
    return t(spark, d, "documents").selectExpr("'document' as kind", "doc_id as id", "cast(length(text) as long) as size").unionByName(t(spark, d, "pages").selectExpr("'page' as kind", "page_id as id", "cast(length(html) as long) as size")).unionByName(t(spark, d, "conversations").selectExpr("'turn' as kind", "conv_id as id", "cast(length(text) as long) as size"))


@query(f"""WITH {EVENT_DAYS} SELECT day FROM event_days WHERE event_type = 'click' AND n >= 5 INTERSECT SELECT day FROM event_days WHERE event_type = 'error' AND n >= 5 INTERSECT SELECT day FROM event_days WHERE event_type = 'view' AND mean_value < 60""")
def intersect_conditions(spark, d):
    e, n = event_days(spark, d), F.col("n")
    k = F.col("event_type")
    hit = F.when((k == "click") & (n >= 5), 1).when((k == "error") & (n >= 5), 2).when((k == "view") & (F.col("mean_value") < 60), 3)
    return e.groupBy("day").agg(F.countDistinct(hit).alias("c")).where("c = 3").select("day")


@query("""SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90""")
def set_difference(spark, d):
    e = t(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").exceptAll(e.where("event_type = 'error' and value > 90").select("user_id")).distinct().join(e.where("event_type = 'error' and value > 90").select("user_id").distinct(), "user_id", "left_anti")


@query("""SELECT key, doc_id, length(text) AS size FROM (SELECT lower(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z]+', ' ', 'g')) AS key, doc_id, text FROM documents)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, doc_id) = 1""")
def dedupe_keep_longest(spark, d):
    key = F.lower(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[^A-Za-z]+", " "))  # a document's title is its first line
    x = t(spark, d, "documents").select(key.alias("key"), "doc_id", F.length("text").cast("long").alias("size"))
    return joins.latest(x, ["key"], [F.desc("size"), F.col("doc_id")])


@query("""WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id FROM k WHERE event_type <> 'error'""")
def freshest_then_filter(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return joins.latest(e, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).where("event_type <> 'error'").select("user_id", "event_id")


@query("""SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def dedupe_first_wins(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
