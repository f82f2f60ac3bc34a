"""Fronts, motion, pool dictionaries, votes of an area's points, what followed alike days, and nulls from rotated years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames, joins, ranks, series
from ..operators import statistics as st
from ..sources import archive
from .common import DAILY, daily, query, t
from .timeseries import _FRAMES, _slots


@query(f"""WITH {DAILY}, r AS (SELECT region, day, count(*) OVER w AS readings, value - first_value(value) OVER w AS change, max(value) OVER w - value AS fall FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW))
SELECT region, day, readings, round(change, 2) AS change, round(fall, 2) AS drop_from_peak, CASE WHEN readings < 2 THEN 'unknown' WHEN fall >= 200000 THEN 'front' WHEN change <= -75000 THEN 'cooling' WHEN change >= 75000 THEN 'warming' ELSE 'steady' END AS signal FROM r""")
def front_signals(spark, d):
    s = series.front_signal(daily(spark, d), ["region"], "day", "value", 4, 200000.0, 75000.0)
    return s.select("region", "day", "readings", F.round("change", 2).alias("change"), F.round("drop_from_peak", 2).alias("drop_from_peak"), "signal")


@query(f"""WITH {DAILY}, a AS (SELECT region, day, value, CASE WHEN count(*) FILTER (WHERE value < 900000) OVER w >= 10 THEN avg(value) FILTER (WHERE value < 900000) OVER w END AS m FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
b AS (SELECT region, day, CASE WHEN value < 900000 THEN value - m END AS off FROM a), c AS (SELECT region, day, count(off) OVER w AS n, avg(off) OVER w AS motion FROM b WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT region, day, round(CASE WHEN n >= 10 THEN motion END + 1e-6, 2) AS motion FROM c""")
def motion_of_days(spark, d):
    m = series.motion(daily(spark, d), ["region"], "day", "value", F.col("value") < 900000, 14, 10)
    return m.select("region", "day", F.round(F.col("motion") + 1e-6, 2).alias("motion"))


@query(f"""WITH {DAILY}, p AS (SELECT region, CAST(month(day) AS INTEGER) AS month, day, value, CASE WHEN day - lag(day) OVER (PARTITION BY region, month(day) ORDER BY day) <= 3 THEN 0 ELSE 1 END AS fresh FROM daily)
SELECT region, month, string_agg(CAST(day AS VARCHAR), ',' ORDER BY value, day) AS days, array_to_string(list_sort(list(DISTINCT year(day))), ',') AS years, CAST(sum(fresh) AS BIGINT) AS episodes, max(day) FILTER (WHERE fresh = 1) AS last_occurrence FROM p GROUP BY 1, 2""")
def pool_dictionary(spark, d):
    pools = daily(spark, d).select("region", F.month("day").alias("month"), "day", "value")
    f = series.frequency_dictionary(pools, ["region", "month"], "day", "value", 2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return f.select("region", "month", text("days"), text("years"), "episodes", "last_occurrence")


@query("""WITH n AS (SELECT r_name AS region, n_nationkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN count(*) >= 2 THEN avg(o_totalprice) END AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)
SELECT region, day, round(avg(m) + 1e-7, 3) AS mean, round(avg(lo) FILTER (WHERE m IS NOT NULL) + 1e-7, 3) AS low, round(avg(hi) FILTER (WHERE m IS NOT NULL) + 1e-7, 3) AS high, count(m) AS points, round(CASE WHEN count(m) > 1 THEN max(m) - min(m) END + 1e-7, 3) AS spread FROM n GROUP BY 1, 2""")
def area_votes(spark, d):
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    price = F.col("o_totalprice")
    points = rows.groupBy(F.col("r_name").alias("region"), "n_nationkey", F.to_date("o_orderdate").alias("day")).agg(F.when(F.count("*") >= 2, F.avg(price)).alias("m"), F.min(price).alias("lo"), F.max(price).alias("hi"))
    v = series.voted_mean(points, ["region", "day"], "m", "lo", "hi")
    return v.select("region", "day", *(F.round(F.col(x) + 1e-7, 3).alias(x) for x in ("mean", "low", "high")), "points", F.round(F.col("spread") + 1e-7, 3).alias("spread"))


@query(f"""WITH {_FRAMES}, v AS (SELECT day, slot, sign(2 * byte / 254.0 - 1) * pow(abs(2 * byte / 254.0 - 1), 1.5) AS y FROM slots),
s AS (SELECT a.day AS target, b.day, sum(a.y * b.y) AS xy, sum(a.y * a.y) AS xx, sum(b.y * b.y) AS yy, count(*) AS overlap FROM v a JOIN v b ON a.slot = b.slot WHERE year(a.day) = 2000 AND month(a.day) = 5 AND abs(a.day - b.day) > 45 GROUP BY 1, 2 HAVING count(*) >= 30),
r AS (SELECT target, day, xy / sqrt(xx * yy) * least(sqrt(xx / yy), sqrt(yy / xx)) AS score FROM s WHERE xx > 0 AND yy > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, day) AS rank FROM r QUALIFY rank <= 3),
e AS (SELECT o_orderkey AS event, CAST(o_orderdate AS DATE) AS began, o_totalprice AS severity FROM orders WHERE o_totalprice > 400000),
f AS (SELECT k.target, k.day, k.rank, e.event, e.began, row_number() OVER (PARTITION BY k.target, k.day ORDER BY severity DESC, event) AS j FROM k JOIN e ON e.began - k.day BETWEEN 1 AND 7)
SELECT k.target, k.day, k.rank, f.event, CAST(f.began - k.day AS INTEGER) AS days_after FROM k LEFT JOIN f ON f.target = k.target AND f.day = k.day AND f.j = 1""")
def alike_days_followed(spark, d):
    s = _slots(spark, d)
    m = frames.match(s, s.where("year(day) = 2000 and month(day) = 5").select("day").distinct(), 30, 3, 45)
    e = t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("began"), F.col("o_totalprice").alias("severity"))
    f = joins.followed(m.select("target", "day", "rank"), e, [], "day", "began", 7, [F.desc("severity"), F.col("event")], ["target", "day"])
    return f.select("target", "day", "rank", "event", F.datediff("began", "day").alias("days_after"))


#: Share of days on which a region lies above EUROPE, its years turned by 0 (observed) to 6 places.
_ROTATED = f"""{DAILY}, y AS (SELECT region, min(year(day)) AS y0 FROM daily GROUP BY 1), k AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, 7)),
moved AS (SELECT region, k, value, make_date(CAST(y0 + (year(day) - y0 + k) % 7 AS INTEGER), CAST(month(day) AS INTEGER), CAST(CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END AS INTEGER)) AS day FROM daily JOIN y USING (region), k WHERE region <> 'EUROPE'),
shares AS (SELECT m.region, k, round(avg(CAST(m.value > e.value AS INTEGER)) + 1e-10, 9) AS value FROM moved m JOIN daily e ON e.region = 'EUROPE' AND e.day = m.day GROUP BY 1, 2)"""


def _rotated(spark, d) -> DataFrame:
    x = daily(spark, d)
    a = x.where("region <> 'EUROPE'").join(x.groupBy("region").agg(F.min(F.year("day")).alias("y0")), "region").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    year = F.col("y0") + F.pmod(F.year("day") - F.col("y0") + F.col("k"), F.lit(7))
    moved = F.make_date(year, F.month("day"), F.when((F.month("day") == 2) & (F.dayofmonth("day") == 29), 28).otherwise(F.dayofmonth("day")))
    a = a.select("region", "k", moved.alias("day"), F.col("value").alias("v"))
    share = F.round(F.avg((F.col("v") > F.col("value")).cast("int")) + 1e-10, 9)
    return a.join(x.where("region = 'EUROPE'").select("day", "value"), "day").groupBy("region", "k").agg(share.alias("value"))


@query(f"""WITH {_ROTATED}, o AS (SELECT region, value FROM shares WHERE k = 0)
SELECT region, o.value AS value, count(s.k) AS replicates, round((1 + count(*) FILTER (WHERE s.value >= o.value)) / (1 + count(s.k)), 9) AS p FROM o JOIN (SELECT region, k, value FROM shares WHERE k > 0) s USING (region) GROUP BY region, o.value""")
def empirical_p(spark, d):
    shares = _rotated(spark, d)
    p = st.empirical_p(shares.where("k = 0").select("region", "value"), shares.where("k > 0"), ["region"])
    return p.select("region", "value", "replicates", F.round("p", 9).alias("p"))


@query(f"""WITH {_ROTATED}, o AS (SELECT region, value FROM shares WHERE k = 0), z AS (SELECT value AS v FROM shares WHERE k > 0),
r AS (SELECT region, round((1 + (SELECT count(*) FROM z WHERE z.v >= o.value)) / (1 + (SELECT count(*) FROM z)), 9) AS p FROM o), s AS (SELECT *, row_number() OVER (ORDER BY p, region) AS k, count(*) OVER () AS m FROM r)
SELECT region, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM s""")
def empirical_fdr(spark, d):
    """q-values against the pooled replicates of all regions: each hypothesis counts the pool's values at or above its own."""
    archive.shared_folder(spark)
    shares = _rotated(spark, d).withColumn("turned", (F.col("k") > 0).cast("int"))
    total = shares.agg(F.sum("turned").alias("pool"))  # one row
    above = ranks.cumulative(shares, "value", F.col("turned")).select("value", "ge")
    p = shares.where("turned = 0").join(above, "value").crossJoin(F.broadcast(total)).select("region", F.round((1 + F.col("ge")) / (1 + F.col("pool")), 9).alias("p"), F.lit("all").alias("family"))
    return st.benjamini_hochberg(p, "p", ["family"], ["region"]).select("region", F.round("q_value", 6).alias("q_value"))
