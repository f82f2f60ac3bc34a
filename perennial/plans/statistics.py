"""Statistics on derived counts, controls, sweeps, clustering and event studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, series
from ..operators import statistics as st
from .common import DAILY, daily, query, t

#: Per supplier: returned and late lines as a 2x2 table.
_TABLES = """tables AS (SELECT l_suppkey AS supplier, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.05) AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount < 0.05) AS b,
count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount >= 0.05) AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_discount < 0.05) AS d FROM lineitem GROUP BY 1)"""


def _tables(spark, d):
    r, big = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05
    g = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"))
    return g.agg(F.count_if(r & big).alias("a"), F.count_if(r & ~big).alias("b"), F.count_if(~r & big).alias("c"), F.count_if(~r & ~big).alias("d"))


_FISHER = f"""{_TABLES}, f AS (SELECT k, coalesce(sum(ln(k)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS lf FROM (SELECT CAST(range AS BIGINT) AS k FROM range(1, 20000)) UNION ALL SELECT 0, 0.0),
x AS (SELECT supplier, a, b, c, d, unnest(range(a, least(a + b, a + c) + 1)) AS k FROM tables),
p AS (SELECT supplier, a, b, c, d, least(1.0, sum(exp(f1.lf + f2.lf + f3.lf + f4.lf - f5.lf - f6.lf - f7.lf - f8.lf - f9.lf))) AS p FROM x
JOIN f f1 ON f1.k = a + b JOIN f f2 ON f2.k = c + d JOIN f f3 ON f3.k = a + c JOIN f f4 ON f4.k = b + d JOIN f f5 ON f5.k = a + b + c + d JOIN f f6 ON f6.k = x.k JOIN f f7 ON f7.k = a + b - x.k JOIN f f8 ON f8.k = a + c - x.k JOIN f f9 ON f9.k = d - a + x.k GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH {_FISHER} SELECT supplier, round(p, 8) AS p FROM p")
def fisher_exact(spark, d):
    return _tables(spark, d).select("supplier", F.round(st.fisher_greater("a", "b", "c", "d"), 8).alias("p"))


@query(f"""WITH {_TABLES} SELECT supplier, round(greatest(0, (a / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(a / n * (1 - a / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)), 8) AS lo,
round(least(1, (a / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(a / n * (1 - a / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)), 8) AS hi FROM (SELECT *, CAST(a + b AS DOUBLE) AS n FROM tables) WHERE n > 0""")
def wilson_interval(spark, d):
    w = st.wilson(F.col("a"), (F.col("a") + F.col("b")).cast("double"))
    return _tables(spark, d).where("a + b > 0").select("supplier", F.round(w["lo"], 8).alias("lo"), F.round(w["hi"], 8).alias("hi"))


@query(f"""WITH {_FISHER}, r AS (SELECT supplier, round(p, 10) AS p, row_number() OVER (ORDER BY round(p, 10), supplier) AS k, count(*) OVER () AS m FROM p)
SELECT supplier, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r""")
def benjamini_hochberg(spark, d):
    x = _tables(spark, d).select("supplier", F.lit("all").alias("family"), F.round(st.fisher_greater("a", "b", "c", "d"), 10).alias("p"))
    return st.benjamini_hochberg(x, "p", ["family"], ["supplier"]).select("supplier", F.round("q_value", 6).alias("q_value"))


@query(f"""WITH {_TABLES} SELECT supplier, round((a / (a + b)) / greatest(c / (c + d), 1 / (2 * (c + d))), 6) AS lift FROM tables WHERE a + b > 0 AND c + d > 0""")
def finite_lift(spark, d):
    c = F.col
    return _tables(spark, d).where("a + b > 0 and c + d > 0").select("supplier", F.round(st.finite_lift(c("a"), c("a") + c("b"), c("c"), c("c") + c("d")), 6).alias("lift"))


@query(f"""WITH {DAILY}, m AS (SELECT region, year(day) * 12 + month(day) AS x, avg(value) AS y FROM daily GROUP BY 1, 2), s AS (SELECT a.region, median((b.y - a.y) / (b.x - a.x)) AS slope FROM m a JOIN m b ON a.region = b.region AND a.x < b.x GROUP BY 1)
SELECT m.region, round(slope, 4) AS slope, round(median(y - slope * x), 2) AS intercept, count(*) AS n FROM m JOIN s ON m.region = s.region GROUP BY m.region, slope""")
def theil_sen_trend(spark, d):
    m = daily(spark, d).groupBy("region", (F.year("day") * 12 + F.month("day")).alias("x")).agg(F.avg("value").alias("y"))
    return st.theil_sen(m, ["region"], "x", "y").select("region", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""WITH r AS (SELECT l_returnflag AS flag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT flag, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_rank(spark, d):
    return st.spearman(t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity", "l_extendedprice").select("flag", F.round("rho", 6).alias("rho"), "n")


@query(f"""WITH {DAILY}, s AS (SELECT * FROM daily WHERE region = 'ASIA'), k AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, 6)), y AS (SELECT min(year(day)) AS y0, 7 AS len FROM s),
r AS (SELECT k, s.value, make_date(CAST(y0 + (year(day) - y0 + k) % len AS INTEGER), CAST(month(day) AS INTEGER), CAST(CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END AS INTEGER)) AS day FROM s, k, y)
SELECT r.k AS shift, count(*) AS pairs, round(avg(CAST(r.value > e.value AS INTEGER)) + 1e-9, 6) AS share FROM r JOIN daily e ON e.region = 'EUROPE' AND e.day = r.day GROUP BY 1""")
def rotation_null(spark, d):
    x = daily(spark, d)
    first = x.where("region = 'ASIA'").agg(F.min(F.year("day")).alias("first"))  # one row
    a = x.where("region = 'ASIA'").withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(5)))).crossJoin(F.broadcast(first))
    year = F.col("first") + F.pmod(F.year("day") - F.col("first") + F.col("shift"), F.lit(7))
    moved = F.make_date(year, F.month("day"), F.when((F.month("day") == 2) & (F.dayofmonth("day") == 29), 28).otherwise(F.dayofmonth("day")))
    a = a.select("shift", moved.alias("day"), F.col("value").alias("a"))
    e = x.where("region = 'EUROPE'").select("day", F.col("value").alias("e"))
    return a.join(e, "day").groupBy("shift").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("a") > F.col("e")).cast("int")) + 1e-9, 6).alias("share"))


@query(f"""WITH {DAILY}, b AS (SELECT region, day FROM daily WHERE value > 800000) SELECT region, count(*) AS open_days FROM daily a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.region = a.region AND abs(a.day - b.day) <= 10) GROUP BY 1""")
def blocked_days(spark, d):
    x = daily(spark, d)
    blocked = x.where("value > 800000").select("region", F.explode(F.sequence(F.date_sub("day", 10), F.date_add("day", 10))).alias("day")).distinct()
    return x.join(blocked, ["region", "day"], "left_anti").groupBy("region").agg(F.count("*").alias("open_days"))


@query(f"""WITH {DAILY}, q AS (SELECT region, day FROM daily WHERE value > 600000), c AS (SELECT q.region, q.day, d.day AS control, abs(year(q.day) - year(d.day)) AS gap, (CAST(d.day - DATE '1970-01-01' AS BIGINT) * 7919) % 10007 AS h
FROM q JOIN daily d ON q.region = d.region AND year(q.day) <> year(d.day) AND strftime(q.day, '%m-%d') = strftime(d.day, '%m-%d'))
SELECT region, day, control FROM c QUALIFY row_number() OVER (PARTITION BY region, day ORDER BY gap, h, control) <= 3""")
def matched_controls(spark, d):
    x = daily(spark, d).select("region", "day", F.date_format("day", "MM-dd").alias("md"), "value")
    q = x.where("value > 600000").select("region", "md", "day")
    c = q.join(x.select("region", "md", F.col("day").alias("control")), ["region", "md"]).where(F.year("day") != F.year("control"))
    h = (F.datediff("control", F.lit("1970-01-01").cast("date")).cast("long") * 7919) % 10007
    return c.withColumn("k", F.row_number().over(Window.partitionBy("region", "day").orderBy(F.abs(F.year("day") - F.year("control")), h, "control"))).where("k <= 3").select("region", "day", "control")


@query(f"""WITH {DAILY}, a AS (SELECT region, day FROM daily WHERE value > 700000) SELECT a.region, tau, lead, count(*) AS n FROM a JOIN daily b ON a.region = b.region AND a.day - b.day BETWEEN 0 AND 30, (VALUES (200000.0), (400000.0)) v(tau), (VALUES (7), (30)) w(lead)
WHERE b.value >= tau AND a.day - b.day <= lead GROUP BY 1, 2, 3""")
def window_tallies(spark, d):
    x = daily(spark, d).select("region", "day", "value")
    a = x.where("value > 700000").select("region", "day")
    hits = joins.interval_join(a, x.select("region", F.col("day").alias("d2"), F.col("value").alias("v")), ["region"], "day", "d2", -30, 0)
    grid = F.explode(F.array(*(F.struct(F.lit(tau).alias("tau"), F.lit(lead).alias("lead")) for tau in (200000.0, 400000.0) for lead in (7, 30))))
    g = hits.withColumn("g", grid).where("v >= g.tau and datediff(day, d2) <= g.lead")
    return g.groupBy("region", F.col("g.tau").alias("tau"), F.col("g.lead").alias("lead")).agg(F.count("*").alias("n"))


def _bursts(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    b = o.where("o_totalprice > 480000").join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day")).distinct()
    return b.withColumn("id", series.day_number("day").cast("long") * 100 + F.col("nation"))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000),
n AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) * 100 + nation AS id FROM b), e AS (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON abs(a.day - b.day) <= 1 AND abs(a.nation - b.nation) <= 1),
r AS (SELECT id AS x, id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS id, min(y) AS label FROM r GROUP BY 1""")
def event_stitcher(spark, d):
    n = _bursts(spark, d)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("dd"), F.lit(j).alias("dn")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    e = n.withColumn("s", near).select(F.col("id").alias("a"), F.expr("date_add(day, s.dd)").alias("day"), (F.col("nation") + F.col("s.dn")).alias("nation")).join(n, ["day", "nation"]).select("a", F.col("id").alias("b"))
    from ..sources.archive import shared_folder

    shared_folder(spark)
    return st.union_find(e)


@query(f"""WITH {DAILY}, e AS (SELECT region, day FROM daily WHERE value > 600000), p AS (SELECT e.region, lag, b.value - a.value AS change FROM e JOIN daily a ON a.region = e.region AND a.day = e.day - 1, (VALUES (1), (2), (3)) v(lag) JOIN daily b ON b.region = e.region AND b.day = e.day + lag)
SELECT region, lag, count(*) AS n, round(avg(change) + 1e-6, 2) AS mean, round(avg(change) / (stddev_samp(change) / sqrt(count(*))), 6) AS t FROM p GROUP BY 1, 2 HAVING count(*) >= 3""")
def event_study(spark, d):
    x = daily(spark, d).select("region", "day", "value")
    e = x.where("value > 600000").select("region", "day").withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    before = x.select("region", F.date_add("day", 1).alias("day"), F.col("value").alias("a"))
    after = x.select("region", F.col("day").alias("later"), F.col("value").alias("b"))
    p = e.join(before, ["region", "day"]).withColumn("later", F.expr("date_add(day, lag)")).join(after, ["region", "later"]).withColumn("change", F.col("b") - F.col("a"))
    g = p.groupBy("region", "lag").agg(F.count("*").alias("n"), F.avg("change").alias("m"), F.stddev_samp("change").alias("sd")).where("n >= 3")
    return g.select("region", "lag", "n", F.round(F.col("m") + 1e-6, 2).alias("mean"), F.round(F.col("m") / (F.col("sd") / F.sqrt("n")), 6).alias("t"))


@query(f"""WITH {DAILY}, r AS (SELECT region, year(day) AS y, avg(value) AS v FROM daily GROUP BY 1, 2), p AS (SELECT a.region, a.y, a.v > b.v AS up, c.v > b.v AS pre FROM r a JOIN r b ON a.region = b.region AND a.y = b.y + 1 JOIN r c ON c.region = a.region AND c.y = a.y - 2)
SELECT count(*) FILTER (WHERE up AND NOT pre) AS b, count(*) FILTER (WHERE pre AND NOT up) AS c, round((count(*) FILTER (WHERE up AND NOT pre) - count(*) FILTER (WHERE pre AND NOT up)) / sqrt(count(*) FILTER (WHERE up <> pre)), 6) AS z FROM p""")
def mcnemar_arms(spark, d):
    r = daily(spark, d).groupBy("region", F.year("day").alias("y")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("region").orderBy("y")
    p = r.withColumns({"b": F.lag("v", 1).over(w), "c": F.lag("v", 2).over(w)}).where("c is not null").selectExpr("v > b as up", "c > b as pre")
    b, c = F.count_if(F.col("up") & ~F.col("pre")), F.count_if(F.col("pre") & ~F.col("up"))
    return p.agg(b.alias("b"), c.alias("c"), F.round((b - c) / F.sqrt(F.count_if(F.col("up") != F.col("pre"))), 6).alias("z"))


@query(f"""WITH {DAILY} SELECT day, count(*) AS regions, round(count(*) FILTER (WHERE value > 300000) / count(*), 6) AS breadth FROM daily GROUP BY 1 HAVING count(*) >= 4""")
def daily_breadth(spark, d):
    return daily(spark, d).groupBy("day").agg(F.count("*").alias("regions"), F.round(F.count_if(F.col("value") > 300000) / F.count("*"), 6).alias("breadth")).where("regions >= 4")


@query("""WITH c AS (SELECT o_orderpriority AS family, CASE WHEN o_totalprice > 400000 THEN 'MAJOR' WHEN o_totalprice > 300000 THEN 'SEVERE' ELSE 'ALL' END AS tier, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT family, tier, nation, count(*) AS n FROM c GROUP BY GROUPING SETS ((family, tier, nation), (family, tier)) HAVING count(*) >= 20""")
def tiered_cells(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    tier = F.when(F.col("o_totalprice") > 400000, "MAJOR").when(F.col("o_totalprice") > 300000, "SEVERE").otherwise("ALL")
    x = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderpriority").alias("family"), tier.alias("tier"), F.col("c_nationkey").alias("nation"))
    return x.groupingSets([["family", "tier", "nation"], ["family", "tier"]], "family", "tier", "nation").agg(F.count("*").alias("n")).where("n >= 20")
