"""Paired precedents, an event study with a placebo, and a chain of gates, over daily order totals."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import sky
from ..operators import dossier, series, studies
from ..operators import statistics as st
from ..sources import archive
from .common import DAILY, daily, query, t

_SYNODIC = 29.530588861


def _age(day: str) -> str:
    jd = f"({day} - DATE '2000-01-01') + 2451545.0 - 2451550.09766"
    return f"({jd} - {_SYNODIC} * floor(({jd}) / {_SYNODIC}))"


#: Whole degrees of a region's day, made of its order totals.
_HIGHS = f"""{DAILY}, highs AS (SELECT region, day, CAST(floor(value / 10000) % 40 AS DOUBLE) AS high FROM daily)"""


def _highs(spark, d):
    return daily(spark, d).select("region", "day", (F.floor(F.col("value") / 10000) % 40).cast("double").alias("high"))


#: What followed each day: the moves of the seven days after it, its claim, and the running extremes that grade one.
_AFTER = """mv AS (SELECT a.region, a.day, b.day - a.day AS k, b.high - a.high AS move FROM highs a JOIN highs b ON a.region = b.region AND b.day - a.day BETWEEN 1 AND 7),
af AS (SELECT h.region, h.day, count(k) AS recorded, -min(move) AS fall, max(move) AS rise, min_by(k, (move, k)) AS low_k, min_by(k, (-move, k)) AS high_k, list(k) FILTER (WHERE k IS NOT NULL) AS ks FROM highs h LEFT JOIN mv ON mv.region = h.region AND mv.day = h.day GROUP BY 1, 2),
cl AS (SELECT *, CASE WHEN recorded < 3 THEN NULL WHEN fall >= 5 AND fall >= rise THEN 'cooled' WHEN rise >= 5 THEN 'warmed' ELSE 'held' END AS verb, CASE WHEN recorded < 3 THEN NULL WHEN fall >= 5 AND fall >= rise THEN low_k WHEN rise >= 5 THEN high_k END AS span FROM af)"""

#: The pool of each day and its two arms: near in temperature, and near in the moon's age besides or not.
_ARMS = f"""{_HIGHS}, an AS (SELECT region, day AS p, high AS v, off, strftime(day - CAST(off AS INTEGER), '%m-%d') AS md, year(day) AS y FROM highs, range(-3, 4) t(off)),
ix AS (SELECT region, day, high AS v0, strftime(day, '%m-%d') AS md, year(day) AS y FROM highs),
mn AS (SELECT i.region, i.day, a.off, avg(a.v) AS m FROM ix i JOIN an a ON a.region = i.region AND a.md = i.md AND a.y <> i.y GROUP BY 1, 2, 3 HAVING count(*) >= 5),
td AS (SELECT i.*, v0 - m AS today FROM ix i JOIN mn ON mn.region = i.region AND mn.day = i.day AND mn.off = 0),
pl AS (SELECT t.region, t.day, a.p, a.v - mn.m AS anomaly, t.today, abs({_age('a.p')} - {_age('t.day')}) AS away FROM td t JOIN an a ON a.region = t.region AND a.md = t.md AND a.y <> t.y AND abs(a.p - t.day) > 10 JOIN mn ON mn.region = t.region AND mn.day = t.day AND mn.off = a.off),
ok AS (SELECT *, least(away, {_SYNODIC} - away) <= 2 AS lit FROM pl WHERE CASE WHEN abs(today) < 2 THEN abs(anomaly) < 2 ELSE sign(anomaly) = sign(today) AND abs(anomaly - today) <= 5 END),
ar AS (SELECT region, day, max(p) FILTER (WHERE lit) AS with_day, max(p) FILTER (WHERE NOT lit) AS without_day FROM ok GROUP BY 1, 2), {_AFTER},
pr AS (SELECT ar.*, w.verb AS with_verb, w.span AS with_span, n.verb AS without_verb, n.span AS without_span FROM ar LEFT JOIN cl w ON w.region = ar.region AND w.day = with_day LEFT JOIN cl n ON n.region = ar.region AND n.day = without_day),
g AS (SELECT pr.region, pr.day, arm, verb, span, max(-move) FILTER (WHERE k <= span) AS fell, max(move) FILTER (WHERE k <= span) AS rose, count(*) FILTER (WHERE k <= span) AS known, max(abs(move)) AS most, count(k) AS all_known
FROM (SELECT region, day, 'with' AS arm, with_verb AS verb, with_span AS span FROM pr UNION ALL SELECT region, day, 'without', without_verb, without_span FROM pr) pr LEFT JOIN mv ON mv.region = pr.region AND mv.day = pr.day GROUP BY ALL),
gr AS (SELECT *, CASE verb WHEN 'held' THEN CASE WHEN most >= 5 THEN 0 WHEN all_known = 7 THEN 1 END WHEN 'cooled' THEN CASE WHEN fell >= 5 THEN 1 WHEN known = span THEN 0 END WHEN 'warmed' THEN CASE WHEN rose >= 5 THEN 1 WHEN known = span THEN 0 END END AS hit FROM g),
paired AS (SELECT pr.region, pr.day, with_day, without_day, with_verb, without_verb, w.hit AS with_hit, n.hit AS without_hit FROM pr JOIN gr w ON w.arm = 'with' AND w.region = pr.region AND w.day = pr.day JOIN gr n ON n.arm = 'without' AND n.region = pr.region AND n.day = pr.day)"""


def _paired(spark, d):
    near = studies.temperature_alike(F.col("anomaly"), F.col("today"))
    lit = sky.circular_moon_distance(F.col("p"), F.col("day")) <= 2
    return studies.paired_precedents(_highs(spark, d), ["region"], "day", "high", near, lit)


@query(f"WITH {_ARMS} SELECT * FROM paired")
def paired_precedents(spark, d):
    return _paired(spark, d)


#: The same arms with the moon's calendar turned by 0 to 6 years against the temperatures.
_TURNED = _ARMS.replace("ok AS (SELECT *, least(away", "ok AS (SELECT * EXCLUDE (away), least(away")
for _old, _new in (
    (f"abs({_age('a.p')} - {_age('t.day')}) AS away FROM td t JOIN", "k, CAST(a.p AS DATE) AS pp, CAST(t.day AS DATE) AS dd FROM range(0, 7) ks(k), td t JOIN"),
    ("ok AS (SELECT * EXCLUDE (away),", f"pm AS (SELECT *, {{p}} AS p2, {{d}} AS d2 FROM pl), pa AS (SELECT *, abs({_age('p2')} - {_age('d2')}) AS away FROM pm), ok AS (SELECT * EXCLUDE (away),"),
    ("<= 2 AS lit FROM pl WHERE", "<= 2 AS lit FROM pa WHERE"), ("ar AS (SELECT region, day, max(p)", "ar AS (SELECT region, day, k, max(p)"), ("FROM ok GROUP BY 1, 2),", "FROM ok GROUP BY 1, 2, 3),"),
    ("g AS (SELECT pr.region, pr.day, arm,", "g AS (SELECT pr.region, pr.day, pr.kk, arm,"), ("SELECT region, day, 'with' AS arm,", "SELECT region, day, k AS kk, 'with' AS arm,"), ("UNION ALL SELECT region, day, 'without',", "UNION ALL SELECT region, day, k, 'without',"),
    ("paired AS (SELECT pr.region, pr.day,", "paired AS (SELECT pr.region, pr.day, pr.k,"), ("w.region = pr.region AND w.day = pr.day JOIN gr", "w.region = pr.region AND w.day = pr.day AND w.kk = pr.k JOIN gr"), ("n.region = pr.region AND n.day = pr.day)", "n.region = pr.region AND n.day = pr.day AND n.kk = pr.k)"),
):
    assert _old in _TURNED, _old
    _TURNED = _TURNED.replace(_old, _new)


def _turned_sql(day: str) -> str:
    year = f"(1992 + (year({day}) - 1992 - k + 7) % 7)"
    return f"make_date(CAST({year} AS INTEGER), CAST(month({day}) AS INTEGER), CAST(CASE WHEN month({day}) = 2 AND day({day}) = 29 AND {year} % 4 <> 0 THEN 28 ELSE day({day}) END AS INTEGER))"


_TURNED = _TURNED.replace("{p}", _turned_sql("pp")).replace("{d}", _turned_sql("dd"))


@query(f"""WITH {_TURNED}, s AS (SELECT region, k, count(with_hit + without_hit) AS paired, count(*) FILTER (WHERE with_hit > without_hit) AS more, count(*) FILTER (WHERE with_hit < without_hit) AS less FROM paired GROUP BY 1, 2),
x AS (SELECT region, k, CASE WHEN paired > 0 THEN (more - less) / paired END AS delta FROM s), o AS (SELECT region, max(delta) FILTER (WHERE k = 0) AS observed, max(delta) FILTER (WHERE k > 0) AS largest, count(*) FILTER (WHERE k > 0) AS rotations FROM x GROUP BY 1)
SELECT region, round(observed, 9) AS observed, round(largest, 9) AS largest, rotations, observed IS NOT NULL AND (largest IS NULL OR observed > largest) AS beats_all, coalesce(observed >= 0.02, false) AS floor_met, observed IS NOT NULL AND (largest IS NULL OR observed > largest) AND coalesce(observed >= 0.02, false) AS certified,
round(CASE WHEN observed IS NULL THEN 1 ELSE (1 + (SELECT count(*) FROM x WHERE x.region = o.region AND k > 0 AND delta >= observed)) / (1 + rotations) END, 9) AS p FROM o""")
def certified_differences(spark, d):
    turned = lambda c: studies.turned_day(F.col(c), F.col("k"), 1992, 1998)
    lit = sky.circular_moon_distance(turned("p"), turned("day")) <= 2
    pairs = studies.paired_precedents(_highs(spark, d), ["region"], "day", "high", studies.temperature_alike(F.col("anomaly"), F.col("today")), lit, shifts=range(7))
    out = studies.certified(studies.paired_difference(pairs, ["region", "k"]), ["region"])
    return out.withColumns({c: F.round(c, 9) for c in ("observed", "largest", "p")})


# A tide's residual in quarters of a foot for days with an even number of orders; other days have none.
@query(f"""WITH {_HIGHS}, td0 AS (SELECT region, day, CASE WHEN n % 2 = 0 THEN (CAST(floor(value) AS BIGINT) % 9 - 4) / 4.0 END AS tide FROM daily), an AS (SELECT h.region, h.day AS p, high AS v, tide, off, strftime(h.day - CAST(off AS INTEGER), '%m-%d') AS md, year(h.day) AS y FROM highs h JOIN td0 ON td0.region = h.region AND td0.day = h.day, range(-3, 4) t(off)),
ix AS (SELECT h.region, h.day, high AS v0, tide, strftime(h.day, '%m-%d') AS md, year(h.day) AS y FROM highs h JOIN td0 ON td0.region = h.region AND td0.day = h.day),
mn AS (SELECT i.region, i.day, a.off, avg(a.v) AS m FROM ix i JOIN an a ON a.region = i.region AND a.md = i.md AND a.y <> i.y GROUP BY 1, 2, 3 HAVING count(*) >= 5),
pl AS (SELECT t.region, t.day, t.tide AS today_tide, a.p, a.tide, a.v - mn.m AS anomaly, t.v0 - m0.m AS today, abs({_age('a.p')} - {_age('t.day')}) AS away FROM ix t JOIN mn m0 ON m0.region = t.region AND m0.day = t.day AND m0.off = 0 JOIN an a ON a.region = t.region AND a.md = t.md AND a.y <> t.y AND abs(a.p - t.day) > 10 JOIN mn ON mn.region = t.region AND mn.day = t.day AND mn.off = a.off),
ok AS (SELECT *, CASE WHEN abs(today) < 2 THEN abs(anomaly) < 2 ELSE sign(anomaly) = sign(today) AND abs(anomaly - today) <= 5 END AS warm, least(away, {_SYNODIC} - away) <= 2 AS moon, coalesce(CASE WHEN abs(today_tide) < 0.5 THEN abs(tide) < 0.5 ELSE sign(tide) = sign(today_tide) AND abs(tide) >= 0.5 END, false) AS tidal FROM pl),
g AS (SELECT region, day, count(*) AS pool, count(tide) AS tides, any_value(today_tide) AS tt, count(*) FILTER (WHERE warm) AS alike, count(*) FILTER (WHERE warm AND moon) AS with_moon, count(*) FILTER (WHERE warm AND moon AND tidal) AS w3, max(p) FILTER (WHERE warm AND moon AND tidal) AS p3, max(p) FILTER (WHERE warm AND moon) AS p2 FROM ok GROUP BY 1, 2)
SELECT region, day, pool, tides, alike, with_moon, CASE WHEN tt IS NOT NULL AND tides >= 15 THEN 'moon_tide_temp' ELSE 'moon_temp' END AS mode, CASE WHEN tt IS NOT NULL AND tides >= 15 THEN w3 ELSE with_moon END AS lined_up, CASE WHEN tt IS NOT NULL AND tides >= 15 THEN p3 ELSE p2 END AS last_day FROM g""")
def line_ups(spark, d):
    tide = F.when(F.col("n") % 2 == 0, (F.floor("value") % 9 - 4) / 4.0)
    rows = daily(spark, d).select("region", "day", (F.floor(F.col("value") / 10000) % 40).cast("double").alias("high"), tide.alias("tide"))
    return studies.line_ups(rows, ["region"], "day", "high", "tide", sky.circular_moon_distance(F.col("p"), F.col("day")), least_tides=15)


@query(f"""WITH {_HIGHS}, td0 AS (SELECT region, day, CASE WHEN n % 2 = 0 THEN (CAST(floor(value) AS BIGINT) % 9 - 4) / 4.0 END AS tide FROM daily), hs AS (SELECT h.region, h.day, high, tide, strftime(h.day, '%m-%d') AS md, year(h.day) AS y FROM highs h JOIN td0 ON td0.region = h.region AND td0.day = h.day),
an AS (SELECT region, day AS p, high AS v, tide, off, strftime(day - CAST(off AS INTEGER), '%m-%d') AS md, y FROM hs, range(-3, 4) t(off)),
mn AS (SELECT i.region, i.day, a.off, avg(a.v) AS m FROM hs i JOIN an a ON a.region = i.region AND a.md = i.md AND a.y <> i.y GROUP BY 1, 2, 3 HAVING count(*) >= 5), {_AFTER},
pl AS (SELECT t.region, t.day, t.high AS v0, t.tide AS tt, a.p, a.v, a.off, a.tide, a.v - mn.m AS anomaly, t.high - m0.m AS today, abs({_age('a.p')} - {_age('t.day')}) AS far FROM hs t JOIN mn m0 ON m0.region = t.region AND m0.day = t.day AND m0.off = 0 JOIN an a ON a.region = t.region AND a.md = t.md AND a.y <> t.y AND abs(a.p - t.day) > 10 JOIN mn ON mn.region = t.region AND mn.day = t.day AND mn.off = a.off),
ok AS (SELECT pl.*, cl.recorded, cl.verb, cl.recorded >= 3 AS told, coalesce(cl.fall >= 5, false) AS cooled, CASE WHEN abs(today) < 2 THEN abs(anomaly) < 2 ELSE sign(anomaly) = sign(today) AND abs(anomaly - today) <= 5 END AND least(far, {_SYNODIC} - far) <= 2 AS two, coalesce(CASE WHEN abs(tt) < 0.5 THEN abs(tide) < 0.5 ELSE sign(tide) = sign(tt) AND abs(tide) >= 0.5 END, false) AS tidal FROM pl LEFT JOIN cl ON cl.region = pl.region AND cl.day = pl.p),
ag AS (SELECT region, day, any_value(v0) AS value, any_value(today) AS anomaly, count(*) FILTER (WHERE off = 0) AS years, avg(v) FILTER (WHERE off = 0) AS mean, stddev_samp(v) FILTER (WHERE off = 0) AS sd, any_value(tt) IS NOT NULL AND count(tide) >= 15 AS use, count(*) FILTER (WHERE two) AS c2, count(*) FILTER (WHERE two AND tidal) AS c3,
count(*) FILTER (WHERE off = 0 AND told) AS all_n, count(*) FILTER (WHERE off = 0 AND told AND cooled) AS all_cooled, count(*) FILTER (WHERE two AND told) AS n2, count(*) FILTER (WHERE two AND told AND cooled) AS k2, count(*) FILTER (WHERE two AND tidal AND told) AS n3, count(*) FILTER (WHERE two AND tidal AND told AND cooled) AS k3 FROM ok GROUP BY 1, 2),
near AS (SELECT region, day, p, v, verb, row_number() OVER (PARTITION BY region, day ORDER BY abs(v - v0), p, v) AS k FROM ok QUALIFY k <= 3),
file AS (SELECT r_name AS region, CAST(o_orderdate AS DATE) AS day, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS types FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000 GROUP BY 1, 2),
al AS (SELECT near.region, near.day, string_agg(CAST(p AS VARCHAR) || '=' || coalesce(verb, '') || '=' || coalesce(types, ''), ' ' ORDER BY k) AS alike FROM near LEFT JOIN file ON file.region = near.region AND file.day = p GROUP BY 1, 2),
fs AS (SELECT region, day, CASE WHEN n < 2 THEN 'unknown' WHEN peak - high >= 8 THEN 'front' WHEN high - began <= -3 THEN 'cooling' WHEN high - began >= 3 THEN 'warming' ELSE 'steady' END AS signal FROM (SELECT region, day, high, count(*) OVER w AS n, max(high) OVER w AS peak, first_value(high) OVER w AS began FROM highs WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)))
SELECT ag.region, ag.day, value, round(anomaly, 6) AS anomaly, years, round(CASE WHEN years >= 5 AND sd > 0 THEN (value - mean) / sd END, 6) AS z, signal, alike, CASE WHEN use THEN 'moon_tide_temp' ELSE 'moon_temp' END AS mode, CASE WHEN use THEN c3 ELSE c2 END AS lined_up, all_n, all_cooled, CASE WHEN use THEN n3 ELSE n2 END AS matched_n, CASE WHEN use THEN k3 ELSE k2 END AS matched_cooled
FROM ag JOIN al ON al.region = ag.region AND al.day = ag.day JOIN fs ON fs.region = ag.region AND fs.day = ag.day""")
def spot_dossiers(spark, d):
    tide = F.when(F.col("n") % 2 == 0, (F.floor("value") % 9 - 4) / 4.0)
    rows = daily(spark, d).select("region", "day", (F.floor(F.col("value") / 10000) % 40).cast("double").alias("high"), tide.alias("tide"))
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    file = o.where("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    file = file.select(F.col("r_name").alias("region"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("type"))
    out = dossier.dossiers(rows, file, ["region"], "day", "high", "tide", sky.circular_moon_distance(F.col("p"), F.col("day")), least_tides=15)
    text = F.array_join(F.transform("alike", lambda e: F.concat_ws("=", e["date"].cast("string"), F.coalesce(e["verb"], F.lit("")), F.array_join(e["on_file"], "+"))), " ")
    return out.select("region", "day", "value", F.round("anomaly", 6).alias("anomaly"), "years", F.round("z", 6).alias("z"), "signal", text.alias("alike"), "mode", "lined_up", "all_n", "all_cooled", "matched_n", "matched_cooled")


_UPPER = "CASE WHEN abs(z) > 6 THEN exp(-z * z / 2) / sqrt(2 * pi()) / abs(z) * (1 - 1 / (z * z)) ELSE 0.5 * (((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-z * z / 2)) END"


@query(f"""WITH {_ARMS}, s AS (SELECT region, count(*) AS days, count(*) FILTER (WHERE with_day IS NOT NULL AND without_day IS NOT NULL) AS both_arms, count(*) FILTER (WHERE with_day IS NOT NULL AND without_day IS NOT NULL AND with_verb IS NOT NULL AND without_verb IS NOT NULL) AS claims,
count(with_hit + without_hit) AS paired, coalesce(CAST(sum(with_hit) FILTER (WHERE without_hit IS NOT NULL) AS BIGINT), 0) AS with_hits, coalesce(CAST(sum(without_hit) FILTER (WHERE with_hit IS NOT NULL) AS BIGINT), 0) AS without_hits, count(*) FILTER (WHERE with_hit > without_hit) AS more, count(*) FILTER (WHERE with_hit < without_hit) AS less FROM paired GROUP BY 1),
z AS (SELECT *, (more - less) / sqrt(more + less) AS z FROM s), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS u FROM z), p AS (SELECT *, {_UPPER} AS q FROM u)
SELECT region, days, both_arms, claims, paired, with_hits, without_hits, more, less, round(CASE WHEN paired > 0 THEN (more - less) / paired END, 9) AS delta, round(CASE WHEN more + less = 0 THEN 1.0 WHEN z < 0 THEN 1 - q ELSE q END, 8) AS p FROM p""")
def paired_difference(spark, d):
    out = studies.paired_difference(_paired(spark, d), ["region"])
    return out.withColumns({"delta": F.round("delta", 9), "p": F.round("p", 8)})


#: Two-sided p of Student's t in SQL: the density summed by Simpson's rule from 0 to |t| in 2,000 steps.
def _student(t_: str, df: str) -> str:
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + pow(abs({t_}) * i / 2000.0, 2) / {df}))"
    return f"(SELECT 1 - 2 * abs({t_}) / 6000.0 * sum({density} * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) FROM range(0, 2001) n(i))"


#: Days on which a region's orders exceed twice its trailing mean are its events; z is the response.
_EVENTS = f"""{DAILY}, zs AS (SELECT region, day, value, CASE WHEN count(*) OVER w >= 10 THEN (value - avg(value) OVER w) / greatest(stddev_samp(value) OVER w, 0.5) END AS z0 FROM daily WINDOW w AS (PARTITION BY region ORDER BY day RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
z AS (SELECT region, day, greatest(least(z0, 8), -8) AS z FROM zs WHERE z0 IS NOT NULL), ev AS (SELECT region, day FROM z WHERE z > 2),
pt(region, partner) AS (VALUES ('AFRICA', 'ASIA'), ('AMERICA', 'EUROPE'), ('ASIA', 'AMERICA'), ('EUROPE', 'MIDDLE EAST'), ('MIDDLE EAST', 'AFRICA')),
bad AS (SELECT DISTINCT e.region, e.day FROM ev e JOIN pt USING (region) JOIN ev o ON o.region = partner AND abs(o.day - e.day) <= 3),
st AS (SELECT e.region AS key, 'matched' AS arm, lag, z.z AS value FROM ev e, (VALUES (1), (2), (3)) l(lag) JOIN z ON z.region = e.region AND z.day = e.day + lag
UNION ALL SELECT e.region, 'placebo', lag, z.z FROM ev e JOIN pt USING (region), (VALUES (1), (2), (3)) l(lag) JOIN z ON z.region = partner AND z.day = e.day + lag WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.region = e.region AND bad.day = e.day)
UNION ALL SELECT e.region, 'contaminated', lag, NULL FROM bad e, (VALUES (1), (2), (3)) l(lag)),
ag AS (SELECT lag, count(value) FILTER (WHERE arm = 'matched') AS mn, avg(value) FILTER (WHERE arm = 'matched') AS mm, var_samp(value) FILTER (WHERE arm = 'matched') AS mv, count(value) FILTER (WHERE arm = 'placebo') AS pn, avg(value) FILTER (WHERE arm = 'placebo') AS pm, var_samp(value) FILTER (WHERE arm = 'placebo') AS pv, count(*) FILTER (WHERE arm = 'contaminated') AS contaminated FROM st GROUP BY 1),
ts AS (SELECT *, mm / sqrt(mv / mn) AS mt, pm / sqrt(pv / pn) AS pt, (mm - pm) / sqrt(mv / mn + pv / pn) AS wt, pow(mv / mn + pv / pn, 2) / (pow(mv / mn, 2) / (mn - 1) + pow(pv / pn, 2) / (pn - 1)) AS df FROM ag),
ps AS (SELECT *, {_student('mt', '(mn - 1.0)')} AS mp, {_student('pt', '(pn - 1.0)')} AS pp, {_student('wt', 'df')} AS wp FROM ts)"""


@query(f"""WITH {_EVENTS}, k AS (SELECT *, row_number() OVER (ORDER BY wp, lag) AS k, count(*) OVER () AS m FROM ps WHERE wp IS NOT NULL)
SELECT lag, mn AS matched_n, round(mm, 6) AS matched_mean, round(mt, 6) AS matched_t, round(mp, 6) AS matched_p, pn AS placebo_n, round(pm, 6) AS placebo_mean, round(pt, 6) AS placebo_t, round(pp, 6) AS placebo_p, contaminated, round(wt, 6) AS welch_t, round(df, 6) AS welch_df, round(wp, 6) AS welch_p,
round(least(1.0, min(wp * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM k""")
def placebo_event_study(spark, d):
    z = series.trailing_z(daily(spark, d), ["region"], "day", "value").select("region", "day", "z")
    partners = spark.createDataFrame([("AFRICA", "ASIA"), ("AMERICA", "EUROPE"), ("ASIA", "AMERICA"), ("EUROPE", "MIDDLE EAST"), ("MIDDLE EAST", "AFRICA")], "region string, partner string")
    archive.shared_folder(spark)
    tests = studies.placebo_tests(studies.placebo_study(z, z.where("z > 2"), partners, "region", "day", "z")).checkpoint()  # its columns are large expressions
    out = st.benjamini_hochberg(tests.withColumn("family", F.lit(0)), "welch_p", ["family"], ["lag"])
    rounded = ("matched_mean", "matched_t", "matched_p", "placebo_mean", "placebo_t", "placebo_p", "welch_t", "welch_df", "welch_p", "q_value")
    return out.select("lag", "matched_n", "placebo_n", "contaminated", *(F.round(c, 6).alias(c) for c in rounded))


#: Breadth: the share of a day's regions with a high total; onsets are a region's highest days, the highest of a year its roll call.
_BREADTH = f"""{DAILY}, br AS (SELECT day, avg(CAST(value > 300000 AS INTEGER)) AS f, count(*) AS reported FROM daily GROUP BY 1),
ons AS (SELECT region || ' ' || CAST(day AS VARCHAR) AS id, day, value FROM daily QUALIFY row_number() OVER (PARTITION BY region, year(day) ORDER BY value DESC, day) <= 3),
roll AS (SELECT id FROM ons QUALIFY row_number() OVER (PARTITION BY year(day) ORDER BY value DESC, id) = 1),
bar AS (SELECT DISTINCT CAST(range AS DATE) AS day FROM ons, range(ons.day - INTERVAL 2 DAYS, ons.day + INTERVAL 3 DAYS, INTERVAL 1 DAY)),
fol AS (SELECT DISTINCT CAST(range AS DATE) AS day FROM ons, range(ons.day - INTERVAL 7 DAYS, ons.day, INTERVAL 1 DAY)),
cal AS (SELECT CAST(range AS DATE) AS d, k FROM range(DATE '1992-01-01', DATE '1999-01-01', INTERVAL 1 DAY), (SELECT CAST(range AS INTEGER) AS k FROM range(0, 7))),
src AS (SELECT d, k, 1992 + (year(d) - 1992 - k + 7) % 7 AS y FROM cal),
rot AS (SELECT k, d AS day, f, reported FROM (SELECT *, make_date(CAST(y AS INTEGER), CAST(month(d) AS INTEGER), CAST(CASE WHEN month(d) = 2 AND day(d) = 29 AND y % 4 <> 0 THEN 28 ELSE day(d) END AS INTEGER)) AS s FROM src) x JOIN br ON br.day = s),
win AS (SELECT k, day, avg(f) FILTER (WHERE reported >= 2) OVER w AS w, count(*) FILTER (WHERE reported >= 2) OVER w AS n FROM rot WINDOW w AS (PARTITION BY k ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
ws AS (SELECT k, day, w FROM win WHERE n >= 10),
ba AS (SELECT id, day, make_date(CAST(y AS INTEGER), CAST(month(day) AS INTEGER), CAST(day(day) AS INTEGER)) AS base FROM ons, range(1992, 1999) t(y) WHERE NOT (month(day) = 2 AND day(day) = 29 AND y % 4 <> 0)),
ca AS (SELECT DISTINCT id, day, CAST(range AS DATE) AS control FROM ba, range(base - INTERVAL 15 DAYS, base + INTERVAL 16 DAYS, INTERVAL 1 DAY) WHERE year(CAST(range AS DATE)) BETWEEN 1992 AND 1998),
co AS (SELECT ws.k, id, control, w FROM ca JOIN ws ON ws.day = control WHERE NOT EXISTS (SELECT 1 FROM bar WHERE bar.day = control)
QUALIFY row_number() OVER (PARTITION BY ws.k, id ORDER BY abs(year(control) - year(ca.day)), md5('controls|' || id || '|' || CAST(control AS VARCHAR)), control) <= 8),
th AS (SELECT k, id, quantile_cont(w, 0.5) AS middle, quantile_cont(w, 0.75) AS upper, count(*) AS controls, sum(w) AS s FROM co GROUP BY 1, 2),
ea AS (SELECT ws.k, ons.id, ws.w AS own, middle, upper, coalesce(controls, 0) AS controls, s FROM ons JOIN ws ON ws.day = ons.day LEFT JOIN th ON th.k = ws.k AND th.id = ons.id),
con AS (SELECT k, count(*) AS anchors, CAST(sum(controls) AS BIGINT) AS controls, avg(own) AS mean_own, sum(s) / sum(controls) AS mean_controls, avg(own) - sum(s) / sum(controls) AS delta FROM ea GROUP BY 1),
dl AS (SELECT ws.k, ws.w, ws.day, CAST(fol.day IS NOT NULL AS INTEGER) AS f, least(9, (row_number() OVER (PARTITION BY ws.k, month(ws.day) ORDER BY w, ws.day) - 1) * 10 // count(*) OVER (PARTITION BY ws.k, month(ws.day))) AS tenth FROM ws LEFT JOIN fol ON fol.day = ws.day WHERE NOT EXISTS (SELECT 1 FROM bar WHERE bar.day = ws.day)),
li AS (SELECT k, count(*) AS days, avg(f) AS base, coalesce(avg(f) FILTER (WHERE tenth = 9), 0) AS top FROM dl GROUP BY 1),
lf AS (SELECT *, top / base AS lift FROM li)"""


def _battery(spark, d):
    from pyspark.sql import Window

    x = daily(spark, d)
    breadth = x.groupBy("day").agg(F.avg((F.col("value") > 300000).cast("int")).alias("f"), F.count("*").alias("reported"))
    top = Window.partitionBy("region", F.year("day")).orderBy(F.desc("value"), "day")
    onsets = x.withColumn("r", F.row_number().over(top)).where("r <= 3").select(F.concat_ws(" ", "region", F.col("day").cast("string")).alias("id"), "day", "value")
    roll = onsets.withColumn("r", F.row_number().over(Window.partitionBy(F.year("day")).orderBy(F.desc("value"), "id"))).where("r = 1").select("id")
    anchors = onsets.select("id", "day")
    spread = lambda lo, hi: anchors.select(F.explode(F.sequence(F.date_add("day", lo), F.date_add("day", hi))).alias("day")).distinct()
    barred, followed = spread(-2, 2), spread(-7, -1)
    windows = studies.onset_windows(studies.rotations(breadth, [], "day", 1992, 1998, range(7)), "day", "f", F.col("reported") >= 2)
    controls = studies.epoch_controls(anchors, windows, barred, 1992, 1998)
    each, contrast = studies.onset_contrast(anchors, windows, controls)
    return each, contrast, studies.decile_lift(windows, followed, barred), roll


@query(f"WITH {_BREADTH} SELECT con.k, anchors, controls, round(mean_own, 9) AS mean_own, round(mean_controls, 9) AS mean_controls, round(delta, 9) AS delta, days, round(base, 9) AS base, round(top, 9) AS top, round(lift, 9) AS lift FROM con FULL JOIN lf ON lf.k = con.k")
def onset_battery(spark, d):
    _, contrast, lifts, _ = _battery(spark, d)
    return contrast.join(lifts, "k", "full").select("k", "anchors", "controls", "days", *(F.round(c, 9).alias(c) for c in ("mean_own", "mean_controls", "delta", "base", "top", "lift")))


@query(f"WITH {_BREADTH} SELECT id, round(own, 9) AS own, round(middle, 9) AS middle, round(upper, 9) AS upper, controls FROM ea WHERE k = 0")
def onset_anchors(spark, d):
    each, *_ = _battery(spark, d)
    return each.where("k = 0").select("id", "controls", *(F.round(c, 9).alias(c) for c in ("own", "middle", "upper")))


@query(f"""WITH {_BREADTH}, t AS (SELECT a.k, a.delta IS NOT NULL AND NOT EXISTS (SELECT 1 FROM con b WHERE b.k <> a.k AND b.delta >= a.delta) AS one FROM con a), u AS (SELECT a.k, a.base > 0 AND a.top >= 2 * a.base AND NOT EXISTS (SELECT 1 FROM lf b WHERE b.k <> a.k AND b.lift >= a.lift) AS two FROM lf a),
r AS (SELECT count(*) AS c, count(*) FILTER (WHERE own > middle) AS m, count(*) FILTER (WHERE own > upper) AS q FROM roll LEFT JOIN ea ON ea.id = roll.id AND ea.k = 0),
g AS (SELECT coalesce((SELECT anchors >= 10 FROM con WHERE k = 0), false) AS floor, (SELECT c > 0 AND m = c AND q >= c - 1 FROM r) AS g0, NOT (coalesce((SELECT one FROM t WHERE k = 3), false) OR coalesce((SELECT two FROM u WHERE k = 3), false)) AS g2, true AS g3, coalesce((SELECT one FROM t WHERE k = 0), false) AS test1, coalesce((SELECT two FROM u WHERE k = 0), false) AS test2)
SELECT *, CASE WHEN NOT floor THEN 'too few anchors' WHEN NOT g0 THEN 'positive control failed' WHEN NOT g2 THEN 'a test passed on rotated data' WHEN NOT test1 THEN 'no contrast before onsets' WHEN NOT test2 THEN 'no lift' ELSE 'signal' END AS verdict FROM g""")
def onset_gates(spark, d):
    each, contrast, lifts, roll = _battery(spark, d)
    return studies.gates(each, contrast, lifts, roll, 3)
