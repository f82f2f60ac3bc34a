"""Arcs as typed state, inverse percentiles between the steps of a pool, and seeded picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeded
from ..operators import pools, series
from ..streaming import arcs
from .common import DAILY, daily, query, t
from .timeseries import _LUT

_END = "2024-03-01"

#: Typed events of eight places a day: a score against the place's usual one with the kinds at work, and by the shares of the day's
#: kinds a claim at six, a signal at noon and a grade in the evening.
_TYPED = f"""day_counts AS (SELECT user_id % 8 AS place, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS signups FROM events GROUP BY 1, 2),
usual AS (SELECT place, avg(n) AS usual FROM day_counts GROUP BY 1),
ev AS (SELECT CAST(place AS VARCHAR) AS key, 1 AS kind, epoch_us(CAST(day AS TIMESTAMP)) AS us, round(100.0 * n / usual, 3) AS score, kinds AS domains, '' AS grade FROM day_counts JOIN usual USING (place)
UNION ALL SELECT CAST(place AS VARCHAR), 2, epoch_us(CAST(day AS TIMESTAMP)) + 21600000000, NULL, 0, '' FROM day_counts WHERE bought * 100 > n * 25
UNION ALL SELECT CAST(place AS VARCHAR), 3, epoch_us(CAST(day AS TIMESTAMP)) + 43200000000, NULL, 0, '' FROM day_counts WHERE errors * 100 > n * 28
UNION ALL SELECT CAST(place AS VARCHAR), 4, epoch_us(CAST(day AS TIMESTAMP)) + 64800000000, NULL, 0, 'partial' FROM day_counts WHERE signups * 100 > n * 29)"""


def typed_events(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    c = t(spark, d, "events").groupBy((F.col("user_id") % 8).alias("place"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), kind("purchase").alias("bought"), kind("error").alias("errors"), kind("signup").alias("signups"))
    c = c.join(c.groupBy("place").agg(F.avg("n").alias("usual")), "place")
    event = lambda name, hours, when, score=None, domains=0, grade=None: F.when(when, F.struct(F.lit(name).alias("kind"), (F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))).alias("at"), (F.lit(None) if score is None else score).cast("double").alias("score"), (F.lit(domains) if isinstance(domains, int) else domains).cast("int").alias("domains"), F.lit(grade).cast("string").alias("grade")))
    share = lambda x, p: F.col(x) * 100 > F.col("n") * p
    all_ = F.array(event("score", 0, F.lit(True), F.round(100.0 * F.col("n") / F.col("usual"), 3), F.col("kinds")), event("claim", 6, share("bought", 25)), event("signal", 12, share("errors", 28)), event("grade", 18, share("signups", 29), grade="partial"))
    return c.select(F.col("place").cast("string").alias("key"), F.explode(all_).alias("e")).where("e is not null").select("key", "e.*")


_D = 86_400_000_000
_STEP = f"""SELECT key, ni AS i, CASE WHEN kind = 1 THEN score ELSE last END AS last, arcs + CAST(opens AS BIGINT) AS arcs,
CASE WHEN opens AND kind = 1 THEN 'buildup' WHEN claims THEN 'recognition' WHEN hit AND kind = 3 THEN 'outcome' WHEN hit THEN 'grade' ELSE act2 END AS act,
CASE WHEN opens AND kind = 1 THEN us + 14 * {_D} WHEN claims THEN us + 7 * {_D} WHEN hit AND kind = 4 THEN us + {_D} ELSE due1 END AS due,
CASE WHEN opens THEN 0 ELSE signals + CAST(hit AND kind = 3 AS BIGINT) END AS signals, CASE WHEN opens THEN '' WHEN hit AND kind = 4 THEN eg ELSE grade1 END AS grade,
list_concat(list_concat(CASE WHEN t1 THEN [{{'arc': arcs, 'act': 'grade', 'us': due, 'signals': signals, 'grade': grade1, 'why': 'deadline'}}] ELSE [] END, CASE WHEN t2 THEN [{{'arc': arcs, 'act': 'closed', 'us': due1, 'signals': signals, 'grade': grade1, 'why': 'timeout'}}] ELSE [] END),
CASE WHEN opens AND kind = 1 THEN [{{'arc': arcs + 1, 'act': 'buildup', 'us': us, 'signals': CAST(0 AS BIGINT), 'grade': '', 'why': 'score'}}] WHEN claims THEN [{{'arc': arcs + CAST(opens AS BIGINT), 'act': 'recognition', 'us': us, 'signals': CASE WHEN opens THEN 0 ELSE signals END, 'grade': CASE WHEN opens THEN '' ELSE grade1 END, 'why': 'claim'}}]
WHEN hit AND kind = 3 THEN [{{'arc': arcs, 'act': 'outcome', 'us': us, 'signals': signals + 1, 'grade': grade1, 'why': 'signal'}}] WHEN hit THEN [{{'arc': arcs, 'act': 'grade', 'us': us, 'signals': signals, 'grade': eg, 'why': 'grade'}}] ELSE [] END) AS outs"""


@query(f"""WITH RECURSIVE {_TYPED}, e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, kind, score, domains, grade) AS i FROM ev),
e2 AS (SELECT * FROM e UNION ALL SELECT key, 9, epoch_us(TIMESTAMP '{_END}'), NULL, 0, '', count(*) + 1 FROM e GROUP BY key),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS last, CAST(0 AS BIGINT) AS arcs, '' AS act, CAST(0 AS BIGINT) AS due, CAST(0 AS BIGINT) AS signals, '' AS grade, CAST([] AS STRUCT(arc BIGINT, act VARCHAR, us BIGINT, signals BIGINT, grade VARCHAR, why VARCHAR)[]) AS outs FROM e
UNION ALL {_STEP} FROM (SELECT *, (kind = 1 AND act2 = '' AND coalesce(score - last > 15, false) AND domains >= 2) OR (kind = 2 AND act2 = '') AS opens, kind = 2 AND act2 IN ('', 'buildup') AS claims, kind IN (3, 4) AND act2 IN ('recognition', 'outcome') AS hit
FROM (SELECT *, CASE WHEN t2 THEN '' ELSE act1 END AS act2 FROM (SELECT *, act1 IN ('grade', 'buildup') AND due1 <= us AS t2
FROM (SELECT *, CASE WHEN t1 THEN 'grade' ELSE act END AS act1, CASE WHEN t1 THEN due + {_D} ELSE due END AS due1, CASE WHEN t1 THEN CASE WHEN signals >= 1 THEN 'confirmed' ELSE 'missed' END ELSE grade END AS grade1
FROM (SELECT r.*, e2.us, e2.kind, e2.score, e2.domains, e2.grade AS eg, e2.i AS ni, r.act IN ('recognition', 'outcome') AND r.due <= e2.us AS t1 FROM r JOIN e2 ON e2.key = r.key AND e2.i = r.i + 1))))))
SELECT key, o.arc AS arc, o.act AS act, make_timestamp(o.us) AS moment, o.signals AS signals, nullif(o.grade, '') AS grade, o.why AS why FROM (SELECT key, unnest(outs) AS o FROM r)""")
def arc_acts(spark, d):
    acts = arcs.arc_acts(typed_events(spark, d), _END)
    return acts.select("key", "arc", "act", F.col("at").cast("timestamp_ntz").alias("moment"), "signals", "grade", "why")


@query(f"""WITH {_LUT}, p AS (SELECT range / 20.0 AS pct FROM range(0, 21)), s AS (SELECT 'low' AS side UNION ALL SELECT 'high'),
z AS (SELECT *, lead(value) OVER w AS next_value, lead(below) OVER w AS next_below, first_value(value) OVER w AS least_value FROM e WINDOW w AS (PARTITION BY region, pool_doy ORDER BY value)),
q AS (SELECT z.*, pct, side, CASE side WHEN 'high' THEN pct ELSE 1 - pct END * n AS b FROM z, p, s),
k AS (SELECT * FROM q WHERE below <= b QUALIFY row_number() OVER (PARTITION BY region, pool_doy, pct, side ORDER BY below DESC) = 1)
SELECT region, CAST(pool_doy AS INTEGER) AS pool_doy, CAST(pct AS DOUBLE) AS pct, side, round(CASE WHEN b <= 0 THEN least_value WHEN next_value IS NULL THEN value ELSE value + (b - below) / (next_below - below) * (next_value - value) END, 4) AS value FROM k""")
def inverse_percentiles(spark, d):
    lut = pools.pool_lut(daily(spark, d).drop("n"), ["region"], "day", "value")
    rows = lut.withColumn("pct", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k / 20.0)))
    value = lambda side: F.struct(F.lit(side).alias("side"), F.round(pools.inverse(F.col("vals"), F.col("below"), F.col("n"), F.col("pct"), side), 4).alias("value"))
    return rows.select("region", "pool_doy", "pct", F.explode(F.array(value("low"), value("high"))).alias("x")).select("region", "pool_doy", "pct", "x.*")


def _slice(name: str, lo: float, hi: float) -> str:
    return f"SELECT '{name}' AS band, * FROM k WHERE r >= floor(CAST({lo} AS DOUBLE) * n) AND r < ceil(CAST({hi} AS DOUBLE) * n)"


@query(f"""WITH {_LUT}, k AS (SELECT region, pool_doy, day, row_number() OVER (PARTITION BY region, pool_doy ORDER BY value, day) - 1 AS r, count(*) OVER (PARTITION BY region, pool_doy) AS n FROM m),
b AS ({_slice('low', 0.0, 0.05)} UNION ALL {_slice('middle', 0.45, 0.55)} UNION ALL {_slice('high', 0.95, 1.0)}),
f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY region, pool_doy, band ORDER BY day) <= 8 THEN 0 ELSE 1 END AS fresh FROM b),
g AS (SELECT region, pool_doy, band, count(*) AS matched_days, count(*) FILTER (WHERE fresh = 1) AS episode_count, count(DISTINCT year(day)) FILTER (WHERE fresh = 1) AS years, max(day) FILTER (WHERE fresh = 1) AS last_start, count(*) FILTER (WHERE fresh = 1 AND year(day) < 2000) AS nineties FROM f GROUP BY 1, 2, 3)
SELECT region, CAST(pool_doy AS INTEGER) AS pool_doy, band, matched_days, episode_count, years, last_start, nineties, CASE WHEN episode_count < 3 THEN 'too few episodes' WHEN years < 3 THEN 'too few years' END AS refusal FROM g""")
def band_slices(spark, d):
    members = pools.with_offsets(daily(spark, d).select("region", "day", "value"), "day", 10)
    baked = series.frequency_dictionary(members, ["region", "pool_doy"], "day", "value")
    out = None
    for name, lo, hi in (("low", 0.0, 0.05), ("middle", 0.45, 0.55), ("high", 0.95, 1.0)):
        facts = pools.band_facts(baked, lo, hi)
        nineties = F.aggregate(F.filter("decades", lambda x: x["decade"] < 2000), F.lit(0), lambda s, x: s + x["episodes"])
        part = facts.select("region", "pool_doy", F.lit(name).alias("band"), "matched_days", "episode_count", F.size("episode_years").alias("years"), "last_start", nineties.alias("nineties"), "refusal")
        out = part if out is None else out.unionByName(part)
    return out.where("matched_days > 0")


def _times(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % 4294967296 AS BIGINT)"


@query(f"""WITH {DAILY}, c AS (SELECT region, day, value, 'picks|' || region || '|' || CAST(year(day) AS VARCHAR) AS seed, CAST(abs(month(day) - 6) AS BIGINT) AS gap, CAST(row_number() OVER w AS BIGINT) AS i, count(*) OVER (PARTITION BY region, year(day)) AS total FROM daily WINDOW w AS (PARTITION BY region, year(day) ORDER BY day)),
h AS (SELECT *, list_reduce(list_transform(string_split(seed, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, u: CAST((CAST(xor(a, u) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT), CAST(2166136261 AS BIGINT)) AS word FROM c),
g1 AS (SELECT *, (word + {_times('1831565813', 'i')}) % 4294967296 AS a FROM h),
g2 AS (SELECT *, {_times('xor(a, a >> 15)', 'a | 1')} AS t1 FROM g1),
g3 AS (SELECT *, xor((t1 + {_times('xor(t1, t1 >> 7)', 't1 | 61')}) % 4294967296, t1) AS t2 FROM g2),
g4 AS (SELECT *, xor(t2, t2 >> 14) / 4294967296.0 AS draw FROM g3)
SELECT region, day, CAST(row_number() OVER (PARTITION BY region, year(day) ORDER BY CASE WHEN total > 8 THEN gap END, CASE WHEN total > 8 THEN draw END, i) AS INTEGER) AS pick FROM g4 QUALIFY pick <= 8""")
def seeded_picks(spark, d):
    x = daily(spark, d).withColumn("year", F.year("day"))
    seed = F.concat_ws("|", F.lit("picks"), "region", F.col("year").cast("string"))
    return seeded.seeded_picks(x, ["region", "year"], seed, [F.col("day")], [F.abs(F.month("day") - 6)], 8).select("region", "day", "pick")
