"""Scores, alerts, grades and leads: rules as columns over one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import compare, ladder, round_half_up
from .joins import interval_join


def composite(components: Mapping[str, tuple[Column, float]], full: float) -> Column:
    """The capped components' sum as a share of `full`, 0..100, halves up; a missing component counts nothing."""
    total = sum((F.coalesce(F.least(F.greatest(c, F.lit(0.0)), F.lit(cap)), F.lit(0.0)) for c, cap in components.values()), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), round_half_up(total * 100 / full)))


def first_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds."""
    return ladder([(F.coalesce(c, F.lit(False)), name) for name, c in rules])


def throttle(alerts: DataFrame, key: Sequence[str], at: str, hours: int) -> DataFrame:
    """Alerts that no earlier alert kept of the same key precedes by less than `hours`: an ordered fold over each
    key's times, as what is dropped must not silence what follows."""
    step = F.struct
    times = F.array_sort(F.collect_set(F.col(at).cast("timestamp")))
    none = F.array().cast("array<timestamp>")
    kept = F.aggregate(
        F.col("_times"), step(F.lit(None).cast("timestamp").alias("last"), none.alias("kept")),
        lambda s, x: F.when(s["last"].isNull() | (F.unix_micros(x) - F.unix_micros(s["last"]) >= hours * 3_600_000_000), step(x.alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    return alerts.groupBy(*key).agg(times.alias("_times")).select(*key, F.explode(kept).alias(at))


def domain_grade(claims: DataFrame, signals: DataFrame, key: str, days: int, need: int) -> DataFrame:
    """Claims (key, state, day, domains) graded by the domains with `need` signals or more in the days after:
    a share of 0.8 is confirmed, 0.4 partial, else missed. signals: (state, signal_day, domain)."""
    wanted = claims.select(key, "state", "day", F.explode("domains").alias("domain"))
    hits = interval_join(wanted, signals, ["state", "domain"], "day", "signal_day", 1, days).groupBy(key, "domain").agg(F.count("*").alias("n"))
    g = wanted.join(hits, [key, "domain"], "left").groupBy(key).agg(F.count("*").alias("domains"), F.count_if(F.col("n") >= need).alias("met"))
    share = F.col("met") / F.col("domains")
    return g.withColumn("grade", ladder([(share >= 0.8, "confirmed"), (share >= 0.4, "partial")], "missed"))


def lead_step(fires: DataFrame, open_leads: DataFrame, key: Sequence[str], as_of: str) -> DataFrame:
    """One round of a lead's life: fired and none open opens one, fired and open refreshes it, open and quiet fades."""
    joined = fires.select(*key, F.lit(True).alias("_f")).join(open_leads.select(*key, "opened_at"), list(key), "full")
    fired, opened = F.col("_f").isNotNull(), F.col("opened_at").isNotNull()
    action = F.when(fired & ~opened, "open").when(fired & opened, "refresh").otherwise("fade")
    return joined.select(*key, action.alias("action"), F.coalesce("opened_at", F.lit(as_of).cast("date")).alias("opened_at"))


def honest_accuracy(grades: DataFrame, key: Sequence[str], least: int = 5, suppress_below: float = 0.4) -> DataFrame:
    """Share of graded claims that hit and beat their controls; below the bar with enough claims is suppressed."""
    good = F.col("hit") & (F.col("lift") > 1)
    g = grades.where(F.col("hit").isNotNull()).groupBy(*key).agg(F.count("*").alias("graded"), F.count_if(good).alias("good"))
    g = g.withColumn("accuracy", F.col("good") / F.col("graded"))
    return g.withColumn("suppressed", (F.col("graded") >= least) & (F.col("accuracy") < suppress_below))


def forecast_skill(forecast: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """100 - (2 |dT| + |dw| + 3 |dp|), clamped to 0..100; null where any reading is missing."""
    j = forecast.alias("f").join(actual.alias("a"), list(on))
    away = lambda c: F.abs(F.col(f"f.{c}") - F.col(f"a.{c}"))
    raw = 100 - (2 * away("temp") + away("wind") + 3 * away("precip"))
    return j.select(*on, F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))).alias("skill"))


def station_changes(obs: DataFrame, station: Sequence[str], at: str, tie: Sequence[str] = ()) -> DataFrame:
    """Oldest against newest reading of a station, 1 to 6 hours apart: temp falls, wind turns, pressure moves; two or
    more at one station add a front. Readings of one time go by `tie`. Columns temp, wind_dir, pressure; pressures outside 870..1100 say nothing."""
    reading = F.struct(F.col(at).cast("timestamp").alias("at"), "temp", "wind_dir", F.when(F.col("pressure").between(870, 1100), F.col("pressure")).alias("pressure"))
    order = F.struct(at, *tie)
    g = obs.groupBy(*station).agg(F.min_by(reading, order).alias("a"), F.max_by(reading, order).alias("b"))
    hours = (F.unix_micros("b.at") - F.unix_micros("a.at")) / 3.6e9
    fall = F.col("a.temp") - F.col("b.temp")
    turn = F.abs(F.col("b.wind_dir") - F.col("a.wind_dir"))
    turn = F.least(turn, 360 - turn)
    move = F.col("b.pressure") - F.col("a.pressure")
    event = lambda hit, name, high: F.when(hit, F.struct(F.lit(name).alias("event"), F.when(high, "high").otherwise("medium").alias("severity")))
    found = F.array_compact(F.array(event(fall > 5, "temp-drop", fall > 12), event(turn > 60, "wind-shift", turn > 135), event(move < -2, "pressure-drop", move < -6), event(move > 3, "pressure-rise", F.lit(False))))
    front = F.when(F.size("found") >= 2, F.concat("found", F.array(F.struct(F.lit("front-passage").alias("event"), F.lit("high").alias("severity"))))).otherwise(F.col("found"))
    rows = g.where(hours.between(1, 6)).select(*station, found.alias("found")).select(*station, F.explode(front).alias("e"))
    return rows.select(*station, "e.event", "e.severity")


#: A claim's conditions name a series, a statistic and a bound.
def condition_days(condition: Mapping, sources: Mapping[str, DataFrame]) -> DataFrame:
    """(state, day) on which one condition of a claim holds.

    presence: at least `min_count` rows of a type in the `lookback` days up to the day. value: the day's value compared
    by `op`. z: the value's deviation from the `baseline_days` days before, compared by `op` with `z`."""
    kind = condition["kind"]
    df = sources[condition["source"]]
    w = Window.partitionBy("state").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))
    if kind == "presence":
        back = condition.get("lookback", 0)
        per_day = df.groupBy("state", "day").agg(F.count("*").alias("n"))
        days = per_day.select("state", F.explode(F.sequence("day", F.date_add("day", back))).alias("day")).distinct()
        counts = days.join(per_day, ["state", "day"], "left").withColumn("k", F.sum("n").over(w.rangeBetween(-back, 0)))
        return counts.where(F.col("k") >= condition.get("min_count", 1)).select("state", "day")
    if kind not in ("value", "z"):
        raise ValueError(f"no such condition: {kind}")
    value = F.col(condition["path"])
    if kind == "value":
        return df.where(compare(value, condition["op"], condition["value"])).select("state", "day").distinct()
    base = w.rangeBetween(-condition["baseline_days"], -1)
    z = (value - F.avg(value).over(base)) / F.stddev_pop(value).over(base)
    ok = (F.count(value).over(base) >= condition.get("least", 5)) & (F.stddev_pop(value).over(base) > 0)
    return df.withColumn("_z", F.when(ok, z)).where(compare(F.col("_z"), condition["op"], condition["z"])).select("state", "day").distinct()


def claim_fires(claim: Mapping, sources: Mapping[str, DataFrame], fired: DataFrame | None = None) -> DataFrame:
    """(state, day) on which a claim's trigger fires: all or any of its conditions, without those fired before."""
    parts = [condition_days(c, sources).withColumn("_c", F.lit(k)) for k, c in enumerate(claim["conditions"])]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    need = len(parts) if claim.get("mode", "all") == "all" else 1
    out = union.groupBy("state", "day").agg(F.countDistinct("_c").alias("_n")).where(F.col("_n") >= need).drop("_n")
    return out if fired is None else out.join(fired.select("state", "day"), ["state", "day"], "left_anti")


def grade_claim(fires: DataFrame, outcomes: DataFrame, controls: DataFrame, days: int) -> DataFrame:
    """hits, fires, control hits and control days, and the finite lift of a claim, by state. outcomes: (state, outcome_day)."""
    hit = lambda d: interval_join(d, outcomes, ["state"], "day", "outcome_day", 1, days).select("state", "day").distinct().withColumn("_h", F.lit(1))
    rate = lambda d, a, b: d.select("state", "day").distinct().join(hit(d.select("state", "day").distinct()), ["state", "day"], "left").groupBy("state").agg(F.count("_h").alias(a), F.count("*").alias(b))
    j = rate(fires, "hits", "fires").join(rate(controls, "control_hits", "control_days"), "state", "left")
    base = F.greatest(F.col("control_hits") / F.col("control_days"), 1 / (2 * F.col("control_days")))
    return j.withColumn("lift", (F.col("hits") / F.col("fires")) / base)
