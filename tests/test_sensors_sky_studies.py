"""Planted cases for sensors, sun and moon, and studies."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from perennial.functions import sky
from perennial.operators import sensors, studies

DAY = dt.timedelta(days=1)


def days(start, n):
    return [dt.date.fromisoformat(start) + k * DAY for k in range(n)]


# --- sensors ---


def readings(low="low", high="high", low_base="mean_low", high_base="mean_high"):
    lo, hi = F.col(low), F.col(high)
    below = F.col(low_base) - lo
    return [
        sensors.Reading(low, lo, below, (lo <= 15) & F.month("day").between(5, 9), below > 38),
        sensors.Reading(high, hi, hi - F.col(high_base), (hi >= 115) & F.month("day").isin(12, 1, 2), F.lit(True)),
    ]


SCHEMA = "state string, day date, id long, low double, high double, mean_low double, mean_high double"


def scan(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sensors.sensor_scan(df, ["state"], "day", "id", "low", "high", readings()).collect()
    left = sensors.suspects(df, ["state"], "day", "id", readings()).collect()
    return {(r["state"], str(r["day"]), r["id"]): r for r in got}, left


def test_a_run_is_confirmed_by_a_value_proven_elsewhere(spark):
    summer, winter = days("2001-07-01", 6), days("2002-01-01", 5)
    rows = [("MD", d, k, 7.0, 85.0, 65.0, 84.0) for k, d in enumerate(summer)]  # proves itself: far below, and impossible
    rows += [("MD", d, 20 + k, 7.0, 40.0, 25.0, 41.0) for k, d in enumerate(winter)]  # a spread of 18 in a short run proves nothing
    rows += [("VA", d, 40 + k, 7.0, 40.0, 25.0, 41.0) for k, d in enumerate(winter)]  # the same run where nothing proves the value
    rows += [("MD", dt.date(2002, 3, 1), 60, 7.0, 40.0, 20.0, 41.0)]  # the value alone is no run
    flags, left = scan(spark, rows)
    assert {k[0] for k in flags} == {"MD"} and len(flags) == 11
    assert flags["MD", "2001-07-03", 2]["by_itself"] and not flags["MD", "2002-01-03", 22]["by_itself"]
    assert {r["flag"] for r in flags.values()} == {"low stuck"} and flags["MD", "2002-01-01", 20]["days"] == 5
    assert [(r["state"], r["kind"], r["days"]) for r in left if r["field"] == "low"] == [("VA", "run", 5)]


def test_flags_in_order_and_runs_that_are_none(spark):
    rows = [("A", dt.date(2001, 7, 1), 1, 90.0, 60.0, 65.0, 85.0)]  # low above high
    rows += [("A", dt.date(2001, 6, 1), 2, 12.0, 80.0, 55.0, 80.0), ("A", dt.date(2001, 6, 9), 3, 12.0, 80.0, 45.0, 80.0)]  # corroborated, and not
    rows += [("A", dt.date(2001, 1, 9), 4, 30.0, 118.0, 31.0, 40.0)]
    rows += [("A", d, 10 + k, 50.0, 70.0, 81.0, 70.0) for k, d in enumerate(days("2001-08-01", 4))]  # four days are no run
    rows += [("A", d, 30 + k, 50.0, 70.0 + k, 81.0, 70.0) for k, d in enumerate([*days("2001-09-01", 3), *days("2001-09-05", 3)])]  # nor is one with a hole
    rows += [("A", d, 50 + k, 50.0, None, 66.0, None) for k, d in enumerate(days("2001-10-01", 10))]  # ten days, 16 below: long
    rows += [("B", d, 70 + k, 50.0, None, 66.0, None) for k, d in enumerate(days("2001-10-01", 9))]  # nine are not
    flags, left = scan(spark, rows)
    by_id = {k[2]: r["flag"] for k, r in flags.items()}
    assert by_id == {1: "inversion", 2: "low seasonal", 4: "high seasonal"} | {50 + k: "low stuck" for k in range(10)}
    assert sorted((r["state"], r["field"], r["kind"]) for r in left) == [("A", "low", "season"), ("B", "low", "run")]


def test_each_frost_guard_removes_what_it_alone_can(spark):
    def year(y, extra):
        cold = [(dt.date(y, 1, 1) + k * DAY, 20.0, 25.0) for k in range(60)] + [(dt.date(y, 11, 20) + k * DAY, 20.0, 25.0) for k in range(30)]
        return [("S", d, low, mean) for d, low, mean in [*cold, *extra]]

    rows = year(2001, [])
    rows += year(2002, [(dt.date(2002, 6, 20), 10.0, 60.0), (dt.date(2002, 6, 21), 30.0, 50.0), (dt.date(2002, 6, 22), 31.0, 50.0)])  # spread: only the first goes
    rows += year(2003, [(dt.date(2003, 4, 1) + k * DAY, 25.5, 57.0) for k in range(25)])  # stuck
    rows += year(2004, [(dt.date(2004, 6, 20), 30.0, 50.0)])  # alone
    rows += year(2005, [(dt.date(2005, 6, 20), 30.0, 50.0), (dt.date(2005, 6, 28), 35.0, 50.0)])  # a near frost vouches for it
    rows += year(2006, [(dt.date(2006, 3, 10) + k * DAY, 5.0, 60.0) for k in range(90)])  # half of its frosts go: no date
    rows += [("S", dt.date(2007, 7, 1), 70.0, 70.0)]  # covered, without a frost
    df = spark.createDataFrame(rows, "state string, day date, low double, mean_low double")
    got = {r["year"]: r for r in sensors.frost_years(df, ["state"], "day", "low", "mean_low").collect()}
    assert [(y, got[y]["spread"], got[y]["stuck"], got[y]["alone"], got[y]["kept"]) for y in range(2001, 2008)] == [
        (2001, 0, 0, 0, True), (2002, 1, 0, 0, True), (2003, 0, 25, 0, True), (2004, 0, 0, 1, True), (2005, 0, 0, 0, True), (2006, 90, 0, 0, False), (2007, 0, 0, 0, True),
    ]
    assert got[2001]["last_spring"] == got[2003]["last_spring"] == 60 and got[2004]["last_spring"] == 59  # 29 February counts as the 28th
    assert got[2002]["last_spring"] == 173 and got[2005]["last_spring"] == 171 and got[2007]["last_spring"] is None and got[2007]["frosts"] == 0


def test_a_bad_station_leaves_mean_and_extremes(spark):
    span = days("2003-07-01", 8)
    rows = [("X", f"s{k}", d, 60.0 + k + i % 3, 80.0 + k + i % 2, float(i)) for k in range(4) for i, d in enumerate(span)]
    rows += [("X", "bad", d, 0.0, 81.0, 99.0) for d in span]  # stuck at 0 in July
    rows += [("X", "turned", span[0], 90.0, 50.0, 1.0), ("X", "none", span[0], None, None, 7.0)]
    df = spark.createDataFrame(rows, "area string, station string, day date, low double, high double, rain double")
    both = sensors.with_area_mean(df, ["area"], "day", "low", "high")
    got = {r["day"]: r for r in sensors.rollup(sensors.screened(both, ["area"], "station", "day", "low", "high", readings("low", "high", "area_low", "area_high")), ["area"], "station", "day", "low", "high", "rain").collect()}
    first = got[span[0]]
    assert first["mean_low"] == 61.5 and (first["low"], first["low_station"]) == (60.0, "s0") and (first["high"], first["high_station"]) == (83.0, "s3")
    assert first["stuck"] == 1 and first["inversion"] == 2 and first["stations"] == 5  # bad still counts by its high
    assert (first["most_rain"], first["most_station"]) == (99.0, "bad")
    assert got[span[3]]["mean_low"] == 61.5 and got[span[3]]["low_station"] == "s0"


# --- sun and moon ---


#: Rise and set of the sun on the shortest and longest days as almanacs print them, in minutes UTC.
ALMANAC = [
    ("London", 51.5074, -0.1278, "2024-06-21", 3 * 60 + 43, 20 * 60 + 21), ("New York", 40.7128, -74.006, "2024-12-21", 12 * 60 + 17, 21 * 60 + 32),
    ("Sydney", -33.8688, 151.2093, "2024-06-21", -3 * 60, 6 * 60 + 54), ("Reykjavik", 64.1466, -21.9426, "2024-12-21", 11 * 60 + 22, 15 * 60 + 30),
]


def test_sun_times_are_those_of_the_almanac(spark):
    rows = spark.createDataFrame([(n, a, b, dt.date.fromisoformat(d)) for n, a, b, d, *_ in ALMANAC], "name string, lat double, lng double, day date")
    got = {r["name"]: r["s"] for r in rows.withColumn("s", sky.sun_times(F.col("day"), F.col("lat"), F.col("lng"))).collect()}
    for name, _, _, _, rise, down in ALMANAC:
        assert abs(got[name]["rise"] - rise) < 1.5 and abs(got[name]["set"] - down) < 1.5, (name, got[name])


def test_sun_times_are_where_another_series_crosses_the_horizon(spark):
    """The sun's altitude from its longitude and the sidereal time, minute by minute, against the closed form, which takes the
    declination of noon: within a minute, at 64 degrees within a minute and a half."""
    places = [("a", 51.48, 0.0), ("b", 40.7, -74.0), ("c", -33.9, 151.2), ("d", 0.0, -78.5), ("e", 64.1, -21.9)]
    rows = [(n, lat, lng, d) for (n, lat, lng), d in itertools.product(places, [dt.date(2011, m, 20) for m in range(1, 13)])]
    df = spark.createDataFrame(rows, "place string, lat double, lng double, day date").withColumn("sun", sky.sun_times(F.col("day"), F.col("lat"), F.col("lng")))
    near = df.withColumn("m", F.explode(F.concat(*(F.sequence(F.floor(f"sun.{x}") - 4, F.floor(f"sun.{x}") + 5) for x in ("rise", "set")))))
    near = sky.with_moon(near, F.datediff("day", F.lit("2000-01-01").cast("date")) + F.lit(2451544.5) + F.col("m") / 1440)
    lon, tilt, sin, cos = F.radians("sun_longitude"), F.radians(F.lit(23.4393)), F.sin, F.cos
    ra, dec = F.degrees(F.atan2(sin(lon) * cos(tilt), cos(lon))), F.asin(sin(lon) * sin(tilt))
    up = F.degrees(F.asin(sin(F.radians("lat")) * sin(dec) + cos(F.radians("lat")) * cos(dec) * cos(F.radians(F.col("sidereal") + F.col("lng") - ra))))
    curve = {}
    for r in near.select("place", "day", "m", up.alias("up"), "sun.rise", "sun.set").collect():
        curve.setdefault((r["place"], r["day"], r["rise"], r["set"]), {})[r["m"]] = r["up"] + 0.833
    assert len(curve) == 60
    for (place, _, rise, down), c in curve.items():
        most = 1.5 if place == "e" else 1.0
        crossed = [m - 1 + c[m - 1] / (c[m - 1] - c[m]) for m in c if m - 1 in c and (c[m - 1] < 0) != (c[m] < 0)]
        assert len(crossed) == 2 and abs(min(crossed) - rise) < most and abs(max(crossed) - down) < most


def test_polar_day_and_night(spark):
    rows = spark.createDataFrame([(78.2, dt.date(2024, 6, 21)), (78.2, dt.date(2024, 12, 21)), (-78.2, dt.date(2024, 12, 21)), (78.2, dt.date(2024, 3, 20)), (90.0, dt.date(2024, 6, 21))], "lat double, day date")
    got = [r[0] for r in rows.select(sky.sun_times(F.col("day"), F.col("lat"), F.lit(15.6))).collect()]
    assert [g["state"] for g in got] == ["polar day", "polar night", "polar day", "day", "polar day"]
    assert got[0]["rise"] is None and got[1]["set"] is None and got[3]["rise"] < got[3]["noon"] < got[3]["set"]


def test_moon_phases_are_those_of_the_almanac(spark):
    full, new = ["2024-01-25", "2024-06-22", "2024-12-15", "1999-12-22"], ["2024-01-11", "2024-04-08", "2000-01-06"]
    rows = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in [*full, *new]], "day date")
    got = {str(r["day"]): r for r in sky.moon_state(rows, "day").collect()}
    assert all(abs(got[d]["elongation"] - 180) < 8 and got[d]["lit"] > 0.99 for d in full)
    assert all(min(got[d]["elongation"], 360 - got[d]["elongation"]) < 8 and got[d]["lit"] < 0.01 for d in new)


def test_moon_times_against_a_plain_scan_of_the_curve(spark):
    places = [("a", 40.0, -75.0), ("b", 64.0, -147.0), ("c", -35.0, 149.0), ("d", 0.0, 10.0), ("e", 85.0, 0.0)]
    rows = [(n, lat, lng, d) for (n, lat, lng), d in itertools.product(places, days("2024-05-01", 30))]
    df = spark.createDataFrame(rows, "place string, lat double, lng double, day date")
    fine = df.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1440))))
    fine = sky.with_moon(fine, F.datediff("day", F.lit("2000-01-01").cast("date")) + F.lit(2451544.5) + F.col("m") / 1440)
    up = F.degrees(F.asin(F.sin(F.radians("lat")) * F.sin(F.radians("moon_dec")) + F.cos(F.radians("lat")) * F.cos(F.radians("moon_dec")) * F.cos(F.radians(F.col("sidereal") + F.col("lng") - F.col("moon_ra")))))
    curve = {}
    for r in fine.select("place", "day", "m", up.alias("up")).collect():
        curve.setdefault((r["place"], r["day"]), {})[r["m"]] = r["up"]
    seen = set()
    for r in sky.moon_times(df, ["place"], "day", "lat", "lng").collect():
        c = curve[r["place"], r["day"]]
        rises = [m for m in range(1, 1441) if c[m - 1] <= sky.MOON_HORIZON < c[m]]
        sets = [m for m in range(1, 1441) if c[m - 1] >= sky.MOON_HORIZON > c[m]]
        for name, at in (("rise", rises), ("set", sets)):
            assert (r[name] is None) == (not at) and (not at or abs(r[name] - at[0]) <= 1.5)
            seen.add((name, r[name] is None))
        inner = [m for m in range(1, 1440) if c[m] >= c[m - 1] and c[m] >= c[m + 1]]
        if r["transit"] is not None and inner:
            assert abs(r["transit"] - max(inner, key=c.get)) <= 5
    assert seen == {("rise", True), ("rise", False), ("set", True), ("set", False)}  # days without a rise or a set are there
    windows = sky.solunar_windows(sky.moon_times(df, ["place"], "day", "lat", "lng")).collect()
    assert {(w["kind"], round(w["to_minute"] - w["from_minute"], 6)) for w in windows} == {("major", 120.0), ("minor", 60.0)}


# --- studies ---


def test_distributions_as_columns(spark):
    #: Fixed values of tables: two-sided p of Student's t.
    table = [(2.228, 10.0, 0.05), (2.086, 20.0, 0.05), (12.706, 1.0, 0.05), (1.96, 1e6, 0.05), (3.169, 10.0, 0.01), (0.0, 5.0, 1.0), (-2.776, 4.0, 0.05), (40.0, 3.0, 3.4e-5)]
    got = [r[0] for r in spark.createDataFrame(table, "t double, df double, p double").select(studies.student_two_sided(F.col("t"), F.col("df"))).collect()]
    assert all(abs(g - p) < 2e-4 for g, (_, _, p) in zip(got, table, strict=True))
    z = [-8.0, -1.0, 0.0, 1.0, 1.645, 3.0, 5.9, 6.1, 10.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(studies.normal_upper(F.col("z"))).collect()]
    assert all(abs(g - 0.5 * math.erfc(x / math.sqrt(2))) < 2e-7 for g, x in zip(got, z, strict=True))
    lg = [r[0] for r in spark.createDataFrame([(x,) for x in (0.6, 1.0, 2.5, 10.0, 333.3)], "x double").select(studies.log_gamma(F.col("x"))).collect()]
    assert all(abs(g - math.lgamma(x)) < 1e-9 * max(1, abs(g)) for g, x in zip(lg, (0.6, 1.0, 2.5, 10.0, 333.3), strict=True))


def plain_aftermath(series, d):
    """(recorded, verb, span), and the moves by day."""
    moves = {k: series[d + k * DAY] - series[d] for k in range(1, 8) if d + k * DAY in series}
    if len(moves) < 3:
        return None, None, moves
    low, high = min((m, k) for k, m in moves.items()), min((-m, k) for k, m in moves.items())
    if -low[0] >= 5 and -low[0] >= -high[0]:
        return "cooled", low[1], moves
    return ("warmed", high[1], moves) if -high[0] >= 5 else ("held", None, moves)


def plain_grade(verb, span, moves):
    if verb == "held":
        return 0 if any(abs(m) >= 5 for m in moves.values()) else 1 if len(moves) == 7 else None
    if verb is None:
        return None
    sign = -1 if verb == "cooled" else 1
    if any(sign * m >= 5 for k, m in moves.items() if k <= span):
        return 1
    return 0 if all(k in moves for k in range(1, span + 1)) else None


def plain_pairs(series, treated):
    out = {}
    for d, v in series.items():
        pool, means = [], {}
        for off in range(-3, 4):
            column = []
            for y in range(min(series).year - 1, max(series).year + 2):
                try:
                    p = d.replace(year=y) + off * DAY
                except ValueError:
                    continue
                if p in series and p.year != d.year:
                    column.append((p, series[p]))
            if len(column) >= 5:
                means[off] = sum(x for _, x in column) / len(column)
                pool += [(p, off, x) for p, x in column if abs((p - d).days) > 10]
        if 0 not in means:
            continue
        today = v - means[0]
        arms = {True: None, False: None}
        for p, off, x in pool:
            a = x - means[off]
            if abs(a) < 2 if abs(today) < 2 else ((a > 0) - (a < 0) == (today > 0) - (today < 0) and abs(a - today) <= 5):
                arm = treated(p, d)
                arms[arm] = max(arms[arm] or p, p)
        if arms[True] is None and arms[False] is None:
            continue
        verbs = {k: plain_aftermath(series, p)[:2] if p else (None, None) for k, p in arms.items()}
        moves = plain_aftermath(series, d)[2]
        out[d] = (arms[True], arms[False], verbs[True][0], verbs[False][0], plain_grade(*verbs[True], moves), plain_grade(*verbs[False], moves))
    return out


def test_paired_precedents_against_a_plain_loop(spark):
    r = random.Random(4)
    series = {}
    for y in range(1996, 2006):
        for d in [*days(f"{y}-02-10", 35), *days(f"{y}-12-20", 22)]:  # around 29 February and the turn of the year
            if r.random() < 0.93:
                series[d] = float(r.randrange(20, 36))
    df = spark.createDataFrame([("s", d, v) for d, v in series.items()], "state string, day date, high double")
    a, t = F.col("anomaly"), F.col("today")
    near = F.when(F.abs(t) < 2, F.abs(a) < 2).otherwise((F.signum(a) == F.signum(t)) & (F.abs(a - t) <= 5))
    pairs = studies.paired_precedents(df, ["state"], "day", "high", near, F.dayofmonth("p") % 3 == F.dayofmonth("day") % 3)
    got = {x["day"]: tuple(x[c] for c in ("with_day", "without_day", "with_verb", "without_verb", "with_hit", "without_hit")) for x in pairs.collect()}
    expected = plain_pairs(series, lambda p, d: p.day % 3 == d.day % 3)
    assert got == expected and len(got) > 300
    total = studies.paired_difference(pairs).first()
    graded = [(x[4], x[5]) for x in expected.values() if x[4] is not None and x[5] is not None]
    more, less = sum(x > y for x, y in graded), sum(x < y for x, y in graded)
    assert (total["paired"], total["more"], total["less"]) == (len(graded), more, less) and abs(total["delta"] - (more - less) / len(graded)) < 1e-12
    assert abs(total["p"] - 0.5 * math.erfc((more - less) / math.sqrt(2 * (more + less)))) < 2e-7


@pytest.mark.parametrize("effect", [0.0, 1.5])
def test_placebo_stays_flat_and_a_planted_effect_is_found(spark, effect):
    r = random.Random(21)
    events = [("a", dt.date(2000, 1, 10) + 30 * k * DAY) for k in range(40)]
    fronts = {d for _, d in events}
    other = [("b", events[0][1] + 3 * DAY), ("b", events[1][1] - 3 * DAY), ("b", events[2][1] + 4 * DAY)]  # two of three are within the guard
    rows = [(s, d, r.gauss(0, 1) + (effect if s == "a" and d - DAY in fronts else 0)) for s in "ab" for d in days("2000-01-01", 1300)]
    study = studies.placebo_study(spark.createDataFrame(rows, "state string, day date, z double"), spark.createDataFrame(events + other, "state string, day date"), spark.createDataFrame([("a", "b")], "state string, partner string"), "state", "day", "z")
    tests = {x["lag"]: x for x in studies.placebo_tests(study.where("key = 'a'")).collect()}
    assert [tests[k]["contaminated"] for k in (1, 2, 3)] == [2, 2, 2] and tests[1]["matched_n"] == 40 and tests[1]["placebo_n"] == 38
    assert (tests[1]["matched_p"] < 1e-6) == (effect > 0) and (tests[1]["welch_p"] < 1e-3) == (effect > 0)
    assert all(tests[k]["placebo_p"] > 0.005 for k in (1, 2, 3)) and tests[2]["matched_p"] > 0.005


def battery(spark, signal, seed=3, shifts=7):
    """Breadth that rises before onsets (or not), over seven years."""
    r = random.Random(seed)
    span = days("1992-01-01", 2557)
    onsets = sorted(r.sample(span[60:-20], 30))
    rises = {d - k * DAY for d in onsets for k in range(1, 15)} if signal else set()
    breadth = spark.createDataFrame([(d, r.random() * 0.4 + (0.5 if d in rises else 0), 5) for d in span], "day date, f double, reported int")
    anchors = spark.createDataFrame([(f"o{k}", d) for k, d in enumerate(onsets)], "id string, day date")
    near = lambda lo, hi: anchors.select(F.explode(F.sequence(F.date_add("day", lo), F.date_add("day", hi))).alias("day"))
    windows = studies.onset_windows(studies.rotations(breadth, [], "day", 1992, 1998, range(shifts)), "day", "f", F.col("reported") >= 2)
    each, contrast = studies.onset_contrast(anchors, windows, studies.epoch_controls(anchors, windows, near(-30, 2), 1992, 1998))
    lifts = studies.decile_lift(windows, near(-7, -1), near(0, 2))
    return each, contrast, lifts, anchors.where("id in ('o1', 'o5', 'o9')")


def test_gates_let_a_signal_through_and_stop_noise(spark):
    each, contrast, lifts, roll = battery(spark, True)
    again = battery(spark, True)[1]
    row = studies.gates(each, contrast, lifts, roll, 3, again).first()
    assert row["verdict"] == "signal" and all(row[c] for c in ("floor", "g0", "g2", "g3", "test1", "test2"))
    assert studies.gates(each, contrast, lifts, roll, 3, least_anchors=31).first()["verdict"] == "too few anchors"
    changed = contrast.withColumn("delta", F.col("delta") + 1e-9)
    assert studies.gates(each, contrast, lifts, roll, 3, changed).first()["verdict"] == "not reproducible"
    missing = spark.createDataFrame([("nobody",)], "id string")
    assert studies.gates(each, contrast, lifts, missing, 3).first()["verdict"] == "positive control failed"
    # The observed series and a rotation change places: the negative control then carries the signal.
    turn = F.when(F.col("k") == 0, 3).when(F.col("k") == 3, 0).otherwise(F.col("k"))
    turned = studies.gates(each, contrast.withColumn("k", turn), lifts.withColumn("k", turn), roll, 3).first()
    assert turned["verdict"] == "a test passed on rotated data" and not turned["test1"]
    each, contrast, lifts, roll = battery(spark, False)
    row = studies.gates(each, contrast, lifts, roll, 3).first()
    assert row["verdict"] != "signal" and not (row["test1"] and row["test2"])


def test_rotations_turn_whole_years(spark):
    rows = [(d, float(d.toordinal())) for d in days("1999-01-01", 365 + 366 + 365)]
    got = {(r["k"], r["day"]): dt.date.fromordinal(int(r["v"])) for r in studies.rotations(spark.createDataFrame(rows, "day date, v double"), [], "day", 1999, 2001, [0, 1, 2]).collect()}
    assert all(d == s for (k, d), s in got.items() if k == 0) and len(got) == 3 * 1096
    assert got[1, dt.date(2000, 2, 29)] == dt.date(1999, 2, 28) and got[1, dt.date(1999, 5, 5)] == dt.date(2001, 5, 5) and got[2, dt.date(2001, 2, 28)] == dt.date(1999, 2, 28)


def test_controls_are_near_in_season_and_year_and_never_barred(spark):
    span = days("1992-01-01", 2557)
    windows = spark.createDataFrame([(0, d, 1.0) for d in span], "k int, day date, w double")
    anchors = spark.createDataFrame([("x", dt.date(1995, 3, 1)), ("leap", dt.date(1996, 2, 29))], "id string, day date")
    barred = spark.createDataFrame([(d,) for d in span if d.year in (1994, 1995)], "day date")
    got = studies.epoch_controls(anchors, windows, barred, 1992, 1998).collect()
    x = [r["control"] for r in got if r["id"] == "x"]
    assert len(x) == 8 and all(d.year in (1993, 1996, 1997) for d in x) and all(abs((d.replace(year=1995) - dt.date(1995, 3, 1)).days) <= 16 for d in x if (d.month, d.day) != (2, 29))
    assert {r["control"].year for r in got if r["id"] == "leap"} == {1996}  # only a leap year has the anchor's day
