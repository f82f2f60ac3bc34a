"""Convergence: eleven capped domain scores of a place and day, and signatures of climate indices.

What a place last said in each domain is found for all domains in one pass: readings of all kinds and the asked days lie in one ordered
series a place, and each asked day takes the last reading of each kind before it. Events and alerts are dealt to the days they count
for, so that they meet the asked days by an equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up

#: Points of weather events by type, and of alerts by the first of these words in their type.
EVENT_POINTS = {"cold_front": 15, "pressure_drop": 10, "high_wind": 5, "first_freeze": 10, "heavy_precip": 5}
ALERT_POINTS = (("winter storm", 10), ("wind", 5), ("freeze", 8), ("flood", 8), ("fire", 8))

#: Largest score of each domain, in the order of the total; the total is a share of FULL.
CAPS = {"weather": 20, "biological": 15, "lunar": 10, "water": 15, "drought": 15, "air": 15, "soil": 10, "ocean": 10, "space": 10, "photoperiod": 8, "tide": 8}
FULL = 120

#: Fields of the readings that are looked up as of the day, by domain.
READINGS = {
    "water": "trend string", "river": "flow string", "drought": "class string, d2 double", "air": "aqi double", "soil": "temp double, moisture double",
    "ocean": "waves double, water_temp double", "photoperiod": "below_13h boolean, below_11h boolean", "tide": "range double",
}


def _ladder(steps: Sequence[tuple[Column, int]], otherwise: int | Column = 0) -> Column:
    """Points of the first step that holds; a step on a missing value doesn't."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for when, points in reversed(steps):
        out = F.when(F.coalesce(when, F.lit(False)), points).otherwise(out)
    return out


def weather_points(types: Column, alerts: Column) -> Column:
    """Of the sets of event types and of alert types (lower case)."""
    events = sum((F.when(F.array_contains(types, t), p).otherwise(0) for t, p in EVENT_POINTS.items()), F.lit(0))
    one = lambda a: _ladder([(F.contains(a, F.lit(word)), p) for word, p in ALERT_POINTS])
    return F.coalesce(events, F.lit(0)) + F.coalesce(F.aggregate(F.transform(alerts, one), F.lit(0), lambda s, x: s + x), F.lit(0))


def biological_points(deviation: Column, high: Column, birds: Column) -> Column:
    spikes = _ladder([(deviation > 100, 15), (deviation > 50, 10), (deviation > 25, 5)])
    return spikes + _ladder([(high, 5)]) + _ladder([(birds > 1_000_000, 5), (birds > 100_000, 2)])


def lunar_points(lit_percent: Column) -> Column:
    return F.when(lit_percent.isNull(), 0).otherwise(_ladder([(lit_percent < 5, 10), (lit_percent < 15, 5), (lit_percent > 95, 8)], 2))


def water_points(water: Column, river: Column) -> Column:
    level = _ladder([(water["trend"] == "rising", 8), (water["trend"] == "stable", 3), (water["trend"] == "falling", 5)])
    flow = river["flow"]
    return level + F.when(river.isNull(), 0).otherwise(_ladder([(flow.isin("flood", "flood conditions"), 7), (flow.isin("elevated", "elevated flow"), 4), (flow.isin("low flow", "drought conditions"), 5)], 1))


def drought_points(d: Column) -> Column:
    """By class or by the share in severe drought, whichever is worse; either may be missing."""
    kind, share = F.coalesce(d["class"], F.lit("")), F.coalesce(d["d2"], F.lit(0.0))
    steps = [((kind == "exceptional_drought") | (share > 50), 15), ((kind == "extreme_drought") | (share > 25), 12), (kind == "severe_drought", 10), (kind == "moderate_drought", 7), (kind == "abnormally_dry", 4), (kind == "normal", 1)]
    return F.when(d.isNull(), 0).otherwise(_ladder(steps, 2))


def air_points(a: Column) -> Column:
    return F.when(a.isNull(), 0).otherwise(_ladder([(a["aqi"] > 200, 15), (a["aqi"] > 150, 12), (a["aqi"] > 100, 8), (a["aqi"] > 50, 4)], 1))


def soil_points(s: Column) -> Column:
    points = _ladder([((s["temp"] < 0) | (s["temp"] > 35), 5)]) + _ladder([((s["moisture"] < 0.1) | (s["moisture"] > 0.5), 5)])
    return F.when(s.isNull(), 0).when(points == 0, 2).otherwise(points)


def ocean_points(o: Column, coastal: Column) -> Column:
    points = _ladder([(o["waves"] > 3, 7), (o["waves"] > 1.5, 4)], 1) + _ladder([(o["water_temp"] > 0, 2)])
    return F.when(o.isNull() | ~coastal, 0).otherwise(points)


def space_points(s: Column) -> Column:
    storm = ~s["storm"].isin("none", "quiet")
    return F.when(s.isNull(), 0).otherwise(_ladder([(storm, 10), (s["kp"] >= 5, 10), (s["kp"] >= 4, 6), (s["kp"] >= 3, 3)], 1))


def photoperiod_points(p: Column) -> Column:
    return _ladder([(p["below_13h"] & ~p["below_11h"], 8), (p["below_11h"], 5)], 2)


def tide_points(t: Column, coastal: Column) -> Column:
    return F.when(~coastal, 0).otherwise(_ladder([(t["range"] > 6, 8), (t["range"] >= 3, 5)], 2))


def as_of(asked: DataFrame, feeds: Mapping[str, DataFrame], place: str, day: str) -> DataFrame:
    """The asked rows (place, day) with one struct for each feed: the fields of its last reading of the place on or before the day, null
    if there is none. A feed has place, day and its fields; of several readings of a day the last one by fields counts."""
    rows = asked.select(place, day, F.lit(1).alias("_side"))
    for name, feed in feeds.items():
        fields = [c for c in feed.columns if c not in (place, day)]
        daily = feed.groupBy(place, day).agg(F.max(F.struct(*fields)).alias(name)).withColumn("_side", F.lit(0))
        rows = rows.unionByName(daily, allowMissingColumns=True)
    w = Window.partitionBy(place).orderBy(day, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in feeds}).where("_side = 1").drop("_side")


def domain_scores(asked: DataFrame, feeds: Mapping[str, DataFrame], events: DataFrame, alerts: DataFrame, spikes: DataFrame, birds: DataFrame, lit: Column, space: DataFrame, place: str = "state", day: str = "day", ahead: int = 3) -> DataFrame:
    """Per asked place and day the eleven domain scores, each within its cap, `active` (how many domains are at work), and the total: the
    sum as a share of FULL, 0 to 100, halves up.

    asked: place, day, coastal. feeds: by name of READINGS. events: place, day, type, counted from `ahead` days before. alerts: place,
    onset, expires, type, counted on each day between. spikes: place, day, deviation, for seven days. birds: place, day, high, birds, the
    last of four days. lit: per cent of the moon, over the day. space: day, storm, kp, the same for all places."""
    on = [place, day]
    days = F.sequence(F.date_sub(day, ahead), day)
    types = events.select(place, F.explode(days).alias(day), "type").groupBy(*on).agg(F.collect_set("type").alias("types"))
    warned = alerts.select(place, F.explode(F.sequence("onset", "expires")).alias(day), F.lower("type").alias("type")).groupBy(*on).agg(F.collect_set("type").alias("warned"))
    top = spikes.select(place, F.explode(F.sequence(day, F.date_add(day, 7))).alias(day), "deviation").groupBy(*on).agg(F.max("deviation").alias("deviation"))
    seen = birds.select(place, F.col(day).alias("_seen"), F.explode(F.sequence(day, F.date_add(day, 3))).alias(day), "high", "birds")
    seen = seen.groupBy(*on).agg(F.max(F.struct("_seen", "high", "birds")).alias("flight"))
    rows = as_of(asked, feeds, place, day).join(asked, on)
    for part in (types, warned, top, seen):
        rows = rows.join(part, on, "left")
    # The global series has one row a day.
    sky = as_of(asked.select(F.lit("all").alias("_p"), day).distinct(), {"space": space.withColumn("_p", F.lit("all"))}, "_p", day).drop("_p")
    rows = rows.join(sky, day)
    none = F.array().cast("array<string>")
    points = {
        "weather": weather_points(F.coalesce("types", none), F.coalesce("warned", none)), "biological": biological_points(F.col("deviation"), F.col("flight.high"), F.col("flight.birds")), "lunar": lunar_points(lit),
        "water": water_points(F.col("water"), F.col("river")), "drought": drought_points(F.col("drought")), "air": air_points(F.col("air")), "soil": soil_points(F.col("soil")), "ocean": ocean_points(F.col("ocean"), F.col("coastal")),
        "space": space_points(F.col("space")), "photoperiod": photoperiod_points(F.col("photoperiod")), "tide": tide_points(F.col("tide"), F.col("coastal")),
    }
    capped = {f"{name}_score": F.least(F.greatest(c, F.lit(0)), F.lit(CAPS[name])) for name, c in points.items()}
    rows = rows.select(*on, *(c.alias(name) for name, c in capped.items()))
    total = sum((F.col(c) for c in capped), F.lit(0))
    #: A domain is at work above 5 points, soil above 4, space above 3.
    bar = lambda name: {"soil": 4, "space": 3}.get(name, 5)
    active = sum(((F.col(f"{name}_score") > bar(name)).cast("int") for name in points), F.lit(0))
    return rows.withColumns({"active": active, "score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), round_half_up(total * 100 / FULL)))})


# --- signatures ---


def recent_values(values: DataFrame, index: str, month: str, value: str, last: int = 8, months: int = 12) -> DataFrame:
    """(month, index, v): for each month with any value, by index (upper case) the last values up to it within `months` months, the newest
    first, at most `last`. Values of -9 and less are none. A value goes to the months it is recent for, so nothing is joined by range."""
    number = F.year(month) * 12 + F.month(month) - 1
    kept = values.where(F.col(value) > -9).select(F.upper(index).alias("index"), number.alias("n"), F.col(value).cast("double").alias("v"))
    spread = kept.withColumn("_at", F.explode(F.sequence(F.col("n"), F.col("n") + months - 1)))
    there = kept.select(F.col("n").alias("_at")).distinct()
    held = spread.join(there, "_at", "left_semi").groupBy("_at", "index").agg(F.sort_array(F.collect_list(F.struct("n", "v")), asc=False).alias("p"))
    at = F.make_date((F.floor(F.col("_at") / 12)).cast("int"), (F.col("_at") % 12 + 1).cast("int"), F.lit(1))
    return held.select(at.alias("month"), "index", F.slice(F.col("p.v"), 1, last).alias("v"))


def _count(v: Column, test) -> Column:
    return F.size(F.filter(v, test))


def signatures(recent: DataFrame, least: int = 20) -> DataFrame:
    """(month, signature, confidence, conditions) of the rule sets whose confidence reaches `least`, from the recent values of the indices
    AO, NAO, ENSO and PDO. An index without values meets no condition, but its mean counts as 0 where a rule asks for one."""
    names = ("AO", "NAO", "ENSO", "PDO")
    wide = recent.groupBy("month").agg(*(F.coalesce(F.first(F.when(F.col("index") == n, F.col("v")), ignorenulls=True), F.array().cast("array<double>")).alias(n.lower()) for n in names))
    ao, nao, enso, pdo = (F.col(n.lower()) for n in names)
    mean = F.aggregate(enso, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(enso))
    wild = F.filter(F.transform(pdo, F.abs), lambda x: x < 9)
    #: Each condition is a ladder of (bound met, points, name); the first step that holds counts.
    rules = {
        "cold outbreak": [
            [(F.array_min(ao) < -2.0, 40, "AO extreme"), (F.array_min(ao) < -1.5, 25, "AO crash"), (F.array_min(ao) < -1.0, 10, "AO negative")],
            [(_count(ao, lambda x: x < -1.0) >= 2, 20, "AO stays negative")],
            [(F.array_min(nao) < -1.5, 15, "NAO crash"), (F.array_min(nao) < -1.0, 5, "NAO negative")],
            [(F.array_min(enso) < -1.0, 15, "La Nina"), (F.array_min(enso) < -0.5, 5, "ENSO falls")],
        ],
        "hurricane season": [
            [(_count(pdo, lambda x: F.abs(x) > 1.5) >= 3, 35, "PDO extreme for months"), (_count(pdo, lambda x: F.abs(x) > 1.5) >= 1, 15, "PDO extreme")],
            [(F.array_max(wild) > 2.5, 15, "PDO peak")],
            [(mean < -0.5, 15, "La Nina behind"), (F.abs(mean) < 0.3, 5, "ENSO neutral")],
            [(_count(nao, lambda x: x < -0.5) >= 3, 15, "NAO trends negative")],
        ],
        "flooding": [
            [(F.array_max(enso) > 1.5, 30, "strong El Nino"), (F.array_max(enso) > 1.0, 15, "El Nino"), (F.array_max(enso) > 0.5, 5, "weak El Nino")],
            [(_count(pdo, lambda x: (x > 1.5) & (x < 9)) >= 2, 25, "PDO warm")],
            [(F.array_min(nao) < -1.5, 20, "NAO crash")],
        ],
        "drought": [
            [(_count(enso, lambda x: x < -0.5) >= 4, 30, "La Nina lasts"), (_count(enso, lambda x: x < -0.5) >= 2, 15, "La Nina begins")],
            [(_count(pdo, lambda x: x < -1.0) >= 3, 25, "PDO negative")],
            [((F.size(ao) >= 3) & (F.array_max(ao) - F.array_min(ao) > 3.0), 20, "AO swings")],
        ],
    }
    found = []
    for name, ladders in rules.items():
        points = sum((_ladder([(when, p) for when, p, _ in steps]) for steps in ladders), F.lit(0))
        said = []
        for steps in ladders:
            word = F.lit(None).cast("string")
            for when, _, text in reversed(steps):
                word = F.when(F.coalesce(when, F.lit(False)), text).otherwise(word)
            said.append(word)
        found.append(F.struct(F.lit(name).alias("signature"), F.least(F.lit(100), points).alias("confidence"), F.array_compact(F.array(*said)).alias("conditions")))
    return wide.select("month", F.explode(F.array(*found)).alias("s")).select("month", "s.*").where(F.col("confidence") >= least)
