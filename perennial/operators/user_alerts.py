"""Users' own alerts: which are due, and which of those something has fired since.

An alert watches scores that jump, events of some types, scores beyond a bound, or new entries of a type, everywhere or in some states.
Alerts that watch the same thing since the same moment are looked up once. They meet scores by equi-joins on state: an alert without
states has the key EVERYWHERE, and each score is there under its state and under that key. Events and entries are many, and so are
alerts: no alert meets them one by one, but what came after a moment is read off running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.archive import shared_folder
from .ranks import cumulative

EVERYWHERE = "*"
#: alert, trigger (score_spike, weather_event, threshold or new_data), states (null: all), how often it may fire, when it last did, and
#: what it watches; null where a trigger doesn't use it or its usual value is meant.
ALERTS = "alert long, trigger string, states array<string>, every string, last timestamp, min_change double, min_score double, types array<string>, compare string, bound double, content string"


def interval_seconds(text: Column) -> Column:
    """Of "30min", "3hr", "3h" or "2d"; three hours for anything else."""
    number, unit = F.regexp_extract(text, "^(\\d+)(min|hr|h|d)$", 1), F.regexp_extract(text, "^(\\d+)(min|hr|h|d)$", 2)
    size = F.when(unit == "min", 60).when(unit.isin("hr", "h"), 3600).when(unit == "d", 86400)
    return F.coalesce(number.try_cast("long") * size, F.lit(3 * 3600).cast("long"))


def fires(alerts: DataFrame, now: str, jumps: DataFrame, events: DataFrame, scores: DataFrame, entries: DataFrame) -> DataFrame:
    """(alert, trigger, n, states): the due alerts that something fires at a time, with how many rows did and their states.

    An alert is due if it never fired, or as long ago as `every` says. What came after it last fired counts, or else of the last day.
    jumps: state, score, previous, at. events: type, states, at. scores: state, score. entries: content, at."""
    shared_folder(alerts.sparkSession)
    at = F.lit(now).cast("timestamp")
    seconds = lambda a, b: F.unix_micros(a) / 1e6 - F.unix_micros(b) / 1e6
    due = alerts.where(F.col("last").isNull() | (seconds(at, F.col("last")) >= interval_seconds(F.coalesce("every", F.lit("3hr")))))
    due = due.where("states is null or size(states) > 0").withColumn("since", F.coalesce("last", at - F.expr("interval 24 hours")))
    due = due.groupBy("alert", F.struct("trigger", "states", "since", "min_change", "min_score", "types", "compare", "bound", "content").alias("what")).agg(F.lit(1).alias("_"))
    watches = due.select("what").distinct().withColumn("watch", F.monotonically_increasing_id()).checkpoint()
    of = lambda trigger: watches.where(F.col("what.trigger") == trigger).select("watch", "what.*")
    by_state = lambda df: df.withColumn("key", F.explode(F.coalesce("states", F.array(F.lit(EVERYWHERE)))))
    keyed = lambda df: df.withColumn("key", F.explode(F.array("state", F.lit(EVERYWHERE))))

    high, moved = F.col("score") >= F.coalesce("min_score", F.lit(60.0)), F.abs(F.col("score") - F.col("previous")) >= F.coalesce("min_change", F.lit(15.0))
    spikes = by_state(of("score_spike")).join(keyed(jumps), "key").where((F.col("at") > F.col("since")) & high & moved).select("watch", "state", F.xxhash64("state", "score", "previous", "at").alias("row"))
    bound, op = F.coalesce("bound", F.lit(75.0)), F.coalesce("compare", F.lit(">="))
    score = F.col("score")
    beyond = F.when(op == ">=", score >= bound).when(op == "<=", score <= bound).when(op == ">", score > bound).when(op == "<", score < bound).otherwise(True)
    bounds = by_state(of("threshold")).join(keyed(scores), "key").where(beyond).select("watch", "state", F.xxhash64("state", "score").alias("row"))
    found = spikes.unionByName(bounds).groupBy("watch").agg(F.countDistinct("row").alias("n"), F.array_sort(F.collect_set("state")).alias("states"))

    # What may count: different events by type and states, and by type alone for those who watch everywhere; entries by type.
    least = watches.agg(F.min("what.since").alias("_least"))  # one row
    recent = lambda df: df.crossJoin(F.broadcast(least)).where(F.col("at") > F.col("_least")).drop("_least")
    everywhere = F.struct(F.lit(True).alias("all"), F.lit(None).cast("array<string>").alias("states"))
    rows = recent(events.select("type", "states", "at")).distinct()
    point = lambda kind, name, place, count: (F.lit(kind).alias("kind"), F.col(name).alias("name"), place.alias("place"), F.unix_micros("at").alias("at"), count.alias("count"))
    one = F.lit(1).cast("long")
    points = rows.select(*point("event", "type", F.struct(F.lit(False).alias("all"), "states"), one)).unionByName(rows.select(*point("event", "type", everywhere, one)))
    points = points.unionByName(recent(entries.select("content", "at")).select(*point("entry", "content", everywhere, one))).where("name is not null")

    # Who asks for which of them. A place is the states of an event; a watch with states asks for the places that hold one of them.
    usual = F.array(F.lit("cold_front"), F.lit("pressure_drop"))
    watched = of("weather_event").withColumn("name", F.explode(F.array_distinct(F.coalesce("types", usual))))
    places = rows.select(F.col("type").alias("name"), "states", "at").groupBy("name", F.struct(F.lit(False).alias("all"), "states").alias("place")).agg(F.max("at").alias("latest"))
    held = places.withColumn("key", F.explode_outer(F.array_distinct("place.states"))).withColumn("key", F.coalesce("key", F.lit("")))
    local = by_state(watched.where("states is not null")).join(held, ["name", "key"]).groupBy("watch", "name", "since", "place").agg(F.collect_set(F.nullif("key", F.lit(""))).alias("seen"))
    latest = held.where("key <> ''").groupBy("name", "key").agg(F.max("latest").alias("latest")).groupBy("name").agg(F.collect_list(F.struct("key", "latest")).alias("_latest"))  # a state each
    after = F.transform(F.filter("_latest", lambda x: x["latest"] > F.col("since")), lambda x: x["key"])
    wide = watched.where("states is null").join(latest, "name", "left").select("watch", "name", "since", everywhere.alias("place"), F.coalesce(after, F.array().cast("array<string>")).alias("seen"))
    fresh = of("new_data").select("watch", F.coalesce("content", F.lit("migration-spike")).alias("name"), "since", everywhere.alias("place"), F.array().cast("array<string>").alias("seen"))
    asked = local.unionByName(wide).withColumn("kind", F.lit("event")).unionByName(fresh.withColumn("kind", F.lit("entry"))).withColumn("at", F.unix_micros("since"))

    key = ["kind", "name", "place"]
    counts = cumulative(points.unionByName(asked.select(*key, "at", F.lit(0).cast("long").alias("count")).distinct()), "at", F.col("count"), key=key)
    counts = asked.join(counts.select(*key, "at", (F.col("ge") - F.col("c")).alias("after")), [*key, "at"]).where("after > 0")
    found = found.unionByName(counts.groupBy("watch").agg(F.sum("after").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("states")))
    return due.select("alert", "what").join(watches, "what").join(found, "watch").select("alert", "what.trigger", "n", "states")
