"""Structured Streaming twins of the scheduled jobs. Each takes and returns a streaming DataFrame (or a batch one:
the same plan then runs over a table, which is what the tests hold it against)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def poll(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    return df.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)


def daily_rollup(df: DataFrame, key: Sequence[str], at: str, value: str, late: str = "2 days") -> DataFrame:
    g = _timed(df, at, late).groupBy(F.window("at", "1 day").alias("w"), *key)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high")).select(F.to_date("w.start").alias("day"), *key, "n", "mean", "high")


def sliding_counts(df: DataFrame, key: Sequence[str], at: str, width: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    g = _timed(df, at, late).groupBy(F.window("at", width, step).alias("w"), *key)
    return g.agg(F.count("*").alias("n")).select(F.to_date("w.end").alias("until"), *key, "n")


def session_episodes(df: DataFrame, key: Sequence[str], at: str, gap_days: int, late: str = "2 days") -> DataFrame:
    """Episodes as sessions: two days join if at most gap_days days are missing between them (the gap is inclusive)."""
    days = df.withColumn("at", F.date_trunc("day", F.col(at).cast("timestamp"))).withWatermark("at", late)
    g = days.groupBy(F.session_window("at", f"{gap_days + 1} days").alias("s"), *key)
    return g.agg(F.count("*").alias("events")).select(*key, F.to_date("s.start").alias("start_day"), F.date_sub(F.to_date("s.end"), gap_days + 1).alias("end_day"), "events")


def first_of_key(df: DataFrame, key: Sequence[str], at: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark: an insert that ignores duplicates."""
    return _timed(df, at, late).dropDuplicatesWithinWatermark(list(key))


def upsert_batches(df: DataFrame, target: str, key: Sequence[str], order: str):
    """A sink that keeps one row a key, the latest by `order`: each micro-batch is reduced to its latest rows and
    written as its own folder, named by the batch number, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return df.writeStream.foreachBatch(write)


def read_upserts(spark: SparkSession, target: str, key: Sequence[str], order: str) -> DataFrame:
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("r")).select("r.*")


LEAD_STATE = "opened timestamp, last timestamp"
LEAD_EVENTS = "key string, action string, at timestamp"


def lead_lifecycle(df: DataFrame, key: str, at: str, fade_after: str = "3 days", late: str = "1 day") -> DataFrame:
    """open when a quiet key fires, refresh while it goes on firing, fade when nothing came for `fade_after` of event
    time: one small state a key, let go by an event-time timer."""
    import pandas as pd

    wait = pd.Timedelta(fade_after)

    def step(k, batches, state):
        opened, last = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "action": ["fade"], "at": [pd.Timestamp(last) + wait]})
            return
        for t in sorted(t for b in batches for t in b["at"]):
            if opened is not None and t - pd.Timestamp(last) > wait:
                out.append(("fade", pd.Timestamp(last) + wait))
                opened = None
            out.append(("open" if opened is None else "refresh", t))
            opened, last = (t if opened is None else opened), t
        state.update((pd.Timestamp(opened).to_pydatetime(), pd.Timestamp(last).to_pydatetime()))
        due = int((pd.Timestamp(last) + wait).timestamp() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "action": [a for a, _ in out], "at": [t for _, t in out]})

    rows = _timed(df, at, late).select(F.col(key).cast("string").alias("key"), "at")
    return rows.groupBy("key").applyInPandasWithState(step, LEAD_EVENTS, LEAD_STATE, "append", "EventTimeTimeout")


def throttle(df: DataFrame, key: str, at: str, hold: str = "48 hours", late: str = "1 day") -> DataFrame:
    """key and at of the alerts that pass: the first of a key, and then none until `hold` after the last one that passed.
    The state is one time a key and goes when the watermark has passed its end."""
    import pandas as pd

    wait = pd.Timedelta(hold)

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        until = pd.Timestamp(state.get[0]) if state.exists else None
        passed = []
        for t in sorted(t for b in batches for t in b["at"]):
            if until is None or t >= until:
                passed.append(t)
                until = t + wait
        state.update((until.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(passed), "at": passed})

    rows = _timed(df, at, late).select(F.col(key).cast("string").alias("key"), "at")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "until timestamp", "append", "EventTimeTimeout")


def due_outcomes(claims: DataFrame, readings: DataFrame, key: str, fired: str, day: str, value: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """Per fire of a key, once the watermark has passed the deadline `days` after it: the days 1 .. days that have a reading
    and those that are holes, with the lowest and highest reading. Until then missing days are pending, and nothing
    is said. A day's reading that comes twice counts once, the latest to come. claims: key and fired; readings: key,
    day and value; both come as one stream of rows, as state is by key."""
    import pandas as pd

    a = claims.select(F.col(key).cast("string").alias("key"), F.lit("fire").alias("kind"), F.to_date(fired).alias("day"), F.lit(None).cast("double").alias("value"))
    b = readings.select(F.col(key).cast("string").alias("key"), F.lit("reading").alias("kind"), F.to_date(day).alias("day"), F.col(value).cast("double").alias("value"))
    rows = a.unionByName(b).where("day is not null").withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", late)

    def step(k, batches, state):
        fires, seen = [], {}
        if state.exists:
            for kind, d, v in zip(*state.get, strict=True):
                if kind == "fire":
                    fires.append(d)
                else:
                    seen[d] = v
        if not state.hasTimedOut:
            for batch in batches:
                for kind, d, v in zip(batch["kind"], batch["day"], batch["value"], strict=True):
                    if kind == "fire":
                        fires.append(d)
                    elif not pd.isna(v):
                        seen[d] = float(v)
        now = state.getCurrentWatermarkMs()
        end = lambda d: int((pd.Timestamp(d) + pd.Timedelta(days=days + 1)).timestamp() * 1000)
        due, fires = [d for d in fires if end(d) <= now], [d for d in fires if end(d) > now]
        out = []
        for d in sorted(set(due)):
            after = [d + pd.Timedelta(days=i) for i in range(1, days + 1)]
            got = [seen[x] for x in after if x in seen]
            out.append((k[0], d, len(got), days - len(got), min(got, default=None), max(got, default=None)))
        # A reading is of use to fires of the days before it that are still open, or may still come within the watermark.
        floor = min([*fires, pd.Timestamp(now, unit="ms").date()])
        seen = {d: v for d, v in seen.items() if d > floor}
        if not fires and not seen:
            state.remove()
        else:
            state.update((["fire"] * len(fires) + ["reading"] * len(seen), [*fires, *seen], [None] * len(fires) + list(seen.values())))
            state.setTimeoutTimestamp(max(now + 1, min(map(end, [*fires, *seen]))))
        yield pd.DataFrame(out, columns=["key", "fired", "recorded", "holes", "low", "high"])

    state = "kinds array<string>, days array<date>, vals array<double>"
    schema = "key string, fired date, recorded int, holes int, low double, high double"
    return rows.groupBy("key").applyInPandasWithState(step, schema, state, "append", "EventTimeTimeout")
