"""Streaming twins against the batch result of the same plan."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perennial.operators import series
from perennial.streaming import pipelines as st

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def files(spark, tmp_path):
    """The events in time order as three files, which arrive one by one."""
    rows = spark.read.parquet(EVENTS)
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01"))):
        rows.where(F.to_date("ts").between(a, F.date_sub(F.lit(b).cast("date"), 1))).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    return str(tmp_path / "part*")


def drain(spark, df, tmp_path, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rollups_and_sessions_match_batch(spark, files, tmp_path):
    table = spark.read.parquet(EVENTS)
    live = st.poll(spark, files, table.schema, 1)
    for name, f in (("d", lambda x: st.daily_rollup(x, ["event_type"], "ts", "value")), ("s", lambda x: st.sliding_counts(x, ["event_type"], "ts"))):
        got, want = drain(spark, f(live), tmp_path, name), f(table)
        rounded = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect())
        assert rounded(got) == rounded(want)
    errors = "event_type = 'error' and user_id < 20"
    got = drain(spark, st.session_episodes(live.where(errors), ["user_id"], "ts", 1), tmp_path, "e", "complete")
    want = series.episodes(table.where(errors).withColumn("day", F.to_date("ts")), ["user_id"], "day", 1)
    assert sorted(map(tuple, got.drop("events").collect())) == sorted(map(tuple, want.drop("matched_days").collect()))


def test_upserts_survive_a_replay(spark, files, tmp_path):
    table = spark.read.parquet(EVENTS)
    target = str(tmp_path / "target")
    for _ in range(2):
        q = st.upsert_batches(st.poll(spark, files, table.schema, 1), target, ["user_id"], "event_id").option("checkpointLocation", str(tmp_path / f"cp{_}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = st.read_upserts(spark, target, ["user_id"], "event_id").select("user_id", "event_id")
    want = table.groupBy("user_id").agg(F.max("event_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lead_lifecycle(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    for k, rows in enumerate(([("a", day(1)), ("a", day(2))], [("a", day(9)), ("b", day(10))], [("c", day(25))], [("c", day(26))])):
        spark.createDataFrame(rows, "lead string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    live = st.poll(spark, str(tmp_path / "in/p*"), spark.read.parquet(str(tmp_path / "in/p0")).schema, 1)
    got = drain(spark, st.lead_lifecycle(live, "lead", "ts"), tmp_path, "leads", "append")
    assert sorted((r["key"], r["at"].day, r["action"]) for r in got.collect()) == [("a", 1, "open"), ("a", 2, "refresh"), ("a", 5, "fade"), ("a", 9, "open"), ("a", 12, "fade"), ("b", 10, "open"), ("b", 13, "fade"), ("c", 25, "open"), ("c", 26, "refresh")]


def test_throttle(spark, tmp_path):
    at = lambda n, h=0: dt.datetime(2024, 1, n, h)
    for k, rows in enumerate(([("a", at(1)), ("a", at(2)), ("a", at(3)), ("b", at(2))], [("a", at(4)), ("a", at(5, 1)), ("b", at(4))], [("c", at(20))], [("a", at(21))])):
        spark.createDataFrame(rows, "lead string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    live = st.poll(spark, str(tmp_path / "in/p*"), spark.read.parquet(str(tmp_path / "in/p0")).schema, 1)
    got = drain(spark, st.throttle(live, "lead", "ts"), tmp_path, "throttled", "append")
    assert sorted(map(tuple, got.collect())) == [("a", at(1)), ("a", at(3)), ("a", at(5, 1)), ("a", at(21)), ("b", at(2)), ("b", at(4)), ("c", at(20))]


def test_due_outcomes_wait_for_pending_days(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    schema = "state string, fired date, day date, value double"
    parts = (
        [("a", day(1), None, None), ("b", day(2), None, None), ("a", None, day(2), 5.0)],
        [("a", None, day(4), 1.0), ("a", None, day(8), 9.0), ("a", None, day(9), 99.0)],
        [("c", None, day(20), 0.0)],
        [("c", day(21), None, None)],
    )
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    live = st.poll(spark, str(tmp_path / "in/p*"), spark.read.parquet(str(tmp_path / "in/p0")).schema, 1)
    got = drain(spark, st.due_outcomes(live.where("fired is not null"), live.where("day is not null"), "state", "fired", "day", "value"), tmp_path, "due", "append")
    # Days 2, 4 and 8 of a's week are recorded and four are holes; b has holes only; c's week is still pending.
    assert sorted(map(tuple, got.collect())) == [("a", day(1), 3, 4, 1.0, 9.0), ("b", day(2), 0, 7, None, None)]
