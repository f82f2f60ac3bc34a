"""Closed forms, conventions and edge cases of the operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perennial.functions import calendars as cal
from perennial.functions import numbers as num
from perennial.operators import frames, joins, pools, series, vectors
from perennial.operators import statistics as st
from perennial.sources import archive


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_day_of_year_conventions(spark):
    d = F.lit("2000-02-29").cast("date")
    assert [one(spark, f(d)) for f in (cal.doy_common, cal.doy_leap, cal.doy_index, cal.doy_frost)] == [60, 60, 59, 59]
    assert one(spark, cal.doy_common(F.lit("2001-03-01").cast("date"))) == 60
    assert one(spark, cal.doy_leap(F.lit("2001-03-01").cast("date"))) == 61
    assert one(spark, cal.doy_offset(F.lit("2001-12-31").cast("date"), F.lit("2005-01-01").cast("date"))) == 1


def test_rounding_and_readings(spark):
    assert one(spark, num.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, num.reading(F.lit(-99.0), sentinels=[-99.0])) is None
    assert one(spark, num.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, num.magnitude(F.lit("1.5M"))) == 1_500_000
    assert one(spark, num.compass(F.lit(359.0))) == "N"


def test_fisher_closed_forms(spark):
    rows = [(4, 0, 0, 4), (3, 1, 1, 3), (11, 3, 1, 9), (0, 10, 5, 5)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(st.fisher_greater("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([1 / 70, 17 / 70, 3731 / 2704156, 1.0], abs=1e-9)


def test_wilson_and_near_miss(spark):
    w = {k: one(spark, v) for k, v in st.wilson(F.lit(5.0), F.lit(10.0)).items()}
    assert (w["lo"], w["hi"], w["mid"]) == pytest.approx((0.2366, 0.7634, 0.5), abs=5e-4)
    assert one(spark, st.wilson(F.lit(0.0), F.lit(0.0))["hi"]) == 1
    cases = [((40, 20, 60, 6, 0.05), 5.0, "FUSION"), ((40, 8, 60, 12, 0.05), 1.0, "DECORATION"), ((10, 5, 50, 0, 0.02), 25.0, "FUSION"), ((1, 1, 3, 0, 0.05), 6.0, "DECORATION"), ((0, 0, 50, 5, 0.05), 0.0, "DECORATION")]
    df = spark.createDataFrame([c[0] for c in cases], "f int, h int, nf int, nh int, b double")
    got = df.select(*(v.alias(k) for k, v in st.near_miss(*map(F.col, ("f", "h", "nf", "nh", "b"))).items())).collect()
    assert [r["verdict"] for r in got] == [c[2] for c in cases]
    assert [r["ratio"] for r in got] == pytest.approx([c[1] for c in cases])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, 1, p) for i, p in enumerate([0.2, 0.01, 0.04, 0.03, 0.02])], "i int, f int, p double")
    got = st.benjamini_hochberg(df, "p", ["f"], ["i"]).where("rejected").agg(F.max("p")).first()[0]
    assert got == 0.04


def test_theil_sen(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(6)] + [("b", float(x), 7.0) for x in range(4)], "k string, x double, y double")
    got = {r["k"]: (r["slope"], r["intercept"]) for r in st.theil_sen(df, ["k"], "x", "y").collect()}
    assert got == {"a": (2.0, 1.0), "b": (0.0, 7.0)}


def _days(spark, *rows):
    return spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=n), v) for k, n, v in rows], "k string, day date, v double")


def test_series_edges(spark):
    df = _days(spark, ("a", 0, 1.0), ("a", 1, 2.0), ("a", 3, 5.0), ("a", 3, 5.0), ("a", 9, None))
    gaps = {(r["day"].day, r["delta"]) for r in series.gap_delta(df.distinct(), ["k"], "day", "v").collect()}
    assert gaps == {(1, None), (2, 1.0), (4, None), (10, None)}
    runs = series.episodes(df, ["k"], "day", 1).orderBy("start_day").collect()
    assert [(r["start_day"].day, r["end_day"].day, r["matched_days"]) for r in runs] == [(1, 4, 3), (10, 10, 1)]
    assert series.episodes(df.limit(0), ["k"], "day", 1).count() == 0
    full = {r["day"].day: r["v"] for r in series.densify(df.distinct().where("v is not null"), ["k"], "day", "v").collect()}
    assert full[3] == pytest.approx(3.5)


def test_interval_join_is_the_plain_one(spark):
    a = spark.createDataFrame([(i, i % 3, dt.date(2024, 1, 1) + dt.timedelta(days=(i * 7) % 40)) for i in range(60)] + [(99, 1, None)], "i int, k int, d date")
    b = spark.createDataFrame([(i, i % 3, dt.date(2024, 1, 1) + dt.timedelta(days=(i * 5) % 45)) for i in range(60)] + [(98, 1, None)], "j int, k int, e date")
    for lo, hi in ((-3, 3), (1, 14), (0, 0), (-10, -2)):
        got = joins.interval_join(a, b, ["k"], "d", "e", lo, hi).select("i", "j").collect()
        want = a.join(b, "k").where(F.datediff("e", "d").between(lo, hi)).select("i", "j").collect()
        assert sorted(got) == sorted(want)


def test_tail_depth_rules(spark):
    rows = [("a", dt.date(y, 6, 1), float(v)) for y, v in zip(range(2000, 2012), [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], strict=True)]
    df = spark.createDataFrame([*rows, ("a", dt.date(2012, 6, 1), None)], "k string, day date, v double")
    got = {r["v"]: (r["pct"], r["won"], r["low_confidence"]) for r in pools.tail_depth(df, ["k"], "day", "v").collect()}
    assert got[1.0] == (1.0, "low", False) and got[2.0] == (0.917, "low", False) and got[11.0] == (0.917, "high", False)
    thin = pools.tail_depth(df.where("year(day) < 2005"), ["k"], "day", "v").agg(F.max("pct")).first()[0]
    assert thin == 0.6


def test_frames_round_trip_and_refuse(spark):
    rows = [(dt.date(2024, 1, d), s, (d * 37 + s * 11) % 255) for d in range(1, 4) for s in range(5) if (d + s) % 4]
    slots = spark.createDataFrame(rows, "day date, slot int, byte int")
    back = frames.unpack(frames.pack(slots, "day", "slot", "byte", 5), "day", "dots").where("byte is not null")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(Exception, match="not a packed frame"):
        frames.unpack(spark.createDataFrame([("x", "0G1")], "day string, dots string"), "day", "dots").collect()


def test_vectors_refuse_zero_and_unequal(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = vectors.search(df, df.where("vec_id = 1"), 5).collect()
    assert [(r["id"], round(r["similarity"], 6)) for r in got] == [(4, 0.707107)]


def test_series_codec_round_trip(spark):
    df = _days(spark, ("a", 0, 1.25), ("a", 1, -2.5), ("a", 4, 0.0), ("b", 2, 100.0))
    back = archive.decode_series(archive.encode_series(df, ["k"], "day", "v"), ["k"], "day", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_archive_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    batch = spark.createDataFrame([(2, "new"), (3, "y"), (3, "y")], "id long, t string")
    assert sorted(r[0] for r in archive.append_new(df, batch, ["id"]).collect()) == [3]
    assert sorted(r[0] for r in archive.upsert(df, batch.distinct(), ["id"]).collect()) == [1, 2, 3]
    assert archive.export_ndjson(df, str(tmp_path / "out")).first().asDict() == {"faithful": True, "rows": 2}
    changed = archive.table_digest(df.withColumn("t", F.lit("x"))).first()
    assert changed["digest"] != archive.table_digest(df).first()["digest"]


def test_union_find_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    archive.shared_folder(spark)
    got = {r["id"]: r["label"] for r in st.union_find(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100


def test_union_find_ends_in_few_rounds_on_winding_clusters(spark, monkeypatch):
    import random

    archive.shared_folder(spark)
    rng = random.Random(5)
    # Paths whose ids go up and down: a label that only moves from neighbour to neighbour needs as many rounds as a path has ids.
    names = rng.sample(range(10_000), 900)
    links = [(a, b) for k in range(0, 900, 300) for a, b in zip(names[k : k + 299], names[k + 1 : k + 300])]
    want = {n: min(names[k : k + 300]) for k in range(0, 900, 300) for n in names[k : k + 300]}
    edges = spark.createDataFrame([*links, (20_000, 20_000), (None, 3), (links[0][1], links[0][0])], "a long, b long")
    frame, rounds = type(edges), []
    plain = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: rounds.append(1) or plain(self, *a))
    for most in (1 << 19, 64):
        monkeypatch.setattr(st, "LINKS", most, raising=False)
        rounds.clear()
        got = {r["id"]: r["label"] for r in st.union_find(edges).collect()}
        assert {k: v for k, v in got.items() if k in want} == want and got[20_000] == 20_000
        assert set(got) - set(want) <= {20_000, 3}
        assert len(rounds) < 24


def test_codec_refuses_what_it_would_round(spark):
    from perennial.sources import archive

    for v in (1.23456, 0.00049, 40.0001):
        df = spark.createDataFrame([("a", dt.date(2024, 1, 1), v)], "k string, day date, v double")
        with pytest.raises(Exception, match="decimals"):
            archive.encode_series(df, ["k"], "day", "v").collect()


def test_cumulative_is_the_plain_count(spark):
    from perennial.operators import statistics as st
    from perennial.sources import archive

    archive.shared_folder(spark)
    values = [float(v) for v in (5, 5, 5, 5, 1, 2, 2, 9, -3, 0, 0)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    want = {v: (known.count(v), sum(x <= v for x in known), sum(x >= v for x in known)) for v in known}
    for parts in (2, 5, 64):
        assert {r["v"]: (r["c"], r["le"], r["ge"]) for r in st.cumulative(df, "v", parts=parts).collect()} == want
    assert st.cumulative(df.limit(0), "v").count() == 0
