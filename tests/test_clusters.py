"""Vector lists, greedy anchors, arcs, polygons, tides and the moon."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perennial.functions import sky
from perennial.operators import ann, clusters, quality, scoring, vectors

DAY = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def test_list_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0")
    centres = ann.fit(e, 20)
    indexed = ann.assign(e, centres)
    assert indexed.where("list is null").count() == 0
    exact = {(r["query_id"], r["id"]) for r in vectors.search(e, queries, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in ann.search(indexed, queries, centres, 10, 15).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_best_so_far_is_the_plain_order(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    best, entries = vectors.Best(3, 4), []
    for _ in range(60):
        part = [(rng.randrange(3), rng.randrange(-5, 6) * 10**8, rng.randrange(1000)) for _ in range(rng.randrange(9))]
        entries += part
        best.add(*(np.array([e[k] for e in part], np.int64) for k in range(3)))
        want = [(q, s, i, r) for q in range(3) for r, (s, i) in enumerate(sorted(((s, i) for p, s, i in entries if p == q), key=lambda e: (-e[0], e[1]))[:4], 1)]
        assert list(zip(*(x.tolist() for x in best.best()), strict=True)) == want


def test_list_search_makes_no_row_for_each_pair(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    centres = ann.fit(e, 8)
    found = ann.search(ann.assign(e, centres), e.where("vec_id % 20 = 0"), centres, 10, 8)
    assert "Join" not in found._jdf.queryExecution().toString()
    exact = vectors.search(e, e.where("vec_id % 20 = 0"), 10)
    assert sorted(map(tuple, found.select("query_id", "id", "similarity", "rank").collect())) == sorted(map(tuple, exact.select("query_id", "id", "similarity", "rank").collect()))


def test_exact_search_sends_a_row_for_each_query_and_task(spark):
    e = spark.range(30_000).select(F.col("id").alias("vec_id"), F.array(F.rand(1) - 0.5, F.rand(2) - 0.5, F.rand(3) - 0.5).alias("embedding")).repartition(3).checkpoint()
    found = vectors.search(e, e.where("vec_id % 1000 = 0"), 300)
    assert "Window" not in found._jdf.queryExecution().toString()  # no row for each query, batch and hit is sorted
    rows = found.where("query_id = 5000").orderBy("rank").collect()
    q = vectors.unit(F.col("embedding"))
    mine = e.where("vec_id = 5000").select(q.alias("q"))
    want = e.where("vec_id <> 5000").crossJoin(mine).select("vec_id", F.round(vectors.dot(q, F.col("q")), 9).alias("s")).orderBy(F.desc("s"), "vec_id").limit(300).collect()
    assert [(r["id"], r["rank"]) for r in rows] == [(w["vec_id"], k) for k, w in enumerate(want, 1)]
    assert [r["similarity"] for r in rows] == pytest.approx([w["s"] for w in want], abs=2e-9)


def test_rows_that_share_terms_are_found_without_a_join(spark):
    import random

    rng = random.Random(4)
    texts = [(k, sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))})) for k in range(400)] + [(1000, None), (1001, [])]
    asked = [(k, t) for k in range(0, 400, 7) for t in dict(texts)[k][:5]] + [(9000, "a"), (9001, "zz")]
    found = vectors.sharing_terms(spark.createDataFrame(texts, "id long, words array<string>").repartition(5), spark.createDataFrame(asked, "query_id long, term string"), 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    want = []
    for q in sorted({k for k, _ in asked}):
        mine = {t for k, t in asked if k == q}
        counts = sorted((-len(mine & set(words or ())), k) for k, words in texts if k != q and mine & set(words or ()))
        want += [(q, k, -n, r) for r, (n, k) in enumerate(counts[:5], 1)]
    assert sorted(map(tuple, found.select("query_id", "id", "shared", "rank").collect())) == sorted(want)


def test_list_search_refuses_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.9, 0.1])], "vec_id long, embedding array<float>")
    centres = ann.fit(df.where("vec_id in (1, 4)"), 2)
    indexed = ann.assign(df, centres)
    assert {r["vec_id"] for r in indexed.where("list is null").collect()} == {2, 3}
    assert [r["id"] for r in ann.search(indexed, df.where("vec_id = 1"), centres, 5, 2).collect()] == [4]


def test_greedy_anchors_never_merge_bridged_clusters(spark):
    rows = [("f", 1, day(0), ["a"]), ("f", 2, day(1), ["b"]), ("f", 3, day(2), ["a", "b"]), ("f", 4, day(20), ["a"]), ("f", 5, day(21), None)]
    df = spark.createDataFrame(rows, "family string, id long, day date, states array<string>")
    got = {r["id"]: r["cluster"] for r in clusters.greedy_anchors(df, "family", "id", "day", "states").collect()}
    assert got[3] == got[1] != got[2] and got[4] not in (got[1], got[2]) and got[5] != got[4]


def test_spans_merge_without_a_row_for_each_pair(spark):
    import random

    from perennial.sources import archive

    archive.shared_folder(spark)
    rng = random.Random(7)
    rows = [(k, rng.choice("ab"), day(d := rng.randrange(150)), day(d + rng.randrange(-2, 4))) for k in range(100, 180)]
    rows += [(5, None, day(1), day(2)), (6, None, day(1), day(2)), (7, "a", None, day(1)), (8, "a", day(900), day(897)), (9, "a", day(900), day(897)), (10, "b", day(700), day(700)), (10, "a", day(500), day(501)), (11, "a", day(501), day(503)), (12, "b", day(697), day(700)), (None, "a", day(1), day(1))]
    known = [r for r in rows if r[0] is not None]
    label = {r[0]: r[0] for r in known}
    linked = [(x[0], y[0]) for x in known for y in known if None not in x and None not in y and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    for _ in known:
        for x, y in linked:
            label[x] = label[y] = min(label[x], label[y])
    df = spark.createDataFrame(rows, "id long, k string, a date, b date")
    got = clusters.merged_spans(df, "id", ["k"], "a", "b").collect()
    assert sorted((r["id"], r["label"]) for r in got) == sorted((r[0], label[r[0]]) for r in known)
    # A crowd on a few days: 40,000 rows would be 100 million pairs.
    crowd = spark.range(40_000).select("id", F.lit("a").alias("k"), F.expr("date_add(date'2024-01-01', cast(id % 8 * 3 as int))").alias("a")).withColumn("b", F.expr("date_add(a, cast(id % 2 as int))"))
    merged = clusters.merged_spans(crowd, "id", ["k"], "a", "b")
    assert {r["label"]: r["count"] for r in merged.groupBy("label").count().collect()} == {k: 5000 for k in range(8)}
    assert merged.columns == ["id", "k", "a", "b", "label"]


def test_arcs_open_and_close(spark):
    scores = [10, 30, 80, 20, 9, 8, 8, 40]
    df = spark.createDataFrame([("x", day(i), float(s)) for i, s in enumerate(scores)], "k string, day date, s double")
    got = clusters.arcs(df, ["k"], "day", "s", 15, 75, 2).orderBy("opened").collect()
    assert [(r["opened"], r["recognised"], r["closed"]) for r in got] == [(day(1), day(2), day(5)), (day(7), None, None)]


def test_polygon_holes(spark):
    square = lambda a, b: [{"x": float(a), "y": float(a)}, {"x": float(b), "y": float(a)}, {"x": float(b), "y": float(b)}, {"x": float(a), "y": float(b)}]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("polygon", T.StringType()), T.StructField("rings", clusters.RINGS)])
    polygons = spark.createDataFrame([("p", [square(0, 12), square(4, 6)])], schema)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.5, 7.0), (4, 13.0, 1.0)], "point long, x double, y double")
    assert sorted(r["point"] for r in clusters.points_in_polygons(points, polygons).collect()) == [1, 3]


def test_tides_are_refused_not_zero(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    curve = spark.createDataFrame([("s", at(0), 1.0), ("s", at(1), 3.0), ("s", at(2), None), ("s", at(9), 5.0)], "station string, at timestamp, h double")
    asked = spark.createDataFrame([("s", at(0, 30)), ("s", at(1)), ("s", at(1, 30)), ("s", at(5)), ("s", at(10)), ("q", at(1))], "station string, at timestamp")
    got = {(r["station"], r["at"]): (r["h"], r["direction"], r["status"]) for r in quality.tide_at(curve, asked, ["station"], "at", "h", 60).collect()}
    assert got["s", at(0, 30)] == (2.0, "rising", "ok") and got["s", at(1)][0] == 3.0
    assert [got[k][2] for k in (("s", at(1, 30)), ("s", at(5)), ("s", at(10)), ("q", at(1)))] == ["missing", "gap", "out of range", "out of range"]
    assert all(got[k][0] is None for k in got if got[k][2] != "ok")


def test_tides_of_a_long_curve_take_no_time_for_each_pair(spark):
    import time

    n = 100_000
    moment = lambda k: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60 + k)
    curve = spark.range(n).select(F.lit("s").alias("station"), moment(0).alias("at"), F.when(F.col("id") < n - 1, F.col("id").cast("double")).alias("h"))
    asked = spark.range(n).select(F.lit("s").alias("station"), moment(30).alias("at")).union(spark.range(n - 1, n).select(F.lit("s"), moment(0))).union(spark.range(2).select(F.lit(None).cast("string"), moment(0)))
    began = time.time()
    got = quality.tide_at(curve, asked, ["station"], "at", "h", 60)
    totals = {(r["station"], r["status"]): (r["n"], r["s"]) for r in got.groupBy("station", "status").agg(F.count("*").alias("n"), F.sum("h").alias("s")).collect()}
    assert time.time() - began < 60
    # Half-way between neighbours; a sample without a height is missing, also at the end; no station, no curve.
    assert totals == {("s", "ok"): (n - 2, sum(k + 0.5 for k in range(n - 2))), ("s", "missing"): (2, None), ("s", "out of range"): (1, None), (None, "out of range"): (2, None)}


def test_moon_and_sun(spark):
    row = spark.range(1).select(
        sky.moon_phase(F.lit("2000-01-21").cast("date")).alias("full"), sky.moon_phase(F.lit("2000-01-06").cast("date")).alias("new"),
        sky.day_length_hours(F.lit("2024-03-20").cast("date"), F.lit(40.0)).alias("equinox"), sky.day_length_hours(F.lit("2024-06-21").cast("date"), F.lit(80.0)).alias("polar"),
        sky.circular_moon_distance(F.lit("2000-01-06").cast("date"), F.lit("2000-02-05").cast("date")).alias("apart"),
    ).first()
    assert (row["full"], row["new"]) == ("full", "new")
    assert row["equinox"] == pytest.approx(12.1, abs=0.15) and row["polar"] == 24 and row["apart"] < 1


def test_throttle_is_an_ordered_fold(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in (0, 10, 20)] + [("a", dt.datetime(2024, 1, 3, 0)), ("a", dt.datetime(2024, 1, 4))]
    got = scoring.throttle(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at", 48).collect()
    assert sorted(r["at"] for r in got) == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)]


def test_unknown_condition_is_an_error(spark):
    with pytest.raises(ValueError, match="no such condition"):
        scoring.condition_days({"kind": "hunch", "source": "x"}, {"x": spark.range(1)})
