"""Domain scores and signatures on planted feeds, ranks by ranges, anchors by islands, dossiers and band slices."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from perennial.operators import ann, clusters, convergence, dossier, pools, ranks, series, vectors
from perennial.operators import statistics as st

D = dt.date(2024, 5, 10)
DAY = dt.timedelta(days=1)


def feeds(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), f"state string, day date, {fields}") for name, fields in convergence.READINGS.items()}


def test_domain_scores_do_not_hang_on_the_order_of_a_sum(spark, tmp_path):
    from compare import connect, rows_of

    from perennial import plans

    # The four prices make 921,095 exactly; as doubles, some orders of adding them come out below.
    prices = (161647.9, 163884.44, 391317.97, 204244.69)
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1, prices[k], dt.datetime(2000, 1, 1 + i)) for i, p in enumerate(itertools.permutations(range(4))) for k in p]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["v"] for r in plans.archive_scores._said(spark, str(tmp_path)).collect()} == {921095}
    # The same SQL over prices that are decimals has no order of sums either, and says the same.
    d = "/root/testdata/sf0.1"
    con = connect(d)
    con.sql(f"CREATE OR REPLACE VIEW orders AS SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(12, 2)) AS o_totalprice) FROM read_parquet('{d}/orders.parquet')")
    result = con.sql(plans.ORACLE["domain_scores"])
    df = plans.QUERIES["domain_scores"](spark, d)
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


def scores(spark, asked, events=(), alerts=(), spikes=(), birds=(), space=(), lit=50.0, **readings):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {(r["state"], r["day"]): r for r in convergence.domain_scores(
        make(asked, "state string, day date, coastal boolean"), feeds(spark, **readings), make(events, "state string, day date, type string"), make(alerts, "state string, onset date, expires date, type string"),
        make(spikes, "state string, day date, deviation double"), make(birds, "state string, day date, high boolean, birds long"), F.lit(lit), make(space, "day date, storm string, kp double"),
    ).collect()}


def test_silence_scores_what_the_rules_say(spark):
    got = scores(spark, [("AA", D, True), ("BB", D, False)])
    a, b = got["AA", D], got["BB", D]
    assert {n: a[f"{n}_score"] for n in convergence.CAPS} == dict.fromkeys(convergence.CAPS, 0) | {"lunar": 2, "photoperiod": 2, "tide": 2}
    assert b["tide_score"] == 0 and a["score"] == 5 and b["score"] == 3 and a["active"] == 0  # 6 and 4 of 120, halves up


def test_each_domain_and_the_caps(spark):
    got = scores(
        spark, [("AA", D, True), ("AA", D + 9 * DAY, True)],
        events=[("AA", D, "cold_front"), ("AA", D + DAY, "cold_front"), ("AA", D + 3 * DAY, "first_freeze"), ("AA", D + 4 * DAY, "high_wind"), ("ZZ", D, "pressure_drop")],
        alerts=[("AA", D - DAY, D, "Winter Storm Wind Warning"), ("AA", D, D + DAY, "High Wind Warning"), ("AA", D - 3 * DAY, D - DAY, "Flood")],
        spikes=[("AA", D - 7 * DAY, 120.0), ("AA", D - 8 * DAY, 900.0), ("AA", D, 30.0)], birds=[("AA", D - 3 * DAY, True, 2_000_000), ("AA", D - DAY, False, 200_000)],
        water=[("AA", D - 40 * DAY, "rising")], river=[("AA", D - DAY, "flood"), ("AA", D + DAY, "low flow")], drought=[("AA", D, None, 60.0)], air=[("AA", D, 201.0)],
        soil=[("AA", D, -1.0, 0.6)], ocean=[("AA", D, 3.5, 1.0)], photoperiod=[("AA", D, True, False)], tide=[("AA", D, 7.0)], space=[(D - DAY, "none", 4.0), (D - 2 * DAY, "G3", 9.0)], lit=3.0,
    )
    r = got["AA", D]
    assert {n: r[f"{n}_score"] for n in convergence.CAPS} == {"weather": 20, "biological": 15, "lunar": 10, "water": 15, "drought": 15, "air": 15, "soil": 10, "ocean": 9, "space": 6, "photoperiod": 8, "tide": 8}
    assert r["active"] == 11 and r["score"] == 100
    later = got["AA", D + 9 * DAY]
    assert later["weather_score"] == 0 and later["biological_score"] == 0 and later["water_score"] == 13  # rising still, low flow since


def test_of_events_the_types_count_and_of_alerts_the_first_word(spark):
    one = lambda **k: scores(spark, [("AA", D, False)], **k)["AA", D]
    assert one(events=[("AA", D, "high_wind"), ("AA", D + DAY, "high_wind"), ("AA", D, "unknown")])["weather_score"] == 5
    assert one(alerts=[("AA", D, D, "Freeze Watch"), ("AA", D, D, "FREEZE WATCH"), ("AA", D, D, "Heat")])["weather_score"] == 8
    assert one(soil=[("AA", D, 20.0, 0.3)])["soil_score"] == 2 and one(soil=[("AA", D, None, 0.7)])["soil_score"] == 5
    assert one(ocean=[("AA", D, 9.0, 9.0)])["ocean_score"] == 0 and one(space=[(D, "quiet", None)])["space_score"] == 1


MONTHS = [dt.date(2023, m, 1) for m in range(1, 13)]


def test_signatures_of_planted_indices(spark):
    values = [("ao", m, -2.5 if m.month == 12 else -1.2 if m.month == 11 else 1.5) for m in MONTHS] + [("NAO", m, -1.6) for m in MONTHS[6:]] + [("enso", m, -0.7) for m in MONTHS[8:]]
    values += [("PDO", m, -9.9) for m in MONTHS] + [("OTHER", m, 5.0) for m in MONTHS]
    df = spark.createDataFrame(values, "i string, m date, v double")
    got = {(r["month"], r["signature"]): r for r in convergence.signatures(convergence.recent_values(df, "i", "m", "v")).collect()}
    december = {s: (r["confidence"], r["conditions"]) for (m, s), r in got.items() if m == MONTHS[-1]}
    assert december == {
        "cold outbreak": (40 + 20 + 15 + 5, ["AO extreme", "AO stays negative", "NAO crash", "ENSO falls"]), "hurricane season": (15 + 15, ["La Nina behind", "NAO trends negative"]),
        "flooding": (20, ["NAO crash"]), "drought": (30 + 20, ["La Nina lasts", "AO swings"]),
    }
    assert not [s for m, s in got if m == MONTHS[0]]


# --- ranks ---


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_and_ranks_are_those_of_windows(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), float(r.randrange(30)) if r.random() < 0.95 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(5)
    got = ranks.numbered(df, ["k"], ["v", "id"], "n", "all", parts).collect()
    order = lambda x: (x[1] is not None, x[1] or 0, x[2])
    for key in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == key), key=order)
        assert [(x["v"], x["id"], x["n"], x["all"]) for x in sorted((x for x in got if x["k"] == key), key=lambda x: x["n"])] == [(v, i, n, len(mine)) for n, (_, v, i) in enumerate(mine, 1)]
    known = [x for x in rows if x[0] is not None and x[1] is not None]
    for x in ranks.cumulative(df.where("k is not null"), "v", parts=parts, key=["k"]).collect():
        mine = [y[1] for y in known if y[0] == x["k"]]
        assert (x["c"], x["le"], x["ge"]) == (mine.count(x["v"]), sum(v <= x["v"] for v in mine), sum(v >= x["v"] for v in mine))
    assert ranks.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_step_up_values_with_ties_and_families(spark):
    r = random.Random(3)
    rows = [(f, round(r.random() ** 3, 2), k) for f in ("a", "b") for k in range(200)] + [("c", 0.04, 0), ("d", None, 0)]
    got = {(x["f"], x["k"]): x["q_value"] for x in st.benjamini_hochberg(spark.createDataFrame(rows, "f string, p double, k int"), "p", ["f"]).collect()}
    for f in ("a", "b", "c"):
        mine = sorted((p, k) for g, p, k in rows if g == f)
        least = 1.0
        for i in range(len(mine), 0, -1):
            least = min(least, mine[i - 1][0] * len(mine) / i)
            assert abs(got[f, mine[i - 1][1]] - least) < 1e-12
    assert len(got) == 401


# --- anchors, dossiers, slices, lists ---


def test_anchors_by_islands_are_those_of_one_fold(spark):
    r = random.Random(1)
    rows = [(f, k, D + r.randrange(900) * DAY, r.sample("abcdef", r.randrange(3)) or None) for k, f in enumerate(r.choice("xy") for _ in range(300))]
    got = {(x["f"], x["id"]): x["cluster"] for x in clusters.greedy_anchors(spark.createDataFrame(rows, "f string, id int, day date, states array<string>"), "f", "id", "day", "states").collect()}
    for f in "xy":
        live, number = [], 0
        for _, k, d, s in sorted((x for x in rows if x[0] == f), key=lambda x: (x[2], x[1])):
            hit = next((c for c in live if (d - c[1]).days <= 7 and c[2] & set(s or ())), None)
            if hit is None:
                hit = [number, d, set()]
                live.append(hit)
                number += 1
            hit[1] = max(hit[1], d)
            hit[2] |= set(s or ())
            assert got[f, k] == hit[0]


def test_a_dossier_of_a_planted_day(spark):
    rows, high = [], {}
    for y in range(2000, 2010):
        for k in range(-6, 12):
            d = dt.date(y, 5, 10) + k * DAY
            high[d] = 60.0 + (y % 3) + (20 if (y, k) == (2009, 0) else 0) - (8 if y == 2004 and k > 0 else 0)
            rows.append(("S", d, high[d], 0.7 if y in (2004, 2009) else 0.0))
    df = spark.createDataFrame(rows, "state string, day date, high double, tide double")
    file = spark.createDataFrame([("S", dt.date(2008, 5, 10), "storm"), ("S", dt.date(2008, 5, 10), "quake"), ("T", dt.date(2008, 5, 10), "flood")], "state string, day date, type string")
    got = {r["day"]: r for r in dossier.dossiers(df, file, ["state"], "day", "high", "tide", F.lit(0), least_tides=5).collect()}
    odd, plain = got[dt.date(2009, 5, 10)], got[dt.date(2008, 5, 10)]
    assert odd["z"] > 10 and odd["years"] == 9 and odd["lined_up"] == 0 and odd["mode"] == "moon_tide_temp" and odd["signal"] == "warming"
    assert (odd["all_n"], odd["all_cooled"]) == (9, 1) and (odd["matched_n"], odd["matched_cooled"]) == (0, 0)
    assert len(odd["alike"]) == 3 and all(a["value"] == 62.0 for a in odd["alike"])
    assert plain["lined_up"] > 0 and plain["matched_cooled"] == 0 and plain["matched_n"] == plain["lined_up"]
    assert plain["all_n"] == 9 and plain["all_cooled"] == 2  # 2004 fell, and 2009 came back
    named = {a["date"]: a["on_file"] for r in got.values() for a in r["alike"]}
    assert named.get(dt.date(2008, 5, 10), ["quake", "storm"]) == ["quake", "storm"] and all(not v for k, v in named.items() if k != dt.date(2008, 5, 10))


def test_band_slices_of_a_dictionary(spark):
    days = [dt.date(1990 + y, 5, 1) + k * DAY for y in range(20) for k in range(5)]
    rows = [("p", d, float(i % 5 * 100 + i // 5)) for i, d in enumerate(days)]
    baked = series.frequency_dictionary(spark.createDataFrame(rows, "k string, day date, v double"), ["k"], "day", "v")
    low = pools.band_facts(baked, 0.0, 0.1).first()
    assert low["matched_days"] == 10 and low["episode_count"] == 10 and list(low["episode_years"]) == list(range(1990, 2000)) and low["refusal"] is None
    assert [(x["decade"], x["episodes"]) for x in low["decades"]] == [(1990, 10)] and low["last_start"] == dt.date(1999, 5, 1)
    high = pools.band_facts(baked, 0.99, 1.0).first()
    assert high["matched_days"] == 1 and high["last_start"] == dt.date(2009, 5, 5) and high["refusal"] == "too few episodes"
    assert pools.band_facts(baked, 0.0, 1.0).first()["episode_count"] == 20 and pools.band_facts(baked, 0.0, 0.0).first()["refusal"] == "nothing on record"


def test_search_by_all_lists_is_exact(spark):
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1) for _ in range(12)]) for k in range(400)] + [(900, None), (901, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0 and vec_id < 400")
    index = ann.fit(df.where("vec_id < 900"), lists=8)
    by_lists = ann.search(ann.assign(df.where("vec_id <> 901"), index), q, index, top=5, probes=8)
    exact = vectors.search(df, q, 5)
    rows_of = lambda x: sorted((h["query_id"], h["rank"], h["id"], round(h["similarity"], 6)) for h in x.collect())
    assert rows_of(by_lists) == rows_of(exact)
