"""Users' alerts, certification under rotations, step and trend arms, and the serving of frames."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from perennial.operators import frames, series, studies, user_alerts

NOW = dt.datetime(2024, 1, 20)


def ago(**k):
    return NOW - dt.timedelta(**k)


def test_intervals_are_parsed_and_others_are_three_hours(spark):
    texts = ["30min", "3hr", "5h", "2d", "soon", "", None, "3 h", "-1h"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(user_alerts.interval_seconds(F.col("t"))).collect()]
    assert got == [1800, 10800, 18000, 172800, 10800, 10800, 10800, 10800, 10800]


def alert(k, trigger, states=None, every=None, last=None, **config):
    names = ("min_change", "min_score", "types", "compare", "bound", "content")
    return (k, trigger, states, every, last, *(config.get(n) for n in names))


def fired(spark, alerts, jumps=(), events=(), scores=(), entries=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = user_alerts.fires(make(alerts, user_alerts.ALERTS), str(NOW), make(jumps, "state string, score double, previous double, at timestamp"), make(events, "type string, states array<string>, at timestamp"), make(scores, "state string, score double"), make(entries, "content string, at timestamp"))
    return {r["alert"]: (r["n"], r["states"]) for r in out.collect()}


def test_alerts_fire_by_their_own_rules(spark):
    jumps = [("TX", 80.0, 60.0, ago(hours=2)), ("OK", 70.0, 60.0, ago(hours=2)), ("LA", 50.0, 90.0, ago(hours=2)), ("AR", 90.0, 70.0, ago(hours=30)), ("NM", 90.0, None, ago(hours=1))]
    spikes = [alert(1, "score_spike"), alert(2, "score_spike", ["OK", "LA"], min_change=5.0, min_score=40.0), alert(3, "score_spike", ["AR"]), alert(4, "score_spike", ["AR"], last=ago(hours=40)), alert(5, "score_spike", ["TX"], every="2d", last=ago(hours=40)), alert(6, "score_spike", [])]
    assert fired(spark, spikes, jumps) == {1: (1, ["TX"]), 2: (2, ["LA", "OK"]), 4: (1, ["AR"])}
    events = [("cold_front", ["TX", "OK"], ago(hours=1)), ("cold_front", ["TX"], ago(hours=1)), ("heat", ["TX"], ago(hours=1)), ("pressure_drop", None, ago(hours=3))]
    weather = [alert(1, "weather_event"), alert(2, "weather_event", ["OK"]), alert(3, "weather_event", types=["heat", "heat"]), alert(4, "weather_event", ["OK", "TX"], types=["cold_front"]), alert(5, "weather_event", ["ZZ"])]
    assert fired(spark, weather, events=events) == {1: (3, ["OK", "TX"]), 2: (1, ["OK"]), 3: (1, ["TX"]), 4: (2, ["OK", "TX"])}
    bounds = [alert(1, "threshold"), alert(2, "threshold", ["TX"], compare="<", bound=80.0), alert(3, "threshold", compare="<=", bound=10.0), alert(4, "unknown")]
    assert fired(spark, bounds, scores=[("TX", 75.0), ("OK", 74.0)]) == {1: (1, ["TX"]), 2: (1, ["TX"])}
    entries = [("migration-spike", ago(hours=5))] * 500 + [("migration-spike", ago(hours=25)), ("other", ago(hours=1))]
    new = [alert(1, "new_data"), alert(2, "new_data", ["TX", "OK"], content="other"), alert(3, "new_data", content="none"), alert(4, "new_data", last=ago(hours=4))]
    assert fired(spark, new, entries=entries) == {1: (500, []), 2: (1, [])}


def test_many_alerts_do_not_meet_many_events_one_by_one(spark):
    rng, n = random.Random(3), 30_000
    # Each alert last fired at a moment of its own; 30,000 x 30,000 pairs would take minutes.
    sinces = [ago(hours=4, seconds=rng.randrange(10**6)) for _ in range(n)]
    events = [("heat", rng.choice([["TX"], ["OK", "TX"], ["OK"], None]), ago(seconds=rng.randrange(10**6))) for _ in range(n)]
    states = [rng.choice([None, ["OK"], ["OK", "TX", "TX"]]) for _ in range(n)]
    alerts = [alert(k, "weather_event", states[k], last=since, types=["heat"]) for k, since in enumerate(sinces)] + [alert(n + k, "new_data", last=since, content="heat") for k, since in enumerate(sinces)]
    began = time.time()
    got = fired(spark, alerts, events=events, entries=[("heat", at) for _, _, at in events])
    assert time.time() - began < 90
    kinds = sorted({(at, tuple(s) if s else ()) for _, s, at in events})
    for k in rng.sample(range(n), 40):
        later = [s for at, s in kinds if at > sinces[k] and (states[k] is None or set(s) & set(states[k]))]
        assert got.get(k, (0, []))[0] == len(later)
        assert got.get(k, (0, []))[1] == sorted({x for s in later for x in s if states[k] is None or x in states[k]})
        assert got.get(n + k, (0, []))[0] == sum(at > sinces[k] for _, _, at in events)


def test_certification_needs_every_rotation_and_the_floor(spark):
    rows = [("yes", 0, 0.05)] + [("yes", k, 0.04) for k in range(1, 5)] + [("tie", 0, 0.04)] + [("tie", k, 0.04 if k == 2 else 0.0) for k in range(1, 5)]
    rows += [("small", 0, 0.01), ("small", 1, 0.0), ("small", 2, None), ("none", 0, None), ("none", 1, 0.3), ("alone", 0, 0.5)]
    got = {r["g"]: r for r in studies.certified(spark.createDataFrame(rows, "g string, k int, delta double"), ["g"]).collect()}
    assert {g: (r["beats_all"], r["floor_met"], r["certified"], round(r["p"], 6)) for g, r in got.items()} == {
        "yes": (True, True, True, 0.2), "tie": (False, True, False, 0.4), "small": (True, False, False, round(1 / 3, 6)), "none": (False, False, False, 1.0), "alone": (True, True, True, 1.0),
    }
    assert got["small"]["rotations"] == 2 and got["yes"]["largest"] == 0.04


def test_step_and_trend_against_a_plain_loop(spark):
    r = random.Random(12)
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=k), float(r.randrange(40, 200))) for s in "ab" for k in range(200) if r.random() < 0.8]
    got = {(x["s"], x["day"]): (x["peak"], x["run"], x["arm"]) for x in series.step_or_trend(spark.createDataFrame(rows, "s string, day date, v double"), ["s"], "day", "v").collect()}
    want = {}
    for s, d, v in rows:
        vs = [x for t, e, x in sorted(rows) if t == s and 0 <= (d - e).days < 5]
        rises = [b > a for a, b in zip(vs, vs[1:], strict=False)]
        run = next((i for i, up in enumerate(reversed(rises)) if not up), len(rises))
        arm = "step" if v >= 150 else "trend" if v >= 100 and any(a and b for a, b in zip(rises, rises[1:], strict=False)) else None
        if len(vs) >= 3 and arm:
            want[s, d] = (max(vs), run, arm)
    assert got == want and {a for *_, a in want.values()} == {"step", "trend"}


def test_frames_are_served_by_range_and_layout(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, k), "00", 1 if k < 5 else 2) for k in range(1, 11)], "day date, dots string, layout int")
    assert sorted(x["day"].day for x in frames.serve(df, "2024-01-03", "2024-01-07", 2).collect()) == [5, 6, 7]
    with pytest.raises(ValueError):
        frames.serve(df, "2024-01-07", "2024-01-03", 2)
    with pytest.raises(ValueError):
        frames.serve(df, "2024-01-01", "2024-06-01", 2)
