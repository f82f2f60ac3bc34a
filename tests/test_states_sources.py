"""Arcs as a stream and in one go, seeded choices, inverse percentiles, and the station reader."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perennial.functions import seeded
from perennial.operators import pools
from perennial.sources import archive, stations
from perennial.streaming import arcs

T0 = dt.datetime(2024, 1, 1)


def at(days, hours=0):
    return T0 + dt.timedelta(days=days, hours=hours)


def acts(spark, events, as_of="2024-06-01", rules=arcs.Rules()):
    df = spark.createDataFrame(events, arcs.EVENTS).repartition(3)
    return [(r["key"], r["arc"], r["act"], r["at"], r["signals"], r["grade"], r["why"]) for r in arcs.arc_acts(df, as_of, rules).collect()]


def score(key, day, value, domains=2):
    return (key, "score", at(day), float(value), domains, None)


def test_an_arc_goes_through_its_acts(spark):
    events = [score("a", 0, 10), score("a", 1, 30), ("a", "claim", at(2), None, None, None), ("a", "signal", at(3), None, None, None), ("a", "signal", at(4), None, None, None), ("a", "grade", at(5), None, None, "hit")]
    assert acts(spark, events) == [
        ("a", 1, "buildup", at(1), 0, None, "score"), ("a", 1, "recognition", at(2), 0, None, "claim"), ("a", 1, "outcome", at(3), 1, None, "signal"), ("a", 1, "outcome", at(4), 2, None, "signal"),
        ("a", 1, "grade", at(5), 2, "hit", "grade"), ("a", 1, "closed", at(6), 2, "hit", "timeout"),
    ]


def test_when_arcs_open_wait_and_end(spark):
    one_domain = [score("b", 0, 10), score("b", 1, 30, 1)]
    small_rise = [score("c", 0, 10), score("c", 1, 25)]  # more than 15 is needed
    first_score = [score("d", 0, 99)]  # nothing to rise from
    assert acts(spark, one_domain + small_rise + first_score) == []
    faded = [score("e", 0, 0), score("e", 1, 20), score("e", 5, 60)]  # one arc at a time
    assert acts(spark, faded) == [("e", 1, "buildup", at(1), 0, None, "score"), ("e", 1, "closed", at(15), 0, None, "timeout")]
    claims = [("f", "claim", at(0), None, None, None), ("f", "claim", at(1), None, None, None), ("f", "signal", at(7), None, None, None), ("f", "grade", at(7), None, None, "late")]
    # The deadline at day 7 comes before the events of that time; the second claim changes nothing.
    assert [x[2:] for x in acts(spark, claims)] == [("recognition", at(0), 0, None, "claim"), ("grade", at(7), 0, "missed", "deadline"), ("closed", at(8), 0, "missed", "timeout")]
    again = [("g", "claim", at(0), None, None, None), ("g", "signal", at(1), None, None, None), ("g", "claim", at(20), None, None, None)]
    got = acts(spark, again, "2024-01-22")
    assert [(x[1], x[2], x[5]) for x in got] == [(1, "recognition", None), (1, "outcome", None), (1, "grade", "confirmed"), (1, "closed", "confirmed"), (2, "recognition", None)]
    odd = [(None, "claim", at(0), None, None, None), ("h", "other", at(0), None, None, None), ("h", "claim", None, None, None, None)]
    assert acts(spark, odd) == [] and acts(spark, []) == []


def test_the_stream_says_what_the_batch_says_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(6)
    events = []
    for k in range(6):
        for d in range(60):
            events.append(score(f"k{k}", d, r.randrange(100), r.randrange(4)))
            events += [(f"k{k}", kind, at(d, h), None, None, "mixed" if kind == "grade" else None) for kind, h, p in (("claim", 6, 0.15), ("signal", 12, 0.3), ("grade", 18, 0.1)) if r.random() < p]
    end = [(f"k{k}", "score", at(200), 0.0, 0, None) for k in range(6)] + [("tick", "score", at(d), 0.0, 0, None) for d in (201, 202)]  # the watermark passes all deadlines
    (tmp_path / "events").mkdir()
    folder = str(tmp_path / "events")
    live = arcs.arc_stream(spark.readStream.schema(arcs.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder), late="3 days")
    halves = [[x for x in events if x[2] < at(30)], [x for x in events if x[2] >= at(30)]]
    for n, half in enumerate(halves):
        for lo in range(0, 30, 6):  # within a file out of order
            part = [x for x in half if lo <= (x[2] - at(30 * n)).days < lo + 6]
            r.shuffle(part)
            spark.createDataFrame(part, arcs.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        if n:
            for e in (end[:6], end[6:7], end[7:]):
                spark.createDataFrame(e, arcs.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        # Each half is a run of its own from the same checkpoint: the second one is a restart.
        q = live.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "acts")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "acts")).where(F.col("at") < F.lit(at(190)))
    want = arcs.arc_acts(spark.createDataFrame(events, arcs.EVENTS), str(at(190)))
    rows = lambda df: sorted((x["key"], x["arc"], x["at"], x["act"], x["signals"], x["grade"] or "", x["why"]) for x in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) > 100


# --- seeded choices ---


def plain_fnv(text):
    h = 0x811C9DC5
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] << 8 | raw[i + 1])) * 0x01000193 % (1 << 32)
    return h


def plain_fractions(seed, n):
    """The generator step by step, on 32-bit words."""
    m, a, out = (1 << 32) - 1, seed, []
    for _ in range(n):
        a = (a + 0x6D2B79F5) & m
        t = ((a ^ (a >> 15)) * (1 | a)) & m
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & m)) & m) ^ t
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def test_hash_and_generator_are_the_plain_ones(spark):
    #: Fixed values of FNV-1a with 32 bits.
    assert [plain_fnv(x) for x in ("", "a", "foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    texts = ["", "a", "foobar", "é€", "😀x", "sweep|storms|2001-02-03", "x" * 500, " ", "\0"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(seeded.fnv1a(F.col("t"))).collect()] == [plain_fnv(x) for x in texts]
    seeds = [0, 1, 42, 0xFFFFFFFF, 0x80000000, plain_fnv("foobar")]
    df = spark.createDataFrame([(x,) for x in seeds], "s long")
    got = df.select([seeded.fraction(F.col("s"), n).alias(f"f{n}") for n in range(1, 7)] + [seeded.fraction(F.col("s"), 5000).alias("far")]).collect()
    for row, s in zip(got, seeds, strict=True):
        assert list(row)[:6] == plain_fractions(s, 6) and row["far"] == plain_fractions(s, 5000)[-1]
    #: Fixed value: the generator's first fraction for the seed 0.
    assert abs(plain_fractions(0, 1)[0] - 0.26642920868471265) < 1e-15


def test_picks_are_those_of_a_plain_loop(spark):
    rows = [(g, d, (d * 7) % 5) for g in ("small", "large") for d in range(6 if g == "small" else 40)]
    got = seeded.seeded_picks(spark.createDataFrame(rows, "g string, d int, gap int"), ["g"], F.concat_ws("|", F.lit("seed"), "g"), [F.col("d")], [F.col("gap")], 8).collect()
    picked = {g: [r["d"] for r in sorted(got, key=lambda r: r["pick"]) if r["g"] == g] for g in ("small", "large")}
    draws = plain_fractions(plain_fnv("seed|large"), 40)
    assert picked == {"small": list(range(6)), "large": sorted(range(40), key=lambda d: ((d * 7) % 5, draws[d]))[:8]}


# --- inverse percentiles ---


def test_depth_of_the_inverse_is_the_percentile(spark):
    r = random.Random(2)
    pool = [[float(x) for x in sorted({r.randrange(50) for _ in range(n)})] for n in (1, 2, 9, 40)]
    rows = []
    for k, vals in enumerate(pool):
        counts = [r.randrange(1, 6) for _ in vals]
        rows.append((k, vals, [sum(counts[:i]) for i in range(len(vals))], sum(counts)))
    luts = spark.createDataFrame([*rows, (9, [], [], 0)], "k int, vals array<double>, below array<long>, n long")
    grid = luts.withColumn("p", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(42)), lambda i: i / 40.0)))
    v, b, n, p = (F.col(c) for c in ("vals", "below", "n", "p"))
    for side in ("high", "low"):
        out = grid.withColumn("x", pools.inverse(v, b, n, p, side)).withColumn("back", pools.depth_between(v, b, n, F.col("x"), side)).collect()
        for x in out:
            if x["k"] == 9:
                assert x["x"] is None and x["back"] is None
                continue
            q = min(1.0, max(0.0, x["p"]))
            target = (q if side == "high" else 1 - q) * x["n"]
            last = x["below"][-1]
            expected = min(target, last) / x["n"]  # beyond the last step lies the greatest value
            assert abs((x["back"] if side == "high" else 1 - x["back"]) - expected) < 1e-9
            assert x["x"] in x["vals"] or x["vals"][0] < x["x"] < x["vals"][-1]
            for i, low in enumerate(x["below"]):
                if target == low:
                    assert x["x"] == x["vals"][i]  # at a step the step's own value


# --- station files ---


LAYOUT = "station:1:6:string, day:7:10:date, kind:17:4:string, value:21:6:int, share:27:7:double"
CUTS = [("station", 1, 6, "string"), ("day", 7, 10, "date"), ("kind", 17, 4, "string"), ("value", 21, 6, "int"), ("share", 27, 7, "double")]


@pytest.fixture
def station_files(tmp_path):
    r = random.Random(13)
    for s in ("AA0001", "AA0002", "BB0001"):
        lines = []
        for k in range(400):
            value = r.choice([str(r.randrange(-500, 500)), "", "n/a", "99999999999"])[:6]
            lines.append(f"{s}{dt.date(2020, 1, 1) + dt.timedelta(days=k)}{r.choice(['TMAX', 'TMIN', '  ', 'é'])[:4]:4}{value:>6}{r.choice(['0.5', '1e3', '', 'x']):>7}")
        lines[5] = s  # a short line
        lines[6] = ""
        (tmp_path / f"{s}.dly").write_bytes("\n".join(lines).encode() + (b"\n" if s != "BB0001" else b""))
    (tmp_path / "_done").write_text("not data")
    return str(tmp_path)


def as_rows(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_the_reader_gives_the_rows_of_the_plain_one(spark, station_files):
    plain = archive.fixed_width(spark, station_files, CUTS)
    ascii_only = F.coalesce(F.col("kind"), F.lit("")) != "é"  # bytes and characters part ways behind it
    whole = lambda df: as_rows(df.where(ascii_only))
    for split in (1 << 20, 1000, 37):
        got = stations.read(spark, station_files, LAYOUT, split=split)
        assert got.schema == plain.schema and whole(got) == whole(plain) and got.count() == plain.count() == 1200
    one = f"{station_files}/AA0001.dly"
    assert whole(stations.read(spark, one, LAYOUT)) == whole(archive.fixed_width(spark, one, CUTS))
    assert whole(stations.read(spark, f"file://{station_files}", LAYOUT)) == whole(plain)


def test_bounds_reach_the_reader_and_files_are_left_out(spark, station_files):
    load = lambda *where: stations.read(spark, station_files, LAYOUT, where, "station", 4000)
    df = load()
    some = load(("station", "=", "AA0002"), ("day", ">=", dt.date(2020, 6, 1)), ("value", ">", 100), ("share", "<=", 0.5))
    whole = [x.asDict() for x in df.collect()]
    expected = [x for x in whole if x["station"] == "AA0002" and x["day"] and x["day"] >= dt.date(2020, 6, 1) and (x["value"] or 0) > 100 and x["share"] is not None and x["share"] <= 0.5]
    assert as_rows(some) == sorted((tuple(x.values()) for x in expected), key=repr) and expected
    parts = lambda x: x.select(F.spark_partition_id()).distinct().count()
    assert 3 * parts(load(("station", "=", "AA0002"))) <= parts(df) + 2  # one file of three is opened
    # What one load leaves out is there in the others, planned before or after it.
    two = load(("station", "in", ["AA0001", "BB0001"]))
    assert df.count() == 1200 and two.union(df).count() == 1200 + sum(x["station"] in ("AA0001", "BB0001") for x in whole)
    assert df.where("value > 100").count() == sum((x["value"] or 0) > 100 for x in whole)
    with pytest.raises(ValueError):
        load(("nothing", "=", 1))


def test_layouts_that_are_none_are_errors():
    with pytest.raises(ValueError):
        stations.layout_of("a:0:4:string")
    with pytest.raises(ValueError):
        stations.layout_of("a:1:4:blob")
