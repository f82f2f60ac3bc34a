"""Nearest neighbours, fill-in-the-middle and collocations against brute force, with nulls, ties, repeats and long texts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perennial.llm import collocations, dimension_scan, fill_in_middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- fill-in-the-middle ---


def expected_middle(key, text):
    t = text or ""
    w = TOKENS.findall(t)
    n, h = len(w), hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if key is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:lo]), "".join(w[lo:hi]), "".join(w[hi:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_brute_force(spark):
    r = random.Random(5)
    letters = "ab é€😀\t\n\x0b\x0c\r   <PSM>\0"
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randrange(40)))) for k in range(600)]
    rows += [(7000 + k, t) for k in range(12) for t in (None, "", " ", "one", "<S", "a <", "<P> b", " lead and trail ", "x" * 50_000, "ab " * 60_000)]
    rows += [(None, "no id at all"), (3, "an id twice"), (3, "an id twice"), (-20, "below zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y")}).repartition(3)
    out = fill_in_middle.transform(docs)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    as_rows = lambda x: collections.Counter(tuple(v) for v in x)
    assert as_rows((g["doc_id"], g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"], g["back"]) for g in got) == as_rows((k, *expected_middle(k, t), t or "") for k, t in rows)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_middle_carries_bytes_that_are_no_text(spark):
    raw = [b"ok \xff\xfe word \xc3 more words here", b"\xed\xa0\x80 half a pair", b"plain words"]
    docs = spark.createDataFrame([(k, b) for k in range(40) for b in raw], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    out = fill_in_middle.transform(docs).select("doc_id", "form", F.col("output").cast("binary").alias("b")).collect()
    assert sorted(len(r["b"]) - (0 if r["form"] == "plain" else 9) for r in out) == sorted(len(b) for _ in range(40) for b in raw)
    assert collections.Counter(bytes(r["b"]) for r in out if r["form"] == "plain").keys() <= set(raw)


def test_middle_boundaries_and_rates(spark):
    codes = np.frombuffer(" a  bc  d\n".encode("utf-32-le"), np.uint32)
    assert fill_in_middle.boundaries(codes).tolist() == [0, 2, 6, 9, 10]
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words to be moved about").alias("text"))
    forms = lambda **k: {r[0] for r in fill_in_middle.transform(docs, **k).select("form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=0) == {"psm"} and forms(rate=100, suffix_first=100) == {"spm"}


# --- collocations ---


def expected_phrases(rows, least=10, longest=3, percent=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {}
        for phrase, a in counts.items():
            w = phrase.split(" ")
            if len(w) > 1 and a >= least:
                cuts = [(10**6 * a * a // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                found[phrase] = (a, counts[" ".join(w[:k])], counts[" ".join(w[k:])], score)
        gone = set()
        for phrase, (a, *_) in found.items():
            w = phrase.split(" ")
            for k in range(2, len(w)):
                gone |= {p for i in range(len(w) - k + 1) if (p := " ".join(w[i : i + k])) in found and 100 * a >= percent * found[p][0]}
        kept = sorted(((p, *v) for p, v in found.items() if p not in gone), key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(kept[:top], 1)]
    return sorted(out)


def texts_with_phrases(r):
    words = ["the", "of", "New", "york", "É", "é", "city", " x", "new-york", "0", "y\0z"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice(["  ", " ", "\t", ". ", "\n", " ", " "]) for _ in range(r.randrange(1, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", " \t . ; "), ("en", "one two three. " * 500), ("fr", "x" * 70_000 + " y"), ("es", "alone here")]
    return rows + [("en", "same line again and again")] * 400


@pytest.mark.parametrize(("least", "longest", "percent", "top"), [(10, 3, 50, 2000), (3, 4, 80, 7), (2, 2, 50, 2000)])
def test_phrases_against_brute_force(spark, monkeypatch, least, longest, percent, top):
    monkeypatch.setattr(collocations, "PIECE_BYTES", 1 << 14)
    monkeypatch.setattr(collocations, "PHRASE_BYTES", 1 << 12)
    rows = texts_with_phrases(random.Random(least))
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("p"), "n": F.lit(None).cast("int"), "m": F.lit(2)}).repartition(4)
    got = sorted(tuple(x) for x in collocations.mine(docs, least, longest, percent, top).collect())
    assert got == expected_phrases(rows, least, longest, percent, top) and got


def test_phrases_of_long_pieces_count_once(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LONG_PIECE", 100)
    monkeypatch.setattr(collocations, "RUN", 5)
    r = random.Random(9)
    rows = [("en", " ".join(r.choice("abc") for _ in range(r.randrange(1, 400)))) for _ in range(20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(x) for x in collocations.mine(docs).collect()) == expected_phrases(rows)


def test_phrases_that_do_not_fit_memory_are_spilled(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MEMORY", "40MB")
    rows = spark.range(6000).select(F.lit("en").alias("lang"), F.concat_ws(" ", *(F.sha1((F.col("id") * 50 + k).cast("string")) for k in range(40)), F.lit("left right")).alias("text"))
    got = collocations.mine(rows).collect()
    assert [(g["phrase"], g["a"], g["score"], g["n"]) for g in got] == [("left right", 6000, 1_000_000, 6000 * 42)]


def test_scores_beyond_64_bits_and_no_rows(spark):
    rows = [("en", "a", 1, 10**13), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12 - 1), ("en", None, 0, 2 * 10**13)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    got = collocations.scored(counted).first()
    assert got["score"] == 10**6 * (10**12 - 1) ** 2 // (10**13 * 10**12)
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0


def test_requests_for_one_part_are_dealt_out(spark):
    rows = [("en", "the", 1, 10**6)] + [("en", f"w{k}", 1, 100) for k in range(3000)] + [("en", f"the w{k}", 2, 50) for k in range(3000)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    assert collocations.scored(counted).where(f"score = {10**6 * 2500 // (10**6 * 100)}").count() == 3000


# --- nearest neighbours ---


def nearest(rows, top=20):
    """Exact answers: {query: [(id, score)]} of rows that take part."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q in (i for i in kept if i % 20 == 0):
        scores = [(-sum(a * b for a, b in zip(kept[q], v, strict=True)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q])]
        out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def found(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "list": F.lit(0), "rank": F.lit(0)}).repartition(3)
    out = collections.defaultdict(list)
    for r in dimension_scan.search(df, df.where("vec_id % 20 = 0"), **kwargs).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_few_vectors_are_searched_exactly(spark):
    r = random.Random(2)
    some = lambda d: [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(d)]
    rows = [(k, some(4)) for k in range(300)] + [(1000 + k, some(3)) for k in range(10)] + [(2000, some(7))]
    rows += [(3000, None), (3020, []), (3040, [0.0] * 4), (3060, [None, 1.0, 1.0, 1.0]), (3080, [float("nan")] * 4), (3100, [float("inf"), 1.0, 0.0, 0.0]), (None, some(4))]
    rows += [rows[3]] * 30 + [(40, some(4)), (40, some(4)), (-20, some(4))] + [(5000 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(100)]
    expected = {q: v for q, v in nearest(rows).items() if v}
    assert found(spark, rows) == expected
    assert all(len(v) == 20 for q, v in expected.items() if q < 1000)  # ties by id, with many copies
    assert found(spark, rows[:15]) == {q: v for q, v in nearest(rows[:15]).items() if v}  # fewer candidates than asked for
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert dimension_scan.search(empty, empty).count() == 0


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths", "copies"])
def test_many_vectors_are_found_by_lists(spark, kind):
    g = np.random.default_rng(7)
    n, d = 6000, 48
    x = g.standard_normal((n, d))
    if kind == "clusters":
        x = 3 * g.standard_normal((60, d))[g.integers(0, 60, n)] + x
    if kind == "lengths":
        x *= np.exp(g.standard_normal((n, 1)))
    if kind == "copies":  # a third of all rows is one vector, another third nearly so
        x[: n // 3] = x[0]
        x[n // 3 : 2 * n // 3] = x[0] + 1e-3 * x[n // 3 : 2 * n // 3]
    rows = list(zip(range(n), x.tolist(), strict=True))
    got = found(spark, rows)
    q = np.arange(0, n, 20)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    exact = np.take_along_axis(scores, np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)[:, :20], axis=1)
    # Recall by score: a copy is as good as its original.
    hit = [np.sum(np.array([s for _, s in got[k]]) >= e[-1] - 1e-9) / 20 for k, e in zip(q.tolist(), exact, strict=True)]
    assert sorted(got) == q.tolist() and all(len(v) == 20 for v in got.values())
    assert np.mean(hit) >= 0.9
    for k, v in got.items():
        assert all(abs(s - float(x[k] @ x[i])) < 1e-9 for i, s in v) and v == sorted(v, key=lambda y: (-y[1], y[0]))


def test_scan_gives_up_early_and_probes_follow_the_data():
    g = np.random.default_rng(3)
    centres = 4 * g.standard_normal((40, 64))
    x = centres[g.integers(0, 40, 4000)] + g.standard_normal((4000, 64))
    lists = dimension_scan.Lists(x, 32, 20, 0.95)
    assert lists.probes < 8 < dimension_scan.Lists(g.standard_normal((4000, 64)), 32, 20, 0.95).probes
    block = dimension_scan._Block.__new__(dimension_scan._Block)
    block.ids, block.q, block.bits = np.arange(0, 4000, 20), x[::20], np.full((200, 1), 128, np.uint8)
    block.least = np.sort(block.q @ x.T, axis=1)[:, -40]
    scan = dimension_scan.Scan(block, 20)
    for k in range(0, 4000, 1000):
        scan.add(0, np.arange(k, k + 1000), x[k : k + 1000])
    assert scan.made < 0.6 * scan.whole
    hits = scan.hits().to_pydict()
    assert len(hits["id"]) == 20 * 200
