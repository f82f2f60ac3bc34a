"""The corpus pipeline, stage by stage, against what each stage must do."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from perennial.llm import decontaminate, jaccard, pii
from perennial.llm.shared import stored


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "12 34", "en", "x", 5), (None, "the cat of the house is here and there", "en", "x", 10)], docs.schema)
    docs, columns = stored(docs.unionByName(extra)), docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf))
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert before.join(docs, "doc_id", "left_anti").where("doc_id in (9001, 9002)").count() == 2
        if name == "near_duplicates":
            linked = jaccard.link(before)
            assert docs.where("doc_id is not null").count() == linked.where("doc_id is not null").agg(F.countDistinct("component_id")).first()[0]
            assert docs.where("doc_id is null").count() == 1
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            clean = decontaminate.find(before, bench).where("n_hit = 0").count()
            assert docs.count() == clean and decontaminate.find(docs, bench).agg(F.sum("n_hit")).first()[0] == 0
        if name == "personal_data":
            assert docs.count() == before.count()
            assert all(not pii.base_spans(r["text"]) for r in docs.collect())
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "packing":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert seen == [s for s, _ in corpus_pipeline.STAGES] and docs.columns[-2:] == ["sequence_id", "offset"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(texts):
    """Brute force: for each text the least number of those it is linked with."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 30, 80]))] for _ in range(25)]
    rows = []
    for k in range(160):
        w = list(base[r.randrange(len(base))])
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"x{r.randrange(3)}"
        rows.append((r.randrange(90), " ".join(w)))  # many ids are shared, by equal and by unlike texts
    rows += [(1, "A first text of some words"), (2, "a first text of some words"), (2, "quite another text that nobody else has"), (None, "no id"), (None, "no id"), (95, None), (96, None), (96, "")]
    docs = spark.createDataFrame([(i, t, {"k": k}, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, m map<string,int>, key int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    nodes = sorted({x for x in rows if x[0] is not None}, key=repr)
    label = groups_of([t for _, t in nodes])
    # Rows without an id stay; of every group of (id, text) exactly one is left.
    assert sorted(label[nodes.index(x)] for x in got if x[0] is not None) == sorted(set(label))
    assert sum(x[0] is None for x in got) == 2
    assert ("quite another text that nobody else has") in [t for _, t in got]
    alone = sorted({i: t for i, t in rows if i is not None}.items())
    unique = spark.createDataFrame(alone, "doc_id long, text string").repartition(3)
    label, ids = groups_of([t for _, t in alone]), [i for i, _ in alone]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, unique, "").collect()) == [ids[k] for k in sorted(set(label))]


def test_decontamination_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    hit = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    plain = lambda t: hit.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    windows = set()
    for (text,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect():
        w = plain(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = set()
    for x in docs.collect():
        w = plain(x["text"])
        if not any(tuple(w[i : i + n]) in windows for n in {len(y) for y in windows} for i in range(len(w) - n + 1)):
            clean.add(x["doc_id"])
    assert {x["doc_id"] for x in corpus_pipeline.decontamination(spark, docs, sf).collect()} == clean
