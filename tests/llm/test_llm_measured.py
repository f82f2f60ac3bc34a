"""Queries against plain definitions: DuckDB for base columns, brute force for predictions, planted cases for what is learned."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from perennial import llm
from perennial.llm import language_id, pii, quality_rules

SF = "/root/testdata/sf0.001"
M32 = (1 << 32) - 1


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def _plain_language(text: str, model) -> tuple[str, float]:
    """Scores word by word and the best path by plain dynamic programming."""
    words = re.findall(rb"(?:[A-Za-z]|[\x80-\xff])+", text.encode())
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    lower = lambda w: bytes(c + 32 if 65 <= c <= 90 or (k and w[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97) else c for k, c in enumerate(w))
    mixed = lambda x: ((x ^ (x >> 15)) * 0x2C1B3C6D & M32) >> 17
    rows = []
    for word in words:
        b = b" " + lower(word) + b" "
        score = np.zeros(len(model.languages))
        for k in range(len(b) - 2):
            three = (b[k] * 0x9E3779B1 ^ b[k + 1] * 0x85EBCA6B ^ b[k + 2] * 0xC2B2AE35) & M32
            score += model.three[mixed(three)]
            if k + 3 < len(b):
                score += model.four[mixed(three ^ (b[k + 3] * 0x27D4EB2F & M32))]
        allowed = model.allowed[max(int(language_id._SCRIPT[c]) for c in word)]
        rows.append(score - 100 * (~allowed & allowed.any()))
    best = [[(s, [k]) for k, s in enumerate(rows[0])]]
    for row in rows[1:]:
        last = best[-1]
        best.append([max(((last[j][0] - (12.0 if j != k else 0.0) + row[k], [*last[j][1], k]) for j in range(len(row))), key=lambda x: x[0]) for k in range(len(row))])
    path = max(best[-1], key=lambda x: x[0])[1]
    letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(model.languages))
    return model.languages[int(letters.argmax())], float(letters.max() / letters.sum())


def test_language_id_is_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    few = {i: t for i, t in texts.items() if t and len(t) < 3000}
    few |= {9001: "das haus und der the house und der hügel", 9002: "12 -- 3", 9003: "— €", 9004: "Привет the world", 9005: "ÀÉ él été"}
    got = language_id.identify(spark.createDataFrame(list(few.items()), "doc_id long, text string"), model).collect()
    assert len(got) == len(few) > 100
    for r in got:
        pred, score = _plain_language(few[r["doc_id"]], model)
        assert (r["doc_id"], r["lang_pred"]) == (r["doc_id"], pred) and abs(r["lang_score"] - score) < 1e-6


BASE_QUALITY = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)"""


def test_quality_query_is_the_sql_and_its_own_rules(spark):
    sf = "/root/testdata/sf0.01"
    got = llm.queries()["op10_quality_rules"](spark, sf).toPandas().sort_values("doc_id")
    want = connect(sf).sql(BASE_QUALITY).df().sort_values("doc_id")
    for c in want.columns:
        assert (c, (got[c].to_numpy() == want[c].to_numpy()).all()) == (c, True)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = quality_rules.text_statistics(docs).toPandas().sort_values("doc_id")
    fires = np.zeros(len(rows), bool)
    for rule in rules:
        fires |= quality_rules._holds(rule, rows)
    assert (got["kept"].to_numpy() == (~got["base_failed"].to_numpy() & ~fires)).all()


def test_quality_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    judged = quality_rules.judge(docs, quality_rules.fit_rules(docs, labels.where(~held))).join(labels.where(held), "doc_id").where("not base_failed")
    shares = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert shares[1] > 0.95 and shares[0] < 0.4


def test_pii_query_counts_base_kinds_as_sql(spark):
    got = {r["doc_id"]: (r["n_email"], r["n_ip"]) for r in llm.queries()["op6_pii"](spark, SF).collect()}
    sql = r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS e,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS i FROM documents"""
    assert got == {r[0]: (r[1], r[2]) for r in connect(SF).sql(sql).fetchall()}


def _planted(r: random.Random) -> list[tuple[str, str | None]]:
    """(text, the personal datum in it or None): planted data in forms that the trees know: those of their templates and strict patterns (README says how other forms fare)."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick(letters, r.randint(3, 9))
    made = []
    for _ in range(40):
        mixed = letters + letters.upper() + digits
        yes = [
            f"AKIA{pick(letters.upper() + digits, 16)}", f"ghp_{pick(mixed, 36)}", f"sk-{pick(mixed, 40)}", pick("0123456789abcdef", 40),
            f"({r.randint(201, 989)}) {r.randint(200, 999)}-{pick(digits, 4)}", f"{r.randint(201, 989)}.{r.randint(200, 999)}.{pick(digits, 4)}",
            f"{word()} [at] {word()} [dot] com", f"{word()}(at){word()}(dot)org", f"{r.randint(101, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
            f"DE{pick(digits, 2)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 2)}",
        ]
        no = [
            f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"version {r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}", f"{word()}_{word()}_{word()}_{r.randint(1, 99)}",
            f"chapter {r.randint(1, 99)} of {r.randint(100, 999)}", f"{r.randint(1, 999)},{pick(digits, 3)},{pick(digits, 3)}", f"look at {word()} and the dot of {word()}", f"/{word()}/{word()}/{word()}2/{word()}", f"{word()}-{word()}-{word()}",
        ]
        made += [(f"{word()} {word()} {x} {word()} {word()}", x) for x in yes] + [(f"{word()} {word()} {x} {word()}", None) for x in no]
    return made


def test_pii_added_spans_on_planted_data(spark):
    selector = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    found = caught = planted = wrong = 0
    for text, datum in _planted(random.Random(17)):
        spans = selector.added(text, pii.base_spans(text))
        found += bool(spans)
        wrong += bool(spans) and datum is None
        planted += datum is not None
        caught += datum is not None and any(s <= text.index(datum) and e >= text.index(datum) + len(datum) for _, s, e in spans)
    assert caught / planted > 0.9 and (found - wrong) / found > 0.95


def test_pii_overlaps_are_the_plain_ones():
    r = random.Random(6)
    for _ in range(300):
        spans, plain = pii.Spans(), []
        for _ in range(40):
            s = r.randint(0, 90)
            e = s + r.randint(1, 12)
            free = not any(s < y and x < e for x, y in plain)
            assert spans.free(s, e) == free
            if free or r.random() < 0.2:
                spans.cover(s, e)
                plain.append((s, e))
