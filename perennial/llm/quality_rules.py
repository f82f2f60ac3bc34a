"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditions.

Statistics are counted over whole texts, a batch at a time. Sequential covering then learns, from labelled rows,
conjunctions of thresholds that find low quality: each rule is grown by information gain on two thirds of the rows
that no earlier rule covers, pruned on the other third, and kept if it is precise enough there. The list becomes
one `when ... when ... otherwise` over the statistics, so it can be read, and applying it is plain Spark.

The rules are learned on at most about `sample` labelled rows, chosen by a hash of the key; all rows are judged.

Defined results: a null text has no words; documents below the base rules are failed before the list is asked;
with no labels (or labels of one kind only) the list is empty and only the base rules speak; ratios of a text
without words, marks or lines are 0; rows are independent, so repeats and null keys need no rule; a text is counted
whole, whatever its length; an empty table gives no rows; other columns of docs, of any name, are not looked at. Of
several labels of one id the worst counts, and of several texts of one id the one whose statistics sort first.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import keyed, sampled, table

if TYPE_CHECKING:  # pandas is needed on the driver only, where Spark brings it
    import pandas as pd

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: The statistics that rules may use: (name, numerator, denominator).
RATIOS = (
    ("word_length", "word_chars", "n_words"), ("symbol_share", "n_symbols", "word_chars"), ("mark_share", "n_marks", "word_chars"),
    ("upper_share", "n_upper", "word_chars"), ("digit_share", "n_digits", "word_chars"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"), ("distinct_share", "n_distinct", "n_words"), ("line_words", "n_words", "n_lines"),
)
FEATURES = (*(r[0] for r in RATIOS), "n_words")


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters)] = 1
    return out


_SYMBOLS, _UPPER, _DIGITS = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_MARKS = _flags(bytes(c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123) and c not in b".,'-"))
_WORD_CHARS = np.ones(256, np.int64)
_WORD_CHARS[ta.SPACE] = 0
_WORD_CHARS[0x80:0xC0] = 0  # the later bytes of a character


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(does the key occur twice or more?, is it the first of its kind?) for each entry."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first[order[1:][same]] = False
    return twice, first


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words, lines = ta.Words(data, offsets), ta.Words(data, offsets, np.arange(256) != 10)
    hashes = words.hashes()
    salt = ta.mix(words.doc().astype(np.uint64) + np.uint64(1))
    windows = ta.window_hashes(hashes, 3)
    ok = np.flatnonzero(ta.window_starts(words.first, 3))
    twice, _ = _repeated(ta.mix(windows[ok] ^ salt[ok]))
    in_window = np.zeros(len(words) + 2, bool)
    for k in range(3):
        in_window[ok[twice] + k] = True
    first_word = np.searchsorted(words.starts, lines.starts)
    has_word = (first_word < len(words)) & (np.append(words.starts, 0)[np.minimum(first_word, len(words))] < lines.ends) if len(words) else np.zeros(len(lines), bool)
    line_docs = lines.doc()[has_word]
    _, first = _repeated(ta.mix(lines.hashes()[has_word] ^ ta.mix(line_docs.astype(np.uint64) + np.uint64(1))))
    n = len(offsets) - 1
    _, new_word = _repeated(ta.mix(hashes ^ salt))
    return {
        "n_words": words.counts, "word_chars": _per_doc(_WORD_CHARS[data], offsets), "n_symbols": _per_doc(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_docs[~first], minlength=n), "n_repeat_words": _per_doc(in_window[: len(words)], words.first),
        "n_lines": np.bincount(line_docs, minlength=n), "n_upper": _per_doc(_UPPER[data], offsets), "n_digits": _per_doc(_DIGITS[data], offsets),
        "n_marks": _per_doc(_MARKS[data], offsets), "n_distinct": _per_doc(new_word, words.first),
    }


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with COUNTS and RATIOS, one row a document."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, "text"):
                counts = count_batch(*ta.text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    out = keyed(docs, key, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumns({name: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0) for name, n, d in RATIOS})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        x = rows[self.feature].to_numpy(float)
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _holds(rule: list[Condition], rows: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _grow(rows: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    rule, inside = [], np.ones(len(rows), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for feature, values in cuts.items():
            x = rows[feature].to_numpy(float)
            above = x[:, None] > values
            for side, hit in ((True, above), (False, ~above)):
                p, n = (hit & (inside & bad)[:, None]).sum(0), (hit & (inside & ~bad)[:, None]).sum(0)
                gains = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gains.argmax())
                if gains[k] > gain:
                    best, gain = Condition(feature, side, float(values[k])), gains[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return rule


def learn_rules(rows: pd.DataFrame, bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, least: int = 4) -> list[list[Condition]]:
    """The ordered list of conjunctions that find bad rows. `rows` has FEATURES; the result depends on it alone."""
    rows = rows.reset_index(drop=True)
    third = np.arange(len(rows)) % 3 == 2
    left, rules = np.ones(len(rows), bool), []
    while len(rules) < most_rules and (left & bad).sum() >= least:
        grow, prune = left & ~third, left & third
        if not (grow & bad).any():
            break
        cuts = {f: np.unique(np.quantile(rows.loc[grow, f].to_numpy(float), np.linspace(0.01, 0.99, 50))) for f in FEATURES}
        rule = _grow(rows[grow].reset_index(drop=True), bad[grow], cuts, most_conditions)
        if not rule:
            break

        def worth(r: list[Condition], held: pd.DataFrame = rows[prune], held_bad: np.ndarray = bad[prune]) -> float:
            hit = _holds(r, held)
            p, n = (hit & held_bad).sum(), (hit & ~held_bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)  # the longest of equal ones
        hit = _holds(rule, rows) & left
        if hit[bad].sum() < least or hit[bad].sum() < precision * hit.sum() or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_column(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        condition = F.lit(True)
        for c in rule:
            condition &= c.column()
        out = F.when(condition, k).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 12_000) -> list[list[Condition]]:
    """Rules from labelled documents (1 is good, 0 is bad)."""
    labelled = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = sampled(labelled, labelled.count(), sample, 7, "doc_id")
    chosen = keyed(docs, key, text).join(F.broadcast(labelled), "doc_id")  # bounded by `sample`
    # Of the texts that share an id one is taken, in Spark: however many rows an id has, `sample` rows come to the driver.
    order = F.struct(*(x.alias(f"_{i}{j}") for i, f in enumerate(FEATURES) for j, x in enumerate((F.col(f).isNull(), F.col(f)))))
    rows = text_statistics(chosen.select("doc_id", "text")).join(F.broadcast(labelled), "doc_id").groupBy("doc_id", "label").agg(F.min(order).alias("least"))
    rows = rows.select("doc_id", "label", *(F.col(f"least._{i}1").alias(f) for i, f in enumerate(FEATURES))).toPandas().sort_values("doc_id")
    return learn_rules(rows, rows["label"].to_numpy() == 0) if len(rows) else []


def judge(docs: DataFrame, rules: list[list[Condition]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics with base_failed, the number of the rule that holds, and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = text_statistics(docs, key, text).withColumn("base_failed", failed).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_quality_rules": op10_quality_rules}
