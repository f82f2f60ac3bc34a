"""Language identification of mixed-language text: scripts narrow the candidates, Viterbi labels the words.

A word is a run of letters. Its script comes from the ranges of its characters; only languages in which that script
was seen are candidates. Each candidate scores the word by the log-likelihood of its letter trigrams and quadgrams,
word ends included. Viterbi with a penalty for each switch of language then labels the words of a document, so
that a single odd word does not break a span, and a passage in another language becomes a span of its own. The
language with the most letters is the document's; its share of the letters is the score.

The model is fitted on about `sample` labelled documents, chosen by a hash of key and text; Spark sums its counts.

Defined results: `und` and 0 for a null text, one without letters, or when no label could be learned; a null doc_id
is neither learned from nor held out; repeated rows are rows of their own; an empty table gives no rows; a text is read
whole, whatever its length; labels may be any number (a model holds two arrays of BUCKETS x labels); columns of docs that are named as the three results are replaced by them, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .shared import sampled, small_batches, table

BUCKETS = 1 << 15
#: Scripts by the first byte of their characters in UTF-8 (fixed values of the encoding); the rest is one class.
SCRIPT_OF_LEAD = {"latin": range(0xC3, 0xCA), "greek": range(0xCE, 0xD0), "cyrillic": range(0xD0, 0xD4), "armenian": range(0xD4, 0xD6), "hebrew": range(0xD6, 0xD8), "arabic": range(0xD8, 0xDC), "indic": range(0xE0, 0xE1), "asian": range(0xE1, 0xE2), "han": range(0xE3, 0xEA), "hangul": range(0xEA, 0xEE)}
SCRIPTS = (*SCRIPT_OF_LEAD, "other")
_SCRIPT = np.zeros(256, np.int8)  # ASCII and later bytes: as latin, the least
_SCRIPT[0xC2:] = len(SCRIPTS) - 1
for _k, _leads in enumerate(SCRIPT_OF_LEAD.values()):
    _SCRIPT[list(_leads)] = _k
_SCRIPT[0xE2] = 0  # U+2000 to U+2FFF: punctuation and symbols are of no script, also within a word
#: Latin letters with further marks, U+1E00 to U+1EFF: first byte, and range of the second.
_LATIN_LEAD, _LATIN_SECOND = 0xE1, (0xB8, 0xBB)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; no byte changes its place."""
    out = ta.LOWER[data]
    wide = np.flatnonzero(data == 0xC3) + 1
    wide = wide[wide < len(data)]
    second = data[wide]
    out[wide] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 32, second)
    return out


class LetterWords(ta.Words):
    """Words of letters, with the buckets of their n-grams. Around each word stands a space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(_lower(data), offsets, _LETTER)
        letters = np.concatenate(([0], np.cumsum((self.data >= 97) & (self.data < 123))))
        self.ascii_letters = letters[offsets[1:]] > letters[offsets[:-1]]  # of each document
        # Each document gets a space at its end, so that no n-gram reaches across.
        shifted = np.full(len(data) + len(offsets) + 4, 32, np.uint32)
        place = np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1
        shifted[place] = np.where(_LETTER[data], self.data, 32)
        self.lo = self.starts + self.doc()  # the place of the space before each word
        self.size = self.ends - self.starts
        b = shifted
        three = b[:-3] * np.uint32(0x9E3779B1) ^ b[1:-2] * np.uint32(0x85EBCA6B) ^ b[2:-1] * np.uint32(0xC2B2AE35)
        four = three ^ b[3:] * np.uint32(0x27D4EB2F)
        self.three, self.four = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17) for x in (three, four))

    def script(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.int8)
        edges = np.column_stack((self.starts, self.ends)).ravel()
        edges = edges[:-1] if edges[-1] == len(self.data) else edges
        of_byte = _SCRIPT[self.data]
        lead = np.flatnonzero(self.data[:-1] == _LATIN_LEAD)
        second = self.data[lead + 1]
        of_byte[lead[(second >= _LATIN_SECOND[0]) & (second <= _LATIN_SECOND[1])]] = 0
        return np.maximum.reduceat(of_byte, edges)[::2]

    def gram_places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last place of each word's n-grams (n is 3 or 4)."""
        return self.lo, np.maximum(self.lo, self.lo + self.size + 3 - n)


@dataclass
class Model:
    languages: list[str]
    three: np.ndarray  # BUCKETS x languages
    four: np.ndarray
    allowed: np.ndarray  # scripts x languages

    def scores(self, words: LetterWords) -> np.ndarray:
        """Words x languages; the best candidate of a word has 0."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for n, weights, buckets in ((3, self.three, words.three), (4, self.four, words.four)):
            lo, hi = words.gram_places(n)
            for k in range(len(self.languages)):
                total = np.zeros(len(buckets) + 1)
                np.cumsum(weights[buckets, k], out=total[1:])
                out[:, k] += total[hi] - total[lo]
        allowed = self.allowed[words.script()]
        out -= 100.0 * (~allowed & allowed.any(axis=1, keepdims=True))
        return out - out.max(axis=1, keepdims=True) if len(out) else out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: sum of scores less `penalty` for each switch, for all documents side by side."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, ends = first[:-1][order], -count[order]
    label = np.zeros(len(scores), np.int32)
    if not len(scores) or scores.shape[1] < 2:
        return label
    top, jumped = np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    steps = int(count.max())
    active = np.searchsorted(ends, -np.arange(steps), side="left")  # documents of more than t words
    value = scores[begin[: active[0]]].copy()
    finals = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(1, steps):
        m = active[t]
        if m < len(value):
            finals[m : len(value)] = value[m:]
            value = value[:m]
        at = begin[:m] + t
        best = value.argmax(axis=1)
        switch = value[np.arange(m), best][:, None] - penalty
        top[at] = best
        jumped[at] = switch > value
        value = np.maximum(value, switch) + scores[at]
    finals[: len(value)] = value
    now = finals[: active[0]].argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(jumped[at, now[:m]], top[at], now[:m])
    return label


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 12_000, learnable: Column | None = None) -> Model:
    """A model from labelled documents for which `learnable` holds (default: all with a key)."""
    rows = small_batches(docs).select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), (F.lit(True) if learnable is None else learnable).alias("ok"))
    rows = rows.where("ok and lang is not null and doc_id is not null")
    rows = sampled(rows, rows.select("lang").count(), sample, 11, "doc_id", "text")

    def count(batches):
        for batch in batches:
            for part in ta.slices(batch.select(["text", "lang"]), "text"):
                words, names = LetterWords(*ta.text_buffer(part.column("text"))), np.array(part.column("lang").to_pylist(), object)
                owner, script = names[words.doc()], words.script()
                for name in set(owner):
                    mine = np.flatnonzero(owner == name)
                    parts = [("script", np.bincount(script[mine], minlength=len(SCRIPTS)))]
                    for n, buckets in ((3, words.three), (4, words.four)):
                        lo, hi = words.gram_places(n)
                        inside = ta.covered(len(buckets), lo[mine], (hi - lo)[mine])
                        parts.append((str(n), np.bincount(buckets[inside], minlength=BUCKETS)))
                    for kind, c in parts:
                        k = np.flatnonzero(c)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array([kind] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k], pa.int64())], ["lang", "kind", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, kind string, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = counts[counts.kind == "3"].groupby("lang")["n"].sum().sort_index()
    languages = totals.sort_values(ascending=False, kind="stable").index.tolist()
    weights = {}
    for kind, width in (("3", BUCKETS), ("4", BUCKETS), ("script", len(SCRIPTS))):
        c = np.zeros((width, len(languages)))
        part = counts[counts.kind == kind]
        c[part.bucket.to_numpy(), [languages.index(x) for x in part.lang]] = part.n.to_numpy()
        weights[kind] = c
    log = {k: np.log((weights[k] + 0.5) / (weights[k].sum(axis=0) + 0.5 * BUCKETS)) for k in ("3", "4")}
    log = {k: 0.5 * (w - w.max(axis=1, keepdims=True)).astype(np.float32) if languages else w for k, w in log.items()}
    seen = weights["script"]
    return Model(languages, log["3"], log["4"], seen >= 0.001 * np.maximum(seen.sum(axis=0), 1) if languages else np.zeros((len(SCRIPTS), 0), bool))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = 12.0) -> DataFrame:
    """All columns of docs with lang_pred, lang_score and lang_spans (start and end in bytes of the text, lang)."""
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(held: list, model: Model):
        """Labels what was held: (batch, words, scores) each."""
        scores = np.concatenate([h[2] for h in held])
        first = np.concatenate(([0], np.cumsum(np.concatenate([h[1].counts for h in held]))))
        labels, at, names = viterbi(scores, first, penalty), 0, np.array(model.languages, object)
        for part, words, _ in held:
            mine = labels[at : at + len(words)].astype(np.int64)
            at += len(words)
            doc, n, k = words.doc(), part.num_rows, len(names)
            letters = np.bincount(doc * k + mine, weights=words.size, minlength=n * k).reshape(n, k)
            total, best = letters.sum(axis=1), letters.argmax(axis=1)
            known = total > 0
            for d in np.flatnonzero(known & ~words.ascii_letters).tolist():
                known[d] = any(map(str.isalpha, part.column(text)[d].as_py()))
            start = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])))) if len(words) else np.zeros(0, np.int64)
            end = np.concatenate((start[1:], [len(words)])) - 1 if len(start) else start
            base = words.offsets[doc[start]]
            spans = pa.StructArray.from_arrays([pa.array(words.starts[start] - base, pa.int32()), pa.array(words.ends[end] - base, pa.int32()), pa.array(names[mine[start]], pa.string())], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[start], np.arange(n + 1)), pa.int32()), spans)
            pred = np.where(known, names[best], "und")
            score = np.where(known, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), lists], [*part.schema.names, "lang_pred", "lang_score", "lang_spans"])

    def run(batches):
        model, held, n = shared.value, [], 0
        for batch in batches:
            for part in ta.slices(batch, text):
                words = LetterWords(*ta.text_buffer(part.column(text)))
                held.append((part, words, model.scores(words)))
                words.three = words.four = words.data = None  # only the places are needed from here on
                n += len(words)
                if n > 800_000:  # many documents side by side make the steps of Viterbi cheap
                    yield from label(held, model)
                    held, n = [], 0
        if held:
            yield from label(held, model)

    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_spans": F.array().cast("array<struct<start:int,end:int,lang:string>>")})
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_spans", spans)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


ORACLE: dict[str, str] = {}
QUERIES = {"op9_language_id": op9_language_id}
