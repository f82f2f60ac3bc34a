"""Personal data: fixed base formats, and boosted trees over the candidates of high-recall generators.

Base kinds (email, ip, card, phone) are formats with checks; their spans always stay. Beside them, loose generators
propose overlapping candidate spans: key and value pairs, long mixed tokens, numbers in groups, spelled-out e-mail
addresses. Gradient-boosted trees score each candidate by its format and its surroundings, and per kind a threshold,
calibrated on candidates held out from training to a wanted precision, selects what is redacted. Candidates
within one of another kind that is about as likely, and those that overlap a base span, are dropped; of overlapping
candidates the likeliest is taken.

The trees are trained on seeds made from templates (a fixed number of them) and on the candidates of about `sample`
documents, labelled by strict forms of the formats. Each text is read whole, in time linear in its length but for the
sorting of its candidates.

Defined results: a null text is empty and has no spans; rows are independent, so repeats and null keys need no rule; an
empty table gives no rows (the trees then know the templates alone); columns of docs that are named as the three
results are replaced by them, others stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .shared import sampled, small_batches, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "contact", "identity")
KINDS = (*BASE, *ADDED)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits, as it would then also begin at the run's start: no restarts there.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DIGITS = re.compile("[0-9]+")
_HAS_DIGIT = re.compile("[0-9]")
_HAS_SIGN = re.compile("[=:]")
_AT_DOT = r"(?:@|at)\s?[\])]?\s?[a-z0-9-]{1,63}\s?[\[(]?\s?dot\s?[\])]?\s?[a-z]{2,10}(?![a-z])"
_HAS_AT_DOT = re.compile(f"(?i){_AT_DOT}")

#: Loose generators: kind, what any match holds (without it in the text none is sought), pattern. A group named x is the
#: span; without one the whole match is. Values and tokens may be of any length: neither is begun anew within itself.
GENERATORS = (
    ("secret", _HAS_SIGN, re.compile(r"""(?i)(?<![a-z])(?:pass(?:word|wd)?|pwd|secret|token|api[_ -]?key|auth)["']?\s{0,3}[=:]\s{0,3}["']?(?P<x>[^\s"',;]{6,})""")),
    ("secret", _HAS_DIGIT, re.compile(r"(?<![A-Za-z0-9+/_-])(?P<x>(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2})(?![A-Za-z0-9+/_-])")),
    ("contact", _HAS_DIGIT, re.compile(r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")),
    ("contact", _HAS_AT_DOT, re.compile(r"(?i)[a-z0-9._%+-]{1,64}\s?[\[(]?\s?" + _AT_DOT)),
    ("identity", _HAS_DIGIT, re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("identity", _HAS_DIGIT, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
#: Words that speak for a kind when they stand shortly before a candidate.
CUES = {
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential"),
    "contact": ("call", "phone", "tel", "mobile", "fax", "contact", "mail", "reach"),
    "identity": ("ssn", "social security", "iban", "account", "passport", "id number"),
}
#: Strict forms, which label the candidates of sampled documents.
_STRICT = {
    "secret": re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,64}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}"),
    "contact": re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}|.*[\[(](?:at)[\])].*"),
    "identity": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,36}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind and start: leftmost and non-overlapping within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _HAS_DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of all generators, each once."""
    found, held = {}, {}
    for kind, need, pattern in GENERATORS:
        if need not in held:
            held[need] = need.search(text) is not None
        if held[need]:
            for m in pattern.finditer(text):
                found.setdefault((kind, *(m.span("x") if "x" in pattern.groupindex else m.span())))
    return list(found)


FEATURES = ("length", "digits", "upper", "lower", "marks", "spaces", "distinct", "entropy", "switches", "cue", "assigned", "quoted", "edge", "letters_before", "hex", "longest_letters", "groups", "first_length", "last_length", "first_value", "second_value", "separator", "brackets")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    n = len(s)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" if c.isspace() else "m" for c in s]
    counts, kinds = Counter(s), Counter(classes)
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    tail = before.rstrip("\"' ")
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    letters = max(map(len, re.findall("[A-Za-z]+", s)), default=0)
    groups = _DIGITS.findall(s)
    value = lambda g: int(g) if len(g) <= 4 else -1
    separator = next((1 + "- .".index(c) for c in s[1:] if c in "- ."), 0)
    return [
        n, kinds["d"] / n, kinds["u"] / n, kinds["l"] / n, kinds["m"] / n, kinds["s"] / n, len(counts) / n, entropy,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n, any(c in before.lower() for c in CUES[kind]), tail[-1:] in ("=", ":"), before[-1:] in ("'", '"'),
        (not before or before[-1].isspace()) + (not after or after.isspace() or after in ".,;"), sum(map(str.isalpha, before[-10:])), all(c in "0123456789abcdefABCDEF" for c in s), letters,
        len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, value(groups[0]) if groups else -1, value(groups[1]) if len(groups) > 1 else -1, separator, sum(map(s.count, "[]()")),
    ]


@dataclass
class Trees:
    """Gradient boosting for the logistic loss with trees of depth 3 over histogram bins."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[list[int], list[int], np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 2.0) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19))) for j in range(x.shape[1])]
        bins = self._bins(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node, features_, bounds = np.zeros(len(y), int), [-1] * 7, [0] * 7
            for k in range(7):  # nodes of the three upper levels, as in a heap
                here = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                if len(here) >= 8:
                    total_g, total_h = grad[here].sum(), hess[here].sum()
                    for j, c in enumerate(self.cuts):
                        g, h = (np.cumsum(np.bincount(bins[here, j], weights=v[here], minlength=len(c) + 1))[:-1] for v in (grad, hess))
                        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                features_[k], bounds[k] = best[1], best[2]
                right = bins[here, best[1]] > best[2] if best[1] >= 0 else np.zeros(len(here), bool)
                node[here] = 2 * k + 1 + right
            g, h = (np.bincount(node - 7, weights=v, minlength=8) for v in (grad, hess))
            leaf = rate * g / (h + ridge)
            self.trees.append((features_, bounds, leaf))
            score += leaf[node - 7]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features_, bounds, leaf in self.trees:
            node, f, b = np.zeros(len(x), int), np.array(features_), np.array(bounds)
            for _ in range(3):
                j = f[node]
                node = 2 * node + 1 + ((j >= 0) & (bins[rows, np.maximum(j, 0)] > b[node]))
            out += leaf[node - 7]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Platt's scaling on held-out candidates, by Newton steps."""
        z, a, b = self.raw(x), 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, r = p * (1 - p) + 1e-9, t - p
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


class Spans:
    """Spans that are taken, joined where they overlap and sorted, so that a look-up takes the logarithm of their number."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k == len(self.starts) or self.starts[k] >= end

    def cover(self, start: int, end: int) -> None:
        lo, hi = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


@dataclass
class Selector:
    trees: dict[str, Trees]
    thresholds: dict[str, float]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        free = Spans()
        for _, s, e in base:
            free.cover(s, e)
        found = [c for c in candidates(text) if free.free(*c[1:])] if text else []
        scored = []
        for kind in ADDED:
            mine = [c for c in found if c[0] == kind]
            if mine:
                p = self.trees[kind].probability(np.array([features(text, *c) for c in mine], float))
                scored += [(c[1], -c[2], v, kind) for v, c in zip(p.tolist(), mine, strict=True) if v >= self.thresholds[kind]]
        held, around = [], []
        for s, e, v, kind in sorted(scored):  # around: what reaches beyond s, one a generator at most
            around = [x for x in around if x[1] < -s]
            if not any(end <= e and other != kind and u > v - 0.1 for _, end, u, other in around):
                around.append((s, e, v, kind))
                held.append((-v, s, -e, kind))
        taken: list[tuple[str, int, int]] = []
        for _, s, e, kind in sorted(held):
            if free.free(s, e):
                free.cover(s, e)
                taken.append((kind, s, e))
        return sorted(taken, key=lambda x: (ADDED.index(x[0]), x[1]))


def seeds(n: int = 400) -> list[tuple[str, str, int]]:
    """(kind, text, is it one?) made from templates, the same each time."""
    r = np.random.default_rng(5)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    digits, hexa, upper, lower = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(lower, r.integers(3, 9))
    about = lambda: " ".join(word() for _ in range(3))
    yes = {
        "secret": (lambda: f"AKIA{pick(upper + digits, 16)}", lambda: f"password={pick(hexa, 18)}", lambda: f'token = "{pick(hexa, 40)}"', lambda: f"api_key: {pick(upper + lower + digits, 32)}", lambda: f"ghp_{pick(upper + lower + digits, 36)}"),
        "contact": (lambda: f"call {r.integers(200, 999)}-{r.integers(200, 999)}-{pick(digits, 4)}", lambda: f"({r.integers(200, 999)}) {r.integers(200, 999)}-{pick(digits, 4)}", lambda: f"{r.integers(200, 999)}.{r.integers(200, 999)}.{pick(digits, 4)}", lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}.{word()} (at) {word()} dot org", lambda: f"{word()}(at){word()}(dot)net", lambda: f"tel {r.integers(200, 999)} {r.integers(200, 999)} {pick(digits, 4)}"),
        "identity": (lambda: f"ssn {r.integers(100, 660)}-{r.integers(10, 99)}-{r.integers(1000, 9999)}", lambda: f"{r.integers(100, 660)}-{r.integers(10, 99)}-{r.integers(1000, 9999)}", lambda: f"IBAN {pick(upper, 2)}{pick(digits, 20)}", lambda: f"{pick(upper, 2)}{pick(digits, 2)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)}"),
    }
    no = {
        "secret": (lambda: f"{word()}_{word()}_{word()}{r.integers(1, 99)}", lambda: f"{word()}-{word()}-{word()}-{r.integers(1, 9)}", lambda: pick(digits, r.integers(16, 22)), lambda: f"token: {word()}", lambda: f"{word()}/{word()}/{word()}{r.integers(1, 99)}/{word()}", lambda: f"secret = {word()}{word()}"),
        "contact": (lambda: f"{r.integers(1900, 2030)}-{r.integers(100, 366)}-{pick(digits, 3)}", lambda: f"{pick(digits, 2)}.{pick(digits, 3)}.{pick(digits, 3)}", lambda: f"isbn {pick(digits, 3)}-{pick(digits, 4)}-{pick(digits, 5)}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"0{pick(digits, 1)} {pick(digits, 3)} {pick(digits, 3)}"),
        "identity": (lambda: f"part 9{pick(digits, 2)}-00-{pick(digits, 4)}", lambda: f"{pick(digits, 3)} {pick(digits, 2)} {pick(digits, 4)}", lambda: f"{pick(upper, 2)}{pick(digits, 2)} {pick(upper, 4)} {pick(upper, 4)}", lambda: f"000-{pick(digits, 2)}-{pick(digits, 4)}", lambda: f"{r.integers(900, 999)}-{pick(digits, 2)}-{pick(digits, 4)}"),
    }
    return [(kind, f"{about()} {made()} {about()}", label) for label, source in ((1, yes), (0, no)) for kind, makers in source.items() for made in makers for _ in range(n // len(makers))]


def labelled_candidates(text: str, base: list | None = None) -> list[tuple[str, list[float], int]]:
    """Candidates of a text with labels by the strict forms; key and value pairs count if the value holds a digit."""
    out, free = [], Spans()
    for _, s, e in base_spans(text) if base is None else base:
        free.cover(s, e)
    for kind, s, e in candidates(text):
        if free.free(s, e):
            value = text[s:e]
            f = features(text, kind, s, e)
            strict = _STRICT[kind].fullmatch(value) is not None and (kind != "secret" or any(map(str.isalpha, value)))
            out.append((kind, f, int(strict or (kind == "secret" and bool(f[9]) and bool(f[10]) and f[1] > 0.1))))
    return out


def train(rows: list[tuple[str, list[float], int]], precision: float = 0.98) -> Selector:
    """Trees and calibrated thresholds per kind from labelled candidates, every third held out."""
    trees, thresholds = {}, {}
    for kind in ADDED:
        mine = sorted(((f, y) for k, f, y in rows if k == kind), key=lambda r: hashlib.md5(repr(r).encode()).digest())
        x, y = np.array([f for f, _ in mine], float), np.array([v for _, v in mine], float)
        held = np.arange(len(y)) % 3 == 2
        trees[kind] = Trees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        p = trees[kind].probability(x[held])
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1) >= precision
        last = np.flatnonzero(good & np.concatenate((p[order][1:] < p[order][:-1], [True])))
        below = float(p[order][last[-1] + 1]) if len(last) and last[-1] + 1 < len(p) else 0.0
        thresholds[kind] = max(0.5, (float(p[order][last[-1]]) + below) / 2) if len(last) else 1.1  # halfway to the next
    return Selector(trees, thresholds)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4_000) -> Selector:
    """A selector from the seeds and about `sample` documents with a digit."""
    rows = small_batches(docs).select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9]"))
    rows = sampled(rows, rows.count(), sample, 13, "k", "text")

    def propose(batches):
        for batch in batches:
            found = [c for t in batch.column("text").to_pylist() for c in labelled_candidates(t)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.int64())], ["kind", "features", "label"])

    found = [(r[0], list(r[1]), r[2]) for r in rows.select("text").mapInArrow(propose, "kind string, features array<double>, label long").collect()]
    made = []
    for kind, t, label in seeds():
        for k, s, e in candidates(t):
            if k == kind:
                made.append((k, features(t, k, s, e), label))
    return train(made + found)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, as a tag of its first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """All columns of docs with pii_base, pii_added (kind, start, end in code points) and pii_redacted."""
    docs = docs.drop("pii_base", "pii_added", "pii_redacted")
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(selector)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        selector = shared.value
        for batch in batches:
            for part in ta.slices(batch, text):
                base, added, clean = [], [], []
                for t in part.column(text).to_pylist():
                    b = base_spans(t or "")
                    a = selector.added(t or "", b)
                    base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                    added.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in a])
                    clean.append(redact(t, b + a) if a or b else t)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base, arrow), pa.array(added, arrow), pa.array(clean, pa.string())], [*part.schema.names, "pii_base", "pii_added", "pii_redacted"])

    more = [T.StructField("pii_base", SPANS), T.StructField("pii_added", SPANS), T.StructField("pii_redacted", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    joined = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.concat("pii_base", "pii_added")).alias("spans"))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_pii": op6_pii}
