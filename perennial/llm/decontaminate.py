"""Benchmark decontamination: a broadcast set of benchmark n-grams against every training window.

Normalisation lower-cases A-Z and takes runs of digits, letters a-z and non-ASCII characters as words. Every
run of `n` consecutive words of a benchmark item is a window; an item of fewer words, but not none, is one window.
A document is scanned once: the hashes of its windows are looked up in the broadcast set, and each hit is verified
against the words themselves before it counts. No shuffle takes place.

Scale: the set is broadcast only in blocks of `block_bytes` of benchmark text, as sorted arrays of 20 bytes a window
beside the words. A larger benchmark is dealt into several blocks by hash; the documents then pass all blocks one after
the other, with a checkpoint between, so that one worker never holds more than one block.

Defined results: a null text has no words; a null doc_id or a repeated row is a row of its own; an item without
text or words has no windows; an item without an id still hits words but is left out of the list of items; an empty
benchmark hits nothing, an empty table gives no rows; texts of any length are read whole; other columns of either table
are not looked at, but for the one that is carried along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .shared import cut, keyed, small_batches, table

STATE = "doc_id long, text string, hit binary, items array<string>"
FOUND = "doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, clean_text string"


@dataclass
class Windows:
    """The windows of one length of a block of the benchmark, as arrays sorted by hash: 20 bytes a window."""

    flags: np.ndarray  # by the upper 20 bits of a hash: is there one?
    keys: np.ndarray  # distinct hashes
    first: np.ndarray  # of each, its first window; one more at the end
    start: np.ndarray  # of each window, its words in Index.words
    end: np.ndarray
    item: np.ndarray  # its item's number


@dataclass
class Index:
    words: bytes  # the normalised words of the block, a space after each
    ids: list[str | None]
    windows: dict[int, Windows]

    def items_of(self, size: int, key: int, words: bytes) -> tuple[str, ...] | None:
        """The items with this window, verified on the words; none if there is no such window."""
        at = self.windows[size]
        k = int(np.searchsorted(at.keys, np.uint64(key)))
        same = [i for i in range(at.first[k], at.first[k + 1]) if self.words[at.start[i] : at.end[i]] == words]
        return tuple({self.ids[at.item[i]] for i in same} - {None}) if same else None


def _joined(words: ta.Words) -> tuple[bytes, np.ndarray]:
    """(all words with a space after each, the end of each word there)."""
    sizes = words.ends - words.starts + 1
    ends = np.cumsum(sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
    out = np.full(len(place), 32, np.uint8)
    letter = place < np.repeat(sizes - 1, sizes)
    out[letter] = words.data[(np.repeat(words.starts, sizes) + place)[letter]]
    return out.tobytes(), ends - 1


def build_index(items: Iterable[tuple[str | None, str | None]], n: int) -> Index:
    ids, texts, parts, held, length = [], [], [], {}, 0

    def take() -> None:
        nonlocal length
        base = len(ids) - len(texts)
        data, offsets = ta.text_buffer(pa.array(texts, pa.string()))
        words = ta.Words(ta.LOWER[data], offsets, ta.ALNUM)
        hashes, counts = words.hashes(), words.counts
        joined, ends = _joined(words)
        begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        doc = words.doc()
        for size in sorted(set(np.minimum(counts, n).tolist()) - {0}):
            at = np.flatnonzero(ta.window_starts(words.first, size))  # of items of fewer words than n the whole only
            at = at[(counts[doc[at]] == size) | (size == n)] if len(at) else at
            found = (ta.window_hashes(hashes, size)[at], begins[at] + length, ends[at + size - 1] + length, doc[at] + base)
            held.setdefault(size, []).append(tuple(x.astype(t) for x, t in zip(found, (np.uint64, np.uint32, np.uint32, np.uint32), strict=True)))
        parts.append(joined)
        length += len(joined)
        texts.clear()

    for item, text in items:
        ids.append(None if item is None else str(item))
        texts.append(text)
        if len(texts) == 1024:
            take()
    if texts:
        take()
    windows = {}
    for size, found in held.items():
        hashes, start, end, item = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        flags = np.zeros(1 << 20, bool)
        flags[hashes >> np.uint64(44)] = True
        windows[size] = Windows(flags, hashes[first], np.append(first, len(hashes)), start[order], end[order], item[order])
    return Index(b"".join(parts), ids, windows)


def scan_batch(words: ta.Words, index: Index) -> tuple[np.ndarray, dict[int, set]]:
    """(hit flag of each word, {document's number: item ids}) of a batch."""
    hit, items = np.zeros(len(words), bool), defaultdict(set)
    hashes = words.hashes()
    for size, windows in index.windows.items():
        keys, seen = windows.keys, {}
        at = ta.window_hashes(hashes, size)
        maybe = np.flatnonzero(windows.flags[at >> np.uint64(44)] & ta.window_starts(words.first, size))
        place = np.minimum(np.searchsorted(keys, at[maybe]), len(keys) - 1)
        maybe = maybe[keys[place] == at[maybe]]
        docs = np.searchsorted(words.first, maybe, side="right") - 1
        for i, d in zip(maybe.tolist(), docs.tolist(), strict=True):
            text = words.text(i, i + size)
            if text not in seen:
                seen[text] = index.items_of(size, int(at[i]), text)
            if seen[text] is not None:
                hit[i : i + size] = True
                items[d].update(seen[text])
    return hit, items


def _spans(words: ta.Words, hit: np.ndarray, lo: int, hi: int, base: int) -> list[dict]:
    """Maximal runs of hit words of one document, in bytes of its text."""
    flags = np.concatenate(([False], hit[lo:hi], [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return [{"start": int(words.starts[lo + a] - base), "end": int(words.ends[lo + b - 1] - base)} for a, b in edges.reshape(-1, 2).tolist()]


def _pass(index, last: bool):
    """One block of the benchmark over an iterator of batches."""

    def run(batches):
        found = index.value
        for batch in batches:
            for part in ta.slices(batch, "text"):
                data, offsets = ta.text_buffer(part.column("text"))
                words = ta.Words(ta.LOWER[data], offsets, ta.ALNUM)
                hit, items = scan_batch(words, found)
                if "hit" in part.schema.names:  # what earlier blocks found
                    for d, (bits, ids) in enumerate(zip(part.column("hit").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        if bits:
                            lo, hi = words.first[d], words.first[d + 1]
                            hit[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
                            items[d].update(ids)
                bounds = list(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))
                names = [c for c in part.schema.names if c == "carried"]
                more = [part.column(c) for c in names]
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[words.first[1:]] - total[words.first[:-1]]
                ids = pa.array([sorted(items.get(d, ())) for d in range(len(bounds))], pa.list_(pa.string()))
                if not last:
                    bits = pa.array([np.packbits(hit[lo:hi]).tobytes() if k else None for (lo, hi), k in zip(bounds, n_hit, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), bits, ids, *more], ["doc_id", "text", "hit", "items", *names])
                    continue
                spans, clean = [], []
                texts = part.column("text")
                for d, (lo, hi) in enumerate(bounds):
                    runs = _spans(words, hit, lo, hi, offsets[d]) if n_hit[d] else []
                    spans.append(runs)
                    if not runs:
                        clean.append(texts[d].as_py())
                        continue
                    raw, at, kept = data[offsets[d] : offsets[d + 1]].tobytes(), 0, []
                    for r in runs:
                        kept.append(raw[at : r["start"]])
                        at = r["end"]
                    clean.append(b"".join([*kept, raw[at:]]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), texts.cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), ids, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(clean, pa.string()), *more],
                    ["doc_id", "text", "n_words", "n_hit", "items", "spans", "clean_text", *names],
                )

    return run


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, carry: str | None = None) -> DataFrame:
    """Per document: n_words, n_hit, the items found, the hit spans (bytes of the text) and the text without them.
    The column `carry`, such as a struct of the whole row, comes along as `carried`."""
    spark = small_batches(docs).sparkSession
    items = benchmark.select(F.col(item_key).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()  # a repeated row says nothing new
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    if blocks > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    state = keyed(docs, key, text) if carry is None else docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(carry).alias("carried"))
    carried = [f for f in state.schema.fields if f.name == "carried"]
    for b in range(blocks):
        block = items.where(F.col("block") == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(build_index(((r[0], r[1]) for r in block.select("item_id", "text").toLocalIterator()), n))
        last = b == blocks - 1
        state = state.mapInArrow(_pass(index, last), T.StructType([*T.StructType.fromDDL(FOUND if last else STATE).fields, *carried]))
        if not last:
            state = cut(state)
    return state


def is_contaminated(least_share: float = 0.0) -> Column:
    """The rule to drop whole documents by: more than this share of their words is hit."""
    return F.col("n_hit") > F.lit(least_share) * F.col("n_words")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.i, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
}
QUERIES = {"op1_decontamination": op1_decontamination}
