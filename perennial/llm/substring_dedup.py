"""Substring dedup on words: anchors at difference-cover positions, extended to whole windows.

A window is `size` (13) consecutive words of one document; a word goes if a window that covers it also starts in a
document with a smaller id. Runs of 7 words are hashed only at places whose number in the document is 0, 1 or 3
modulo 7. As {0, 1, 3} is a difference cover, any two places have a shift of less than 7 that takes both to cover
places, so two equal windows of 13 words share an aligned anchor. Anchors that other documents have too are
then extended: every window of 13 words that holds one is compared as a whole.

First question between groups of documents: which anchors are repeated? Second: has the window an owner with a
smaller id? For both a group sends each hash once, the second time with its smallest document, so no hash is hot.
Windows are compared by 64 bits beside those that name the bucket.

Defined results: a null text has no words; a document without an id neither loses words nor takes any; rows with
equal ids never take words from each other, and rows equal in id and text are handled once; texts of any length are
read whole; other columns of any name are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import groups as gr
from . import textarrays as ta
from .shared import table

#: Difference cover: every difference modulo PERIOD is one of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
WINDOWS = "bucket int, g long, windows binary, docs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, copies long"


class _Group:
    """The words, anchors and windows of a group's documents."""

    def __init__(self, rows: pa.Table, size: int):
        self.rows, self.size = gr.in_order(rows), size
        self.ids, self.valid = gr.doc_ids(self.rows)
        self.data, self.offsets = ta.text_buffer(self.rows.column("text"))
        self.words = ta.Words(self.data, self.offsets)
        self.hashes, self.doc = self.words.hashes(), self.words.doc()
        first = self.words.first
        short = size - PERIOD + 1  # words of an anchor
        place = np.arange(len(self.doc)) - first[:-1][self.doc]
        on_cover = np.isin(place % PERIOD, COVER)
        ok = ta.window_starts(first, short)
        ok &= on_cover[: len(ok)] & self.valid[self.doc[: len(ok)]]
        self.anchors = np.flatnonzero(ok)
        self.found = gr.Distinct(ta.window_hashes(self.hashes, short)[self.anchors])

    def windows(self, bits: pa.Table, n_buckets: int) -> None:
        """Extends the repeated anchors to windows: their starts, hashes and smallest documents."""
        repeated = gr.read_bits(bits, 0, self.found.values, n_buckets)
        doc = self.doc[self.anchors]
        repeated |= self.ids[self.found.first(doc)] != self.ids[self.found.last(doc)]
        at = self.anchors[repeated[self.found.at]]
        begin = np.maximum(at - PERIOD + 1, self.words.first[:-1][self.doc[at]])
        near = ta.covered(len(self.words), begin, at - begin + 1) if len(at) else np.zeros(len(self.words), bool)
        ok = ta.window_starts(self.words.first, self.size)
        self.starts = np.flatnonzero(ok & near[: len(ok)])
        self.window = gr.Distinct(ta.window_hashes(self.hashes, self.size)[self.starts])
        self.owner = self.window.first(self.ids[self.doc[self.starts]])  # documents are in order of their ids

    def second_hashes(self) -> np.ndarray:
        """Another hash of each distinct window, independent of the first."""
        start, out = self.window.first(self.starts), 0
        again = ta.mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D))
        out = np.zeros(len(start), np.uint64)
        for k in range(self.size):
            out = out * np.uint64(0x2545F4914F6CDD1D) + again[start + k]
        return ta.mix(out)

    def removed(self, bits: pa.Table, n_buckets: int) -> np.ndarray:
        elsewhere = gr.read_bits(bits, 1, self.window.values, n_buckets)
        ids = self.ids[self.doc[self.starts]]
        gone = elsewhere[self.window.at] | (ids > self.owner[self.window.at])
        return ta.covered(len(self.words), self.starts[gone], self.size) if gone.any() else np.zeros(len(self.words), bool)


def _smaller_owner(rows: pa.Table) -> pa.Table:
    """Which windows have an owner in another group with a smaller id?"""
    ta.release()
    rows = rows.sort_by("g")
    parts = [np.frombuffer(b, "<u8") for b in rows.column("windows").to_pylist()]
    docs = np.concatenate([np.frombuffer(b, "<i8" if len(b) == 8 * len(p) else "<u4").astype(np.int64) for b, p in zip(rows.column("docs").to_pylist(), parts, strict=True)])
    windows = np.concatenate(parts)
    order = np.lexsort((docs, windows))
    w, d = windows[order], docs[order]
    new = np.concatenate(([True], w[1:] != w[:-1]))
    least = d[new][np.cumsum(new) - 1]
    flags = np.zeros(len(w), bool)
    flags[order] = d > least
    return gr.bits_back(rows.column("g").to_pylist(), [len(p) for p in parts], flags, rows.column("bucket")[0].as_py(), 1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, the digest of the words kept and, if asked for, these words."""
    rows, n_groups = gr.grouped(docs, key, text)
    n_buckets = max(1, n_groups // 3)
    by_group = rows.groupBy("g")

    def anchors(key: tuple, rows: pa.Table) -> pa.Table:
        ta.release()
        return gr.ask_repeated(key[0].as_py(), _Group(rows, size).found, n_buckets)

    repeated = gr.answer_repeated(by_group.applyInArrow(anchors, gr.HASHES), 0)

    def windows(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        ta.release()
        group = _Group(rows, size)
        group.windows(bits, n_buckets)
        second = group.second_hashes().astype("<u8")
        small = not len(group.owner) or (group.owner.min() >= 0 and group.owner.max() < 1 << 32)
        owner = group.owner.astype("<u4" if small else "<i8")
        out = gr.to_buckets(key[0].as_py(), group.window.values, n_buckets, [lambda lo, hi: second[lo:hi].tobytes(), lambda lo, hi: owner[lo:hi].tobytes()])
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "g", "windows", "docs"])

    asked = by_group.cogroup(repeated.groupBy("g")).applyInArrow(windows, WINDOWS)
    owned = asked.groupBy("bucket").applyInArrow(_smaller_owner, gr.BITS)

    def finish(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        ta.release()
        group = _Group(rows, size)
        group.windows(bits, n_buckets)
        gone = group.removed(bits, n_buckets)
        first, digests, texts = group.words.first, [], []
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[first[1:]] - total[first[:-1]]
        keep = ~gone
        for d, n in enumerate(n_removed.tolist()):
            words = group.data[group.offsets[d] : group.offsets[d + 1]].tobytes().split()
            kept = b" ".join(compress(words, keep[first[d] : first[d + 1]].tolist()) if n else words)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        return pa.table([group.rows.column("doc_id"), pa.array(group.words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), group.rows.column("copies")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "copies"])

    return gr.spread(by_group.cogroup(repeated.unionByName(owned).groupBy("g")).applyInArrow(finish, RESULT))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
owner AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN owner USING (win) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
