"""Exact substring dedup on bytes by a sparse suffix array.

A byte goes if a string of `size` (100) bytes that covers it also starts earlier (in a document with a smaller id, or
in the same document at an earlier place). Sorting every suffix of the corpus would move each byte a hundred times,
so only suffixes at anchors are sorted: in each window of 100 bytes the place of the least hash of 20 bytes, the
leftmost of equal ones. It depends on the window's bytes alone, so two equal windows have their anchor at the same
place, and every repeat is seen at a suffix that begins at one of its anchors.

1. Groups of documents ask each other which anchors have 60 bytes to the left or to the right that occur twice; any
   window holds one of the two. All other anchors are done.
2. The suffixes of the rest go, with the 80 bytes before them, to buckets by sampled splitters on their leading 20
   bytes. Every window that two suffixes may share holds these 20 bytes, so a boundary never parts suffixes that have
   to be compared. A group sends a suffix with its surroundings once, whatever number of its documents has it.
3. A bucket sorts its suffixes, and the reversed texts before them, by multikey quicksort on words of 8 bytes, and
   takes the common prefixes of neighbours. For each of the 81 places of an anchor in a window, runs of long enough
   common prefixes on both sides are the classes of equal windows; all but the earliest of a class are repeats.

Defined results: a null text is empty; a document without an id loses nothing and takes nothing; rows with equal ids
take nothing from each other, and rows equal in id and text are handled once; texts of any length are read whole; other
columns of any name are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import groups as gr
from . import textarrays as ta
from .shared import table

#: Bytes that choose an anchor, and bytes to either side of it that the first question compares.
GRAM, HALF = 20, 60
SUFFIXES = "lead binary, suffix binary, before binary, doc_id long, g long, row int, start int, entry int"
FOUND = "g long, entries binary, least binary, most binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, copies long"


def anchor_places(hashes: np.ndarray, offsets: np.ndarray, ok: np.ndarray, size: int) -> np.ndarray:
    """The places that windows of `size` bytes, each in one document for which ok holds, choose by their least hash."""
    width = size - GRAM + 1
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    key = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, width)
    to_left = np.minimum.accumulate(blocks, axis=1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(to_right[: n - width + 1], to_left[width - 1 : n])  # of the windows from each place on
    step = np.zeros(len(least) + 1, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - size + 1
    some = ok & (hi > lo)
    np.add.at(step, lo[some], 1)
    np.add.at(step, hi[some], -1)
    chosen = (least[np.cumsum(step[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))] if len(chosen) else chosen


def multikey_order(text: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of bytes: by their first 8 bytes, then only ties by the next 8, and so on."""
    n, width = text.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    keys = padded.view(">u8")
    order = np.argsort(keys[:, 0], kind="stable")
    ordered = keys[order, 0]
    run = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    for k in range(1, keys.shape[1]):
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            break
        within = np.lexsort((keys[order[tied], k], run[tied]))
        order[tied] = order[tied][within]
        new = np.concatenate(([False], run[1:] != run[:-1]))
        value = keys[order[tied], k]
        new[tied[1:]] |= (tied[1:] == tied[:-1] + 1) & (value[1:] != value[:-1])
        run = np.cumsum(new)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in order with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 15):
        hi = min(len(order), lo + (1 << 15))
        differ = text[order[lo:hi]] != text[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    return out


def repeated_windows(suffix: np.ndarray, before: np.ndarray, lengths: tuple[np.ndarray, np.ndarray], owner: tuple[np.ndarray, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) place of the anchor in windows that also start earlier; 255, 0 if there are none.
    owner: the columns document, group, row and start of each suffix."""
    n = len(suffix)
    least, most = np.full(n, 255, np.uint8), np.zeros(n, np.uint8)
    doc, g, row, start = owner
    right, left = multikey_order(suffix), multikey_order(before)
    right_common, left_common = common_prefixes(suffix, right), common_prefixes(before, left)
    place = np.empty(n, np.int64)
    place[np.lexsort((start, row, g, doc))] = np.arange(n)  # from earliest to latest
    by_place = np.argsort(place)
    bits = max(1, n.bit_length())
    right_class, left_class = np.empty(n, np.int64), np.zeros(n, np.int64)
    for o in range(size - GRAM + 1):
        right_class[right] = np.cumsum(right_common < size - o)
        if o:
            left_class[left] = np.cumsum(left_common < o)
        ok = (lengths[0] >= size - o) & (lengths[1] >= o)
        if 3 * bits <= 63:  # class and place in one number: of equal classes the earliest comes first
            keys = np.sort((right_class << 2 * bits | left_class << bits | place)[ok])
            rows, classes = by_place[keys & (1 << bits) - 1], keys >> bits
        else:
            rows = np.flatnonzero(ok)
            rows = rows[np.lexsort((place[rows], left_class[rows], right_class[rows]))]
            classes = np.cumsum(np.concatenate(([0], (right_class[rows][1:] != right_class[rows][:-1]) | (left_class[rows][1:] != left_class[rows][:-1])))) if len(rows) else rows
        if len(rows) < 2:
            continue
        new = np.concatenate(([True], classes[1:] != classes[:-1]))
        first = rows[new][np.cumsum(new) - 1]
        prev = np.concatenate((rows[:1], rows[:-1]))
        same_row = ~new & (doc[prev] == doc[rows]) & (g[prev] == g[rows]) & (row[prev] == row[rows])
        hit = rows[(doc[first] < doc[rows]) | same_row]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = np.maximum(most[hit], o)
    return least, most


class _Group:
    def __init__(self, rows: pa.Table, size: int):
        self.rows, self.size = gr.in_order(rows), size
        self.ids, self.valid = gr.doc_ids(self.rows)
        self.data, self.offsets = ta.text_buffer(self.rows.column("text"))
        self.h = ta.prefix_hashes(self.data)
        self.anchors = anchor_places(ta.gram_hashes(self.h, GRAM), self.offsets, self.valid, size)
        self.doc = np.searchsorted(self.offsets, self.anchors, side="right") - 1
        lo, hi = self.offsets[self.doc], self.offsets[self.doc + 1]
        # Bytes that count before and from an anchor on, and the halves that any window holds one of.
        self.n_before = np.minimum(self.anchors - lo, size - GRAM)
        self.n_after = np.minimum(hi - self.anchors, size)
        reach = HALF - GRAM
        self.has_left, self.has_right = self.n_before >= reach, self.n_after >= HALF
        left, right = self.anchors[self.has_left], self.anchors[self.has_right]
        hashes = np.concatenate((ta.span_hashes(self.h, left - reach, left + GRAM), ta.mix(ta.span_hashes(self.h, right, right + HALF))))
        self.found = gr.Distinct(hashes)

    def candidates(self, bits: pa.Table, n_buckets: int) -> None:
        """Of the anchors with a repeated half: one of each kind of surroundings, the earliest, and who stands for whom."""
        repeated = gr.read_bits(bits, 0, self.found.values, n_buckets)
        repeated |= np.bincount(self.found.at, minlength=len(repeated)) > 1
        half, n = repeated[self.found.at], int(self.has_left.sum())
        ok = np.zeros(len(self.anchors), bool)
        ok[self.has_left] = half[:n]
        ok[self.has_right] |= half[n:]
        self.at = np.flatnonzero(ok)
        a, before, after = self.anchors[self.at], self.n_before[self.at], self.n_after[self.at]
        around = ta.mix(ta.span_hashes(self.h, a - before, a + after) ^ ta.mix((before * 256 + after).astype(np.uint64)))
        self.kind = gr.Distinct(around)
        self.leader = self.at[self.kind.first(np.arange(len(self.at)))]  # anchors are in order of id and place

    def intervals(self, entries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The flag of each byte that goes; entries are numbers of leaders."""
        lo, hi = np.full(len(self.leader), 255, np.int64), np.zeros(len(self.leader), np.int64)
        lo[entries], hi[entries] = least, most
        lo, hi = lo[self.kind.at], hi[self.kind.at]
        leader = self.leader[self.kind.at]
        later = (self.ids[self.doc[self.at]] > self.ids[self.doc[leader]]) | (self.doc[self.at] == self.doc[leader]) & (self.at > leader)
        lo[later] = np.maximum(0, self.size - self.n_after[self.at])[later]
        hi[later] = self.n_before[self.at][later]
        hit = lo <= hi
        a = self.anchors[self.at][hit]
        return ta.covered(len(self.data), a - hi[hit], self.size + hi[hit] - lo[hit])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100, with_text: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, the digest of the bytes kept and, if asked for, these bytes."""
    rows, n_groups = gr.grouped(docs, key, text)
    n_buckets, n_parts = max(1, n_groups // 8), max(1, n_groups // 2)
    by_group = rows.groupBy("g")

    def halves(key: tuple, rows: pa.Table) -> pa.Table:
        ta.release()
        return gr.ask_repeated(key[0].as_py(), _Group(rows, size).found, n_buckets)

    repeated = gr.answer_repeated(by_group.applyInArrow(halves, gr.HASHES), 0)

    def suffixes(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        ta.release()
        group = _Group(rows, size)
        group.candidates(bits, n_buckets)
        at, raw = group.leader, group.data.tobytes()
        doc, a = group.doc[at], group.anchors[at].tolist()
        before, after = group.n_before[at].tolist(), group.n_after[at].tolist()
        n = len(at)
        columns = [
            pa.array([raw[x : x + GRAM] for x in a], pa.binary()), pa.array([raw[x : x + k] for x, k in zip(a, after, strict=True)], pa.binary()),
            pa.array([raw[x - k : x][::-1] for x, k in zip(a, before, strict=True)], pa.binary()), pa.array(group.ids[doc], pa.int64()),
            pa.array(np.full(n, key[0].as_py()), pa.int64()), pa.array(doc, pa.int32()), pa.array(group.anchors[at] - group.offsets[doc], pa.int32()), pa.array(np.arange(n), pa.int32()),
        ]
        return pa.table(columns, ["lead", "suffix", "before", "doc_id", "g", "row", "start", "entry"])

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        out = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)
        return out, sizes

    def bucket(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        (suffix, n_after), (before, n_before) = matrix(rows.column("suffix"), size), matrix(rows.column("before"), size - GRAM)
        owner = tuple(rows.column(c).to_numpy() for c in ("doc_id", "g", "row", "start"))
        least, most = repeated_windows(suffix, before, (n_after, n_before), owner, size)
        hit = np.flatnonzero(least <= most)
        hit = hit[np.argsort(owner[1][hit], kind="stable")]
        g, entry = owner[1][hit], rows.column("entry").to_numpy()[hit].astype("<u4")
        cuts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)])).tolist() if len(g) else [0]
        out = [(int(g[lo]), entry[lo:hi].tobytes(), least[hit[lo:hi]].tobytes(), most[hit[lo:hi]].tobytes()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["g", "entries", "least", "most"])

    sent = by_group.cogroup(repeated.groupBy("g")).applyInArrow(suffixes, SUFFIXES)
    found = sent.repartitionByRange(n_parts, "lead").mapInArrow(bucket, FOUND)
    # Both kinds of answers in one table, as two tables come together at a time.
    none = F.lit(None).cast("binary")
    answers = repeated.select("g", "tag", "bucket", "bits", none.alias("entries"), none.alias("least"), none.alias("most"))
    answers = answers.unionByName(found.select("g", F.lit(1).alias("tag"), F.lit(0).alias("bucket"), none.alias("bits"), "entries", "least", "most"))

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ta.release()
        group = _Group(rows, size)
        group.candidates(answers, n_buckets)
        mine = [x for x in answers.select(["entries", "least", "most"]).to_pylist() if x["entries"] is not None]
        joined = [np.frombuffer(b"".join(x[c] for x in mine), t) for c, t in (("entries", "<u4"), ("least", np.uint8), ("most", np.uint8))]
        gone = group.intervals(*joined) if len(group.at) else np.zeros(len(group.data), bool)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = group.offsets[:-1][np.diff(group.offsets) > 0]
        edge[starts] = gone[starts]
        out = []
        for lo, hi in zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist(), strict=True):
            cut = gone[lo:hi]
            n = int(cut.sum())
            kept = (group.data[lo:hi][~cut] if n else group.data[lo:hi]).tobytes()
            out.append((hi - lo, n, int(edge[lo:hi].sum()) if n else 0, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([group.rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), group.rows.column("copies")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "copies"])

    return gr.spread(by_group.cogroup(answers.groupBy("g")).applyInArrow(finish, RESULT))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE: dict[str, str] = {}
QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
