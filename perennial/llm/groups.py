"""Documents in groups of a few MB, and questions about sorted hashes that groups put to each other.

A group is a set of documents dealt by hash that one task holds at once as numpy arrays. Several passes need the
same documents together with what other groups found out about them; all passes read one exchange of the texts,
which Spark reuses within a query. What travels between groups is packed: a group sends to each bucket of the hash
range one row with all its entries there, and gets one row of bits back, a bit an entry. A group sends a hash once,
however many of its documents hold it, so that no hash has more entries than there are groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import keyed, partitions_for

#: Bytes of text in a group, and entries in a bucket, that a worker holds at once in the mean.
GROUP_BYTES, BUCKET_ENTRIES = 4 << 20, 1_000_000
BITS = "g long, tag int, bucket int, bits binary"


def grouped(docs: DataFrame, key: str, text: str, each: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, copies, g; the number of groups). Rows of one id and one text come once, with their number: however
    many they are, they are no load for their group. spread() gives them back."""
    rows = keyed(docs, key, text)
    kinds = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("b"))
    most, total = kinds.agg(F.max("c"), F.sum("b")).first()
    if (most or 0) > 1:
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    n = partitions_for(total or 0, each, 1)
    return rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")), n


def spread(found: DataFrame, least: int = 1 << 12) -> DataFrame:
    """Each row `copies` times, in runs of at most `least`, so that no array holds them all."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / least)))
    out = found.withColumn("run", runs)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(least), F.col("copies") - F.col("run") * least).cast("int")))).drop("copies", "run", "copy")


def in_order(rows: pa.Table) -> pa.Table:
    """The rows of a group in an order that is the same in every pass."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, 0 for null; is it an id?)"""
    column = rows.column("doc_id")
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def bucket_bounds(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the sorted hashes begins, and the end."""
    edges = np.array([(b << 64) // n for b in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def low_bytes(hashes: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.view("<u8").ravel()


def to_buckets(g: int, hashes: np.ndarray, n_buckets: int, columns: list[Callable[[int, int], bytes]]) -> list[tuple]:
    """Rows (bucket, g, blob of each column) of sorted hashes; a column gives the bytes of entries lo to hi."""
    bounds = bucket_bounds(hashes, n_buckets)
    return [(b, g, *(c(lo, hi) for c in columns)) for b, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if hi > lo]


def bits_back(groups: list[int], sizes: list[int], flags: np.ndarray, bucket: int, tag: int) -> pa.Table:
    """The flags of a bucket's entries as one row a group; groups without a flag get none."""
    rows, at = [], 0
    for g, n in zip(groups, sizes, strict=True):
        mine = flags[at : at + n]
        at += n
        if mine.any():
            rows.append((g, tag, bucket, np.packbits(mine).tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["g", "tag", "bucket", "bits"])


def read_bits(rows: pa.Table, tag: int, hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The flag of each of a group's sorted hashes."""
    out, bounds = np.zeros(len(hashes), bool), bucket_bounds(hashes, n_buckets)
    for t, b, bits in zip(rows.column("tag").to_pylist(), rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        if t == tag:
            lo, hi = bounds[b], bounds[b + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


class Distinct:
    """The distinct values of an array of hashes, sorted, with the way back."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        ordered = hashes[self.order]
        self.new = np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))
        self.values = ordered[self.new]
        self.at = np.empty(len(hashes), np.int64)  # of each hash, its place in values
        self.at[self.order] = np.cumsum(self.new) - 1

    def first(self, x: np.ndarray) -> np.ndarray:
        """x of the first entry of each value."""
        return x[self.order][self.new]

    def last(self, x: np.ndarray) -> np.ndarray:
        return x[self.order][np.concatenate((self.new[1:], np.ones(min(1, len(self.new)), bool)))]


HASHES = "bucket int, g long, hashes binary"


def ask_repeated(g: int, found: Distinct, n_buckets: int) -> pa.Table:
    """A group's question which of its hashes other groups have too."""
    rows = to_buckets(g, found.values, n_buckets, [lambda lo, hi: low_bytes(found.values[lo:hi], 5)])
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "g", "hashes"])


def answer_repeated(asked: DataFrame, tag: int) -> DataFrame:
    """BITS: the hashes that two groups or more have (40 bits and the bucket's are compared: now and then one too many)."""

    def answer(rows: pa.Table) -> pa.Table:
        ta.release()
        rows = rows.sort_by("g")
        parts = [from_low_bytes(b, 5) for b in rows.column("hashes").to_pylist()]
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        flags = np.zeros(len(hashes), bool)
        flags[order[1:][same]] = flags[order[:-1][same]] = True
        return bits_back(rows.column("g").to_pylist(), [len(p) for p in parts], flags, rows.column("bucket")[0].as_py(), tag)

    return asked.groupBy("bucket").applyInArrow(answer, BITS)
