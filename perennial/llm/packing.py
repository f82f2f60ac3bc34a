"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Tokenising: one pass over the documents, ids as the tokenizer gives them and an end id after each document; a
document of more than `length` ids is cut into pieces of `length`, the last one shorter.

Packing: documents and gaps are both kept sorted by size. Documents of one length are interchangeable, and so are
sequences with one gap, so both sorted lists are held run-length encoded: a round takes the run of the longest
documents left, sweeps up the gaps from the tightest that still fits (its successor), and matches whole runs at once,
the document of rank r in its run to the sequence of rank r in the other, so no two documents ever claim one place.
The gaps are updated and the sweep is repeated; documents that no gap takes open new sequences. The rounds see the
counts of at most `length` sizes, whatever the corpus size; what follows the corpus is distributed: counting by
length and partition, ranking within (partition, length), and placing each piece by its rank. A hot length is ranked
in as many groups as there are partitions.

Defined results: a null text counts as empty, so it holds the end id only; repeated rows and null ids are packed as
documents of their own; an empty table gives no rows; texts of any length are tokenised whole; other columns of any
name are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import cut, keyed, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks of text between spaces whose ids a worker remembers, and the longest one that is remembered. They are kept
#: in two halves: when the newer one is full, the older one goes, but for the chunks that have been met again.
REMEMBERED, LONGEST = 500_000, 32
#: Lower-case Latin-1 letters in UTF-8: such a word is one pre-token.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: ASCII marks but the apostrophe, from the end of a word of letters to white space: a pre-token of their own.
_MARKS = re.compile(rb"([!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*)(?=[ \n]|$)")
#: Capital Latin-1 letters in UTF-8; their lower case has a second byte higher by 32.
_CAPITAL = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
_SMALL = {bytes((0xC3, b)): bytes((0xC3, b + 32)) for b in range(0x80, 0x9F)}
#: The characters by which a byte-level model knows bytes: printable ones stand for themselves, the rest from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_LEVEL = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))
_LOADED: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), [{}, {}])
    return _LOADED[path]


def _chunks(text: str | None) -> list[bytes]:
    """Chunks of a text whose ids do not depend on each other: this tokenizer drops white space, lets nothing reach
    across it, lower-cases, and parts a letter from a mark. So case and marks at a word's end make no new chunks."""
    if not text:
        return []
    raw = text.encode()
    if b"<|" in raw:  # a special string is known by its case and marks
        return raw.split()
    raw = raw.lower()
    return _MARKS.sub(rb" \1", _CAPITAL.sub(lambda m: _SMALL[m[0]], raw)).split()


def encode_texts(texts: list[str | None], path: str, end_id: int = 0) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, with the end id."""
    tokenizer, halves = _tokenizer(path)
    if len(halves[0]) > REMEMBERED // 2:
        halves[:] = [{}, halves[0]]
    known, older = halves
    parts = list(map(_chunks, texts))
    got = [list(map(known.get, ps)) for ps in parts]
    missing = {p for ps, xs in zip(parts, got, strict=True) if None in xs for p, x in zip(ps, xs, strict=True) if x is None}
    fresh = {p: older[p] for p in missing if p in older}
    new = [p for p in missing if p not in fresh]
    tokenize = tokenizer.model.tokenize
    for p in filter(_LETTERS.fullmatch, new):
        fresh[p] = array("I", [t.id for t in tokenize(p.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
    rest = [p for p in new if p not in fresh]
    for lo in range(0, len(rest), 4096):
        part = rest[lo : lo + 4096]
        fresh.update((p, array("I", e.ids).tobytes()) for p, e in zip(part, tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True))
    known.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
    end = int(end_id).to_bytes(4, "little")
    return [b"".join([fresh[p] if x is None else x for p, x in zip(ps, xs, strict=True)] if None in xs else xs) + end for ps, xs in zip(parts, got, strict=True)]


def pieces_of(docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length and the crc32 of its ids."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, "text"):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode_texts(part.column("text").to_pylist(), path, end_id), strict=True):
                    n = len(ids) // 4
                    view = memoryview(ids)
                    rows += [(doc, k, s, min(length, n - s), zlib.crc32(view[4 * s : 4 * (s + length)])) for k, s in enumerate(range(0, n, length))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed(docs, key, text).mapInArrow(run, PIECES)


def fit(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over {piece length: how many}. Returns runs (piece length, first rank, how many, first
    sequence, offset): the pieces of these ranks lie at this offset of consecutive sequences."""
    runs, opened = [], 0
    open_gaps: list[int] = []  # the sizes that have gaps, sorted
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, how many)

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                insort(open_gaps, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(open_gaps, size)
            if k == len(open_gaps):
                break
            gap = open_gaps[k]
            taken, moved = gaps[gap], []
            while left and taken:
                first, n = taken.pop()
                m = min(n, left)
                if m < n:
                    taken.append((first + m, n - m))
                runs.append((size, rank, m, first, length - gap))
                moved.append((first, m))
                rank, left = rank + m, left - m
            if not taken:
                del gaps[gap], open_gaps[k]
            for first, n in moved:
                add(gap - size, first, n)
        each = length // size
        for per, n in ((each, left // each), (left % each, 1 if left % each else 0)):
            for j in range(per if n else 0):
                runs.append((size, rank, n, opened, j * size))
                rank += n
            add(length - per * size, opened, n)
            opened += n
    return runs


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` has doc_id, piece and length; it is written once, as ranks
    must not change when a lost task is run again."""
    rows = cut(pieces).withColumn("part", F.spark_partition_id())
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    runs = np.array(sorted(fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, length)) or np.zeros((0, 5)), np.int64)
    plan = rows.sparkSession.sparkContext.broadcast(runs)
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(counts.drop("n"), ["part", "length"]).withColumn("rank", F.col("k") - 1 + F.coalesce("before", F.lit(0)))

    def place(batches):
        runs = plan.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, size << 48 | rank, side="right") - 1]
            kept = [c for c in names if c not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), pa.array(run[:, 4], pa.int64())], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    names = pieces.columns
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_packing": op2_packing}
