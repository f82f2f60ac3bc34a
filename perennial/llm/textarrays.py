"""Numpy views of Arrow text columns: words, hashes and windows of a whole batch at once.

Every function takes a whole batch of texts as one byte buffer with document offsets, so the cost is
a handful of vector operations a byte and no Python work a word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes. White space is the six ASCII characters 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODE = np.random.Generator(np.random.PCG64(20240521)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: it keeps what it likes
    _trim = None


def release() -> None:
    """Gives freed memory back to the system. A worker is kept for later tasks, and what the largest group or batch has
    needed would otherwise count against its executor for as long as it lives."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the largest table made so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _POWERS[base] = np.multiply.accumulate(table)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] = the hash of data[s:e] times base**s."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(_BASE, len(data)), out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; the same bytes have the same hash anywhere and in any process."""
    inverse = powers(_BASE_INV, len(h))
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n bytes, by first byte; good in their upper 32 bits, for choosing among places."""
    m = max(0, len(h) - n)
    out = h[n:] - h[:m]
    out *= powers(_BASE_INV, m)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


class Words:
    """The words of a batch: byte spans, the first word of each document, and on demand their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE):
        self.data, self.offsets = data, offsets
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document's number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(self.data), self.starts, self.ends)

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, by first word, across documents too: mask with window_starts()."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + m]
    return mix(out)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """True at each word that starts a run of n words of one document; one flag for each entry of window_hashes()."""
    m = max(0, int(first[-1]) - n + 1)
    ok = np.ones(m, bool)
    for lo, hi in zip(np.maximum(first[1:] - n + 1, first[:-1]).tolist(), first[1:].tolist(), strict=True):
        ok[lo:hi] = False
    return ok


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """A flag for each of n places: does any span starts[i] .. starts[i]+lengths[i]-1 hold it?"""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """The batch in runs of rows of about `most` bytes of text, each row whole: bounds what numpy holds at once."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(lo, hi - lo)
    release()
