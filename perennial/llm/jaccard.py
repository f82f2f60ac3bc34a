"""N-gram Jaccard join by prefix filters under several global orders.

A text's set holds its distinct 5-word shingles as 64-bit hashes. If two sets have a Jaccard similarity of 0.8 or
more, then under any total order of the shingles their prefixes (the first n - ceil(0.8 n) + 1) share one. Three
orders are used: rarest first by a count sketch of fixed size over the whole corpus, and the hashes of a bijection
upwards and downwards. A pair is a candidate under the first order if it shares a prefix shingle at places that leave
enough to share after them. Of the candidates only those go on whose parities can be of similar sets: a bit or two for
each shingle says how many of a set's hashes fall on a place, even or odd, and sets differ in no fewer shingles than in
bits. Then the filters of the other two orders are intersected with them, still without any whole
set: beside each class stand its prefixes under both, half the bits of a hash each, and a pair goes on only if both
have a common entry, and if what they have in common, with all that lies outside the prefixes, can still reach 0.8.
Only pairs that pass all three orders have their whole sets brought together and intersected. Prefixes and whole sets
move for the documents of pairs that are left, not for all.

Texts with equal sets are one class and join as one. Of prefix shingles that the very same classes have, only the
first in the order is kept (with their number): a pair that shares one shares all, so its first common shingle stays.
Groups of near copies can be large, so pairs are not listed outright: in a first round each class is compared with the
candidate it shares most prefix shingles with among the leaders of its shingles; further rounds compare across the
components found so far, and the last one takes every candidate pair whose ends are still in different components.
There the classes of a frequent shingle are dealt into blocks, each pair of blocks is a group of its own, and only
similar pairs leave it; whole sets come to it only for classes that have a partner by their parities. So no link that
matters to a component is left out, pairs within
a component are never verified again, and no step puts all members of a shingle into one task. What
stands beside the classes is written once; whole sets are made from the texts of the pairs that need them.

Defined results: no text or no words is an empty set, linked with nothing; a document without an id has no
component; rows with equal ids count as one node, whatever their texts, and repeated rows as one; texts of any length
are read whole; other columns of any name are not looked at; empty tables give no rows. The sketch only orders: where
a corpus is too large for its counters, prefixes are less selective, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import groups as gr
from . import textarrays as ta
from .components import components
from .shared import keyed, partitions_for, stored, table

#: Counters of the sketch, in so many slices.
SKETCH, SLICES = 1 << 19, 32
#: Classes of a frequent shingle that are compared at once.
BLOCK = 256
_CLASS = ("k1", "k2", "n")


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, offsets = ta.text_buffer(texts)
    words = ta.Words(ta.LOWER[data], offsets)
    hashes, first = words.hashes(), words.first.tolist()
    windows = ta.window_hashes(hashes, size)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(windows[lo : hi - size + 1]))
        else:
            out.append(ta.mix(ta.window_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)) if hi > lo else hashes[:0])
    return out


def prefix_length(n: int, percent: int = 80) -> int:
    """So many first shingles of a set of n that two similar sets share one of them."""
    return n - (percent * n + 99) // 100 + 1


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    a, b = ta.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ta.mix(shingles + np.uint64(0x1234567))
    return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (a, b))


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Of whole sets, sorted."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def in_second_order(shingles: np.ndarray) -> np.ndarray:
    """A set sorted by a bijection of its hashes: the second order upwards, the third downwards."""
    return np.sort(ta.mix(shingles ^ np.uint64(0x6A09E667F3BCC909)))


def ends_of(ordered: np.ndarray, percent: int = 80) -> np.ndarray:
    """The prefixes under the second and the third order, one after the other, both upwards; upper 32 bits."""
    p = prefix_length(len(ordered), percent)
    return (np.concatenate((ordered[:p], ordered[-p:])) >> np.uint64(32)).astype("<u4")


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 places or more, one or two a shingle, whether an odd number of the hashes fall on it; packed.
    A shingle that only one of two sets has turns one bit, so they differ in as many shingles as in bits, or more."""
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2 == 1)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parity_bits() as for so many bytes, a power of two."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return np.ascontiguousarray(bits).view("<u8")


def pass_bits(a: list[np.ndarray], n: np.ndarray, b: list[np.ndarray], m: np.ndarray, percent: int = 80) -> np.ndarray:
    """Which of a (parities of sets of n shingles) and of b may be similar, by size and parities? A matrix."""
    n, m = np.asarray(n, np.int64)[:, None], np.asarray(m, np.int64)[None, :]
    apart = np.zeros((len(a), len(b)), np.int64)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    for x in np.unique(sizes[0]):
        for y in np.unique(sizes[1]):
            i, j = np.flatnonzero(sizes[0] == x), np.flatnonzero(sizes[1] == y)
            left, right = (_folded(np.stack([side[k] for k in at]), min(x, y)) for side, at in ((a, i), (b, j)))
            apart[np.ix_(i, j)] = [np.bitwise_count(row ^ right).sum(axis=1, dtype=np.int64) for row in left]
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))


def passes_bits(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int = 80) -> bool:
    """pass_bits() for one pair."""
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum(dtype=np.int64))
    return 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of a has in common with each of b, at least what whole hashes would have."""
    left, right = (np.concatenate(x) for x in (a, b))
    values = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)
    places = []
    for lists, joined in ((a, left), (b, right)):
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(values, joined), max(0, len(values) - 1))
        ok = values[at] == joined if len(values) else np.zeros(len(joined), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((owner[ok][order], at[ok][order], len(lists)))
    for lo in range(0, len(values), 4096):  # a slice of the values at a time, so that no matrix grows with the texts
        grids = []
        for owner, at, n in places:
            x, y = np.searchsorted(at, (lo, lo + 4096))
            grid = np.zeros((n, min(4096, len(values) - lo)), np.float32)
            grid[owner[x:y], at[x:y] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    twice = np.array([len(x) - len(np.unique(x)) for x in a])
    return out.astype(np.int64) + twice[:, None]


def pass_orders(a: list[np.ndarray], n: np.ndarray, b: list[np.ndarray], m: np.ndarray, percent: int = 80) -> np.ndarray:
    """Which of a (ends of sets of n shingles) and of b may be similar by the second and third order together? A matrix.

    A shingle common to both sets lies in both prefixes or in neither, up to the smaller of their last values. So no
    more is common than what the prefixes share under both orders and the rest of the smaller set."""
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    rest, found, ok = [n[:, None], m[None, :]], 0, np.ones((len(a), len(b)), bool)
    for up in (True, False):
        one, other = ([x[: len(x) // 2] if up else x[len(x) // 2 :] for x in side] for side in (a, b))
        both = _shared(one, other)
        ok &= both > 0
        found = found + both
        reach = [np.array([x[-1 if up else 0] for x in side], np.int64) for side in (one, other)]
        edge = np.minimum(reach[0][:, None], reach[1]) if up else np.maximum(reach[0][:, None], reach[1])
        for k, side in enumerate((one, other)):
            cuts = edge if not k else edge.T
            inside = np.array([np.searchsorted(x, c, side="left") if up else len(x) - np.searchsorted(x, c, side="right") for x, c in zip(side, cuts, strict=True)], np.int64).reshape(cuts.shape)
            rest[k] = rest[k] - (inside if not k else inside.T)
    apart = (np.array([len(x) for x in a])[:, None] <= n[:, None]) & (np.array([len(x) for x in b])[None, :] <= m[None, :])
    enough = (100 + percent) * (found + np.minimum(*rest)) >= percent * (n[:, None] + m[None, :])
    sizes = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    return ok & sizes & (enough | ~apart)  # prefixes that overlap, at a low percentage, have no rest to count


def passes_orders(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int = 80) -> bool:
    """pass_orders() for one pair."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    found, rest, p, q = 0, [n, m], len(a) // 2, len(b) // 2
    for x, y, up in ((a[:p], b[:q], True), (a[p:], b[q:], False)):
        both = len(np.intersect1d(x, y))
        if not both:
            return False
        found += both + p - len(np.unique(x))
        edge = min(x[-1], y[-1]) if up else max(x[0], y[0])
        for k, z in enumerate((x, y)):
            rest[k] -= int(np.searchsorted(z, edge, side="left")) if up else len(z) - int(np.searchsorted(z, edge, side="right"))
    return 2 * p > n or 2 * q > m or (100 + percent) * (found + min(rest)) >= percent * (n + m)


def first_pass(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, k1, k2, n) for each document, where equal sets have an equal key, and rows (slice, counts) of the
    sketch of each task: counts of shingles by hash bucket, SKETCH numbers a task, whatever the corpus."""
    names = ["doc_id", *_CLASS, "slice", "counts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    each = SKETCH // SLICES

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in ta.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(45)).astype(np.int64), minlength=SKETCH)
                rows = list(zip(*(set_key(s) for s in sets), strict=True)) or [(), ()]
                filled = [part.column("doc_id"), *rows, [len(s) for s in sets], [None] * len(sets), [None] * len(sets)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(filled, kinds, strict=True)], names)
        if total.any():
            counts = np.minimum(total, (1 << 32) - 1).astype("<u4")
            slices = [counts[k * each : (k + 1) * each].tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, k) for k in kinds[:4]), pa.array(range(SLICES), kinds[4]), pa.array(slices, kinds[5])], names)

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, slice int, counts binary")


def summed_sketch(made: DataFrame) -> np.ndarray:
    """The sketches of all tasks as one array: summed slice by slice, SKETCH numbers come to the driver."""
    each = SKETCH // SLICES

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                raw = blob.as_buffer()
                part = np.frombuffer(raw, "<u4" if raw.size == 4 * each else "<i8")
                total[k] = total.get(k, 0) + part.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"  # added up where they lie first, then slice by slice
    parts = made.where("slice is not null").select("slice", "counts").mapInArrow(add, schema).repartition(SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros(SKETCH, np.int64)
    for k, blob in parts.collect():
        out[k * each : (k + 1) * each] += np.frombuffer(blob, "<i8")
    return out


def prefixes(docs: DataFrame, sketch: np.ndarray, size: int = 5, percent: int = 80) -> DataFrame:
    """(k1, k2, n, tokens): the prefix of each class in the first order; once a task, not once a document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, (1 << 20) - 1).astype(np.uint32))

    def run(batches):
        counts, seen = shared.value, set()
        for batch in batches:
            for part in ta.slices(batch, "text"):
                rows = []
                for s in shingle_sets(part.column("text"), size):
                    if not len(s) or (key := (*set_key(s), len(s))) in seen:
                        continue
                    if len(seen) > 20_000:
                        seen.clear()
                    seen.add(key)
                    p = prefix_length(len(s), percent)
                    order = counts[(s >> np.uint64(45)).astype(np.int64)].astype(np.uint64) << np.uint64(44) | s >> np.uint64(20)
                    rows.append((*key, s[np.argsort(order)[:p]].astype("<u8").tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [*_CLASS, "tokens"])

    return docs.mapInArrow(run, "k1 long, k2 long, n long, tokens binary")


def shared_tokens(found: DataFrame, classes: DataFrame, n_groups: int) -> DataFrame:
    """(token, k, id, n, pos) for each prefix shingle that two classes or more have; k is of the class's key, id its
    smallest document, pos the shingle's place in its order."""
    n_buckets = max(1, n_groups // 2)
    by_group = found.withColumn("g", F.pmod("k1", F.lit(n_groups))).groupBy("g")
    ids = classes.withColumn("g", F.pmod("k1", F.lit(n_groups)))

    def tokens_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Tokens of the group's classes, each class once; the class of each and its place there."""
        once = {}
        for k1, k2, n, t in zip(*(rows.column(c).to_pylist() for c in (*_CLASS, "tokens")), strict=True):
            once[k1, k2, n] = t
        keys = sorted(once)
        parts = [np.frombuffer(once[k], "<u8") for k in keys]
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype("<u8"), *parts]), np.repeat(np.arange(len(keys)), [len(p) for p in parts]), np.concatenate([none, *(np.arange(1, len(p) + 1) for p in parts)]), keys

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        ta.release()
        return gr.ask_repeated(key[0].as_py(), gr.Distinct(tokens_of(rows)[0]), n_buckets)

    repeated = gr.answer_repeated(by_group.applyInArrow(ask, gr.HASHES), 0)

    def emit(key: tuple, rows: pa.Table, more: pa.Table) -> pa.Table:
        ta.release()
        tokens, owner, place, keys = tokens_of(rows)
        distinct = gr.Distinct(tokens)
        bits = more.filter(more.column("bits").is_valid())
        here = more.filter(more.column("id").is_valid())
        ids = {(a, b, c): i for a, b, c, i in zip(*(here.column(x).to_pylist() for x in (*_CLASS, "id")), strict=True)}
        flags = gr.read_bits(bits, 0, distinct.values, n_buckets) | (np.bincount(distinct.at, minlength=len(distinct.values)) > 1)
        at = np.flatnonzero(flags[distinct.at])
        node = np.array([ids.get(k, -1) for k in keys] or [0], np.int64)  # a class whose documents have no ids has none
        size = np.array([k[2] for k in keys] or [0], np.int64)
        known = np.array([k in ids for k in keys] or [False])
        at = at[known[owner[at]]]
        k1 = np.array([k[0] for k in keys] or [0], np.int64)
        columns = (tokens[at].astype(np.int64), k1[owner[at]], node[owner[at]], size[owner[at]], place[at])
        return pa.table([pa.array(c) for c in columns], ["token", "k", "id", "n", "pos"])

    none = F.lit(None)
    more = repeated.select("g", "tag", "bucket", "bits", *(none.cast("long").alias(c) for c in (*_CLASS, "id")))
    more = more.unionByName(ids.select("g", none.cast("int").alias("tag"), none.cast("int").alias("bucket"), none.cast("binary").alias("bits"), *_CLASS, "id"))
    return by_group.cogroup(more.groupBy("g")).applyInArrow(emit, "token long, k long, id long, n long, pos long")


def thinned(tokens: DataFrame) -> DataFrame:
    """(token, id, n, pos, w, m): of shingles that the very same classes have, the first in the order and how many there
    are (w), and how many classes (m).
    Lists of classes are told apart by their length, ends and two sums of hashes; shingles of one class go."""
    h, low = F.xxhash64("k"), F.lit((1 << 31) - 1)
    sums = [F.sum(x.bitwiseAND(low)).alias(c) for c, x in (("x", h), ("y", F.shiftrightunsigned(h, 31)))]
    lists = tokens.groupBy("token").agg(F.count("*").alias("m"), F.min("k").alias("lo"), F.max("k").alias("hi"), *sums, F.sum("pos").alias("at")).where("m > 1")
    first = lists.groupBy("m", "lo", "hi", "x", "y").agg(F.min_by("token", "at").alias("token"), F.count("*").alias("w"))
    return tokens.drop("k").join(first.select("token", "w", "m").hint("shuffle_hash"), "token")


def id_filter(ids: DataFrame, bits: int | None = None) -> np.ndarray:
    """A Bloom filter of the ids, packed: it only saves moving texts that no pair needs. It grows with their number up to
    16 MB; beyond, more texts pass than need to."""
    if bits is None:
        bits = 1 << min(27, max(16, (16 * ids.count()).bit_length()))

    def fill(batches):
        flags = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column("id").to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([flags.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for (blob,) in ids.select("id").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(blob, np.uint8)
    return out


def _maybe(flags: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Might each id be in the set of the filter? Never a null."""
    found = ids.is_valid().to_numpy(zero_copy_only=False)
    for at in _places(ids.fill_null(0).to_numpy(), 8 * len(flags)):
        found = found & (flags[at >> 3] >> (at & 7) & 1).astype(bool)
    return found


def in_filter(flags: np.ndarray):
    """A condition on an id column: might it be in id_filter()'s set? Never for a null."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(flags)

    # On the Arrow column: as a pandas series, ids beside a null would be floats and lose what is above 2**53.
    @F.arrow_udf(T.BooleanType())
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(_maybe(shared.value, ids))

    return maybe


def _places(ids: np.ndarray, bits: int):
    h = ta.mix(ids.astype(np.int64).view(np.uint64))
    return [(h >> np.uint64(s)).astype(np.int64) & (bits - 1) for s in (0, 29)]


def sets_of(docs: DataFrame, wanted: np.ndarray, repeated: bool, whole: bool, size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, shingles, bits) of the documents in the id_filter() `wanted`: their sets in the second order, or just the
    ends, and the parities beside these. `repeated`: are there rows with one id and one set? They would meet in all their
    pairs, so that one of them stays."""
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch.filter(pa.array(_maybe(wanted.value, batch.column("doc_id")))), "text"):
                rows = []
                for s in shingle_sets(part.column("text"), size):
                    ordered = in_second_order(s).astype("<u8")
                    rows.append((*set_key(s), len(s), (ordered if whole or not len(s) else ends_of(ordered, percent)).tobytes(), None if whole else parity_bits(ordered).tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *_CLASS, "shingles", "bits"])

    made = docs.where("doc_id is not null").mapInArrow(run, "id long, k1 long, k2 long, n long, shingles binary, bits binary").where("n > 0")
    if repeated:
        made = made.groupBy("id", *_CLASS).agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
    return made.select("id", "n", "shingles", "bits")


def _with_sets(pairs: DataFrame, spokes: DataFrame, hubs: DataFrame, column: str = "shingles") -> DataFrame:
    """The pairs (hub, spoke) with n and that column of both. Pairs and sets both grow with the corpus: they meet by shuffles.
    Hashed, not sorted: an id has one set, so the hashed side is even, and sets are not copied into sort buffers."""
    both = pairs.join(spokes.select("id", "n", column).toDF("spoke", "m", "theirs").hint("shuffle_hash"), "spoke")
    return both.join(hubs.select("id", "n", column).toDF("hub", "n", "mine").hint("shuffle_hash"), "hub").select("hub", "spoke", "n", "mine", "m", "theirs")


def _holding(test, kind: str):
    """mapInArrow that keeps the pairs for which test(mine, n, theirs, m) holds."""

    def run(batches):
        for batch in batches:
            mine, theirs = batch.column("mine"), batch.column("theirs")
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            ok = np.array([test(np.frombuffer(mine[i].as_buffer(), kind), int(n[i]), np.frombuffer(theirs[i].as_buffer(), kind), int(m[i])) for i in range(batch.num_rows)], bool)
            yield batch.select(["hub", "spoke"]).filter(pa.array(ok, pa.bool_()))
            ta.release()

    return run


def verify(pairs: DataFrame, ends: DataFrame, sets, percent: int = 80) -> DataFrame:
    """The pairs (hub, spoke) that are similar, as (a, b): those that pass the parities, then the second and third order, by
    whole sets. sets: gives the whole sets of the ids in an id_filter(). Only what the pairs left may need is moved."""
    kept = "hub long, spoke long"
    near = stored(_with_sets(pairs, ends, ends, "bits").mapInArrow(_holding(lambda a, n, b, m: passes_bits(a, n, b, m, percent), "u1"), kept))
    if near.isEmpty():
        return near.toDF("a", "b")
    sides = [id_filter(near.select(F.col(c).alias("id"))) for c in ("spoke", "hub")]
    few = (ends.where(in_filter(flags)("id")) for flags in sides)
    close = stored(_with_sets(near, *few).mapInArrow(_holding(lambda a, n, b, m: passes_orders(a, n, b, m, percent), "<u4"), kept))
    found = _with_sets(close, *(sets(flags) for flags in sides)).mapInArrow(_holding(lambda a, n, b, m: similar(a, b, percent), "<u8"), kept)
    return stored(found.distinct().toDF("a", "b"))


def _fits(n: str, i: str, m: str, j: str, percent: int):
    """Can sets of n and m shingles whose first common one has places i and j be similar? By their sizes, and as no
    more can be common than the shorter rest from there on. Of a similar pair the first common shingle passes."""
    rest = 1 + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (F.col(n) + F.col(m)))


def leader_pairs(tokens: DataFrame, percent: int, turn: int) -> DataFrame:
    """One pair for each class outside the largest component of one of its shingles: with that component's leader
    that it shares most shingles with. tokens: (token, id, n, pos, w, label)."""
    # The earlier a common shingle stands, the fewer rarer ones, its own edits, come before it: the nearer the set is
    # to what its group has in common, and the likelier to be similar to its members.
    rank = F.struct("pos", "n", "id") if not turn else F.struct(F.floor(F.col("pos") / 4), F.xxhash64("id", F.lit(turn)), "id")
    groups = tokens.groupBy("token", "label").agg(F.count("*").alias("size"), F.min_by(F.struct("id", "n", "pos"), rank).alias("lead"))
    if turn:
        best = groups.groupBy("token").agg(F.max_by(F.struct("lead", "label"), F.struct("size", -F.col("label"))).alias("top"), F.count("*").alias("labels"))
    else:  # every class is a component of its own yet
        best = groups.groupBy("token").agg(F.min_by(F.struct("lead", "label"), F.struct("lead.pos", "lead.n", "lead.id")).alias("top"), F.count("*").alias("labels"))
    best = best.where("labels > 1").select("token", F.col("top.lead.id").alias("hub"), F.col("top.lead.n").alias("hub_n"), F.col("top.lead.pos").alias("hub_pos"), F.col("top.label").alias("hub_label"))
    # A table of its own, so that Spark can split the rows of a frequent shingle.
    pairs = tokens.join(stored(best).hint("shuffle_hash"), "token").where(F.col("label") != F.col("hub_label")).where(_fits("n", "pos", "hub_n", "hub_pos", percent))
    counts = pairs.groupBy("id", "hub").agg(F.sum("w").alias("c"))
    return counts.groupBy("id").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub")).select("hub", F.col("id").alias("spoke"))


def all_pairs(tokens: DataFrame, ends: DataFrame, sets, percent: int) -> DataFrame:
    """Every candidate pair whose ends are in different components: an equal shingle, at places that fit. Of a frequent
    shingle only those that are similar: they are compared block by block, by their parities first, and those that have
    a partner left by all three orders and then whole."""
    mixed = stored(tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
    rows = tokens.select("token", "id", "n", "pos", "label", "m")
    few = rows.where(F.col("m") <= BLOCK).drop("m").join(mixed, "token")
    other = few.toDF("token", "id2", "n2", "pos2", "label2")
    larger = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    hit = larger & (F.col("label") != F.col("label2")) & _fits("n", "pos", "n2", "pos2", percent)
    listed = few.join(other, "token").where(hit).select(F.col("id2").alias("hub"), F.col("id").alias("spoke"))

    # A shingle of m classes: blocks of about half of BLOCK by a hash of the id, and a group for each pair of blocks.
    # No table by shingle but `mixed`, one row a shingle, is behind this join: Spark can split a frequent shingle's rows.
    many = rows.where(F.col("m") > BLOCK).join(mixed.hint("shuffle_hash"), "token")
    if many.isEmpty():
        return listed.distinct()
    many = many.withColumn("blocks", F.ceil(2 * F.col("m") / BLOCK)).withColumn("b", F.pmod(F.xxhash64("id", "token"), F.col("blocks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = ["token", "id", "n", "pos", "label", "b", "x", "y"]
    many = many.withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")}).join(ends.select("id", "n", "bits"), ["id", "n"]).select(*place, "bits")

    def fitting(key: tuple, rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows of the two blocks, and which pairs of them may be linked by their components and places, each once."""
        block, x, y = rows.column("b").to_numpy(), key[1].as_py(), key[2].as_py()
        sides = [np.flatnonzero(block == k) for k in (x, y)]
        n, pos, label = (rows.column(c).to_numpy() for c in ("n", "pos", "label"))
        a, b = sides[0][:, None], sides[1][None, :]
        rest = 1 + np.minimum(n[a] - pos[a], n[b] - pos[b])
        ok = (label[a] != label[b]) & ((100 + percent) * rest >= percent * (n[a] + n[b]))
        return sides, ok & np.triu(np.ones(ok.shape, bool), 1) if x == y else ok

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        """The rows that have a partner left: rows, not pairs, so that no more than the blocks hold comes out."""
        ta.release()
        sides, ok = fitting(key, rows)
        n, bits = rows.column("n").to_numpy(), [np.frombuffer(e.as_buffer(), "u1") for e in rows.column("bits")]
        if ok.any():
            ok &= pass_bits(*(x for side in sides for x in ([bits[i] for i in side], n[side])), percent)
        left = np.union1d(sides[0][ok.any(axis=1)], sides[1][ok.any(axis=0)])
        return rows.select(place).take(pa.array(left, pa.int64())).group_by(place).aggregate([])

    many = stored(many.groupBy("token", "x", "y").applyInArrow(meet, ", ".join(f"{c} long" for c in place)))
    if many.isEmpty():
        return listed.distinct()
    many = many.join(sets(id_filter(many.select("id").distinct())).drop("bits"), ["id", "n"]).select(*place, "shingles")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        ta.release()
        sides, ok = fitting(key, rows)
        ids, n = (rows.column(c).to_numpy() for c in ("id", "n"))
        whole = [np.frombuffer(e.as_buffer(), "<u8") for e in rows.column("shingles")]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table({"hub": pa.array([], pa.int64()), "spoke": pa.array([], pa.int64())})
        ends = [[ends_of(whole[i], percent) for i in side] for side in sides]
        ok &= pass_orders(ends[0], n[sides[0]], ends[1], n[sides[1]], percent)
        i, j = np.nonzero(ok)
        i, j = sides[0][i], sides[1][j]
        near = np.array([similar(whole[p], whole[q], percent) for p, q in zip(i, j, strict=True)], bool)
        i, j = i[near], j[near]
        swap = (n[i] > n[j]) | ((n[i] == n[j]) & (ids[i] > ids[j]))
        return pa.table({"hub": pa.array(np.where(swap, ids[i], ids[j]), pa.int64()), "spoke": pa.array(np.where(swap, ids[j], ids[i]), pa.int64())})

    blocked = many.groupBy("token", "x", "y").applyInArrow(compare, "hub long, spoke long")
    return listed.unionByName(blocked).distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, turns: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    rows = keyed(docs, key, text)
    made = stored(first_pass(rows, size))
    members = made.where("slice is null").select("doc_id", *_CLASS)
    n_groups = partitions_for(6 * (members.agg(F.sum("n")).first()[0] or 0), 8 << 20, 1)
    # A table of its own, not an aggregate within later joins: so that Spark can split a class that many rows have.
    classes = stored(members.where("n > 0 and doc_id is not null").groupBy(*_CLASS).agg(F.min("doc_id").alias("id")))
    found = prefixes(rows, summed_sketch(made), size, percent)
    tokens = stored(thinned(stored(shared_tokens(found, classes, n_groups))))
    repeated = not members.where("n > 0 and doc_id is not null").groupBy("doc_id", *_CLASS).count().where("count > 1").isEmpty()
    ends = stored(sets_of(rows, id_filter(tokens.select("id").distinct()), repeated, False, size, percent))
    sets = lambda wanted: sets_of(rows, wanted, repeated, True, size, percent)
    labels = edges = done = None
    turn, last = 0, False
    while True:
        labelled = tokens.withColumn("label", F.col("id"))
        if labels is not None:
            labelled = tokens.join(labels.hint("shuffle_hash"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        pairs = all_pairs(labelled, ends, sets, percent) if last else leader_pairs(labelled, percent, turn)
        if done is not None:
            tried = done.select(F.least("hub", "spoke").alias("x"), F.greatest("hub", "spoke").alias("y"))
            pairs = pairs.join(tried, (F.least("hub", "spoke") == F.col("x")) & (F.greatest("hub", "spoke") == F.col("y")), "left_anti")
        pairs = stored(pairs)
        n_pairs = pairs.count()
        n_new = 0
        if n_pairs:
            new = verify(pairs, ends, sets, percent)
            n_new = new.count()
            done = pairs if done is None else done.unionByName(pairs)
            edges = new if edges is None else edges.unionByName(new)
            if n_new:
                labels = components(edges)
        if last:
            break
        # Another round of leaders for as long as they link at least a tenth of what they are compared with.
        turn += 1
        last = turn >= turns or 10 * n_new < n_pairs or not n_pairs
    if labels is not None:
        classes = stored(classes.join(labels, "id", "left").withColumn("id", F.coalesce("label", "id")).select(*_CLASS, "id"))
    out = members.join(classes, [*_CLASS], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)""",
}
QUERIES = {"op4_jaccard_join": op4_jaccard_join}
