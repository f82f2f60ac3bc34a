"""Approximate nearest neighbours by inner product: lists around centres, scanned by an adaptive number of dimensions.

Index: directions of a bounded sample are clustered; every vector goes to the list of its nearest centre, and lists lie
one after the other in a stored table whose partitions hold about as many rows each (a large list is dealt over several).
How many lists a query probes is not guessed: it is the least number at which the sample's own queries find `target` of
their true neighbours within the sample.

Scan: vectors are turned by one random rotation, after which every block of columns is a fair sample of a distance.
Within a list all pairs of queries and vectors get their inner products block by block. After k of d columns the
distance is estimated by d / k of the partial one, and the pair is given up if the estimate exceeds the distance that is
needed by a factor of more than (1 + EPSILON / sqrt(k)); what is left is compacted, and pairs that are few go on one by
one. The distance needed follows from the score to beat: |q|^2 + |x|^2 - 2 q.x, so vectors of any length are served. A
first round over the nearest lists of each query finds a score to beat, with which the second round over the other lists
begins. Pairs that survive all columns are scored on the original vectors, in double, from the first component to the last.

Queries are a stated set; they go out in blocks of `BLOCK_BYTES`, and only their best rows leave a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; of rows that share an id the one whose vector sorts first counts; vectors are compared with those of their
own number of components only; a query's own id is no candidate; equal scores go by id; if there are fewer candidates
than asked for, all are returned; other columns of any name are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import sampled, small_batches, stored, table

#: Largest number of lists; rows of a list, if so many lists are enough; rows and bytes of the sample that centres are fitted on.
LISTS, LIST_ROWS, SAMPLE, SAMPLE_BYTES = 1024, 512, 20_000, 48 << 20
#: Numbers of components, the most frequent ones, for which lists are made; vectors of others are in one list each.
LENGTHS = 16
#: Strictness of the test that gives a pair up, and columns looked at between two tests.
EPSILON, COLUMNS = 2.1, 16
#: Bytes of queries that are sent out at once; rows and queries that are compared at once.
BLOCK_BYTES, ROWS, QUERIES_AT_ONCE = 24 << 20, 2048, 512
_INDEXED = "id long, v array<double>, list int"
_HITS = "query_id long, id long, score double"
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """One random orthogonal matrix for each number of components."""
    if d not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(20240611 + d)).standard_normal((d, d)))
        _ROTATIONS[d] = q * np.sign(np.diag(r))
    return _ROTATIONS[d]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, one for each id."""
    v = F.col("v")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = small_batches(rows).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & fine).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _by_length(batch: pa.RecordBatch, column: str = "v"):
    """(number of components, rows of it) of a batch."""
    sizes = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield d, np.flatnonzero(sizes == d)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small components neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists:
    """Lists of the vectors of one number of components: centres, mean vectors, and how many a query probes."""

    def __init__(self, x: np.ndarray, lists: int, top: int, target: float, rounds: int = 10):
        u = _units(x)
        self.centres = u[np.linspace(0, len(u) - 1, lists).astype(int)]
        for _ in range(rounds):
            sums, empty = self._sums(u, u)
            sums[empty] = self.centres[empty]
            self.centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        sums, empty = self._sums(u, x)
        held = np.bincount(self.nearest(u), minlength=lists)
        self.means = np.where(empty[:, None], self.centres, sums / np.maximum(held, 1)[:, None])
        self.probes = self._probes(x, u, top, target) if lists > 1 else 1
        self.sizes = np.zeros(lists, np.int64)

    def nearest(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([(u[k : k + 4096] @ self.centres.T).argmax(axis=1) for k in range(0, len(u), 4096)])

    def _sums(self, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, sums = self.nearest(u), np.zeros_like(self.centres)
        np.add.at(sums, near, x)
        return sums, np.bincount(near, minlength=len(sums)) == 0

    def ranks(self, q: np.ndarray) -> np.ndarray:
        """Place of each list in each query's order."""
        order = np.argsort(-(q @ self.means.T), axis=1, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        return ranks

    def _probes(self, x: np.ndarray, u: np.ndarray, top: int, target: float) -> int:
        at = np.unique(np.linspace(0, len(x) - 1, 400).astype(int))
        scores = x[at] @ x.T
        scores[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-scores, min(top, len(x) - 1) - 1, axis=1)[:, :top]
        needed = np.sort(np.take_along_axis(self.ranks(x[at]), self.nearest(u)[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1

    def probed(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the lists that each query probes in the first round and in the second: `probes` lists, and more where
        these hold fewer than `least` rows."""
        ranks = self.ranks(q)
        sizes = np.zeros_like(ranks)
        np.put_along_axis(sizes, ranks, np.broadcast_to(self.sizes, ranks.shape), axis=1)
        before = np.cumsum(sizes, axis=1) - sizes  # rows in the lists before, by place
        often = np.maximum((before < least).sum(axis=1), self.probes)[:, None]
        first = ranks < -(-often // 8)
        return first, (ranks < often) & ~first


def fit(vectors: DataFrame, top: int = 20, target: float = 0.95, sample: int = SAMPLE) -> dict[int, Lists]:
    """Lists by number of components, from a sample of at most about `sample` rows and SAMPLE_BYTES. No row is left out of
    the index for it: lengths that the sample doesn't hold have one list."""
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    model = {}
    for d, n in lengths:
        lists = min(LISTS, n // LIST_ROWS)
        if lists > 1:
            held = sampled(vectors.where(F.size("v") == d), n, max(64, min(sample, SAMPLE_BYTES // (8 * d))), 11, "id", "v").orderBy("id").toArrow()
            if held.num_rows >= 64:
                model[d] = Lists(_matrix(held.column("v").combine_chunks()), max(1, min(lists, held.num_rows // 16)), top, target)
    return model


def _assign(shared):
    def run(batches):
        for batch in batches:
            lists = np.zeros(batch.num_rows, np.int32)
            for d, at in _by_length(batch):
                if d in shared.value:
                    lists[at] = shared.value[d].nearest(_units(_matrix(batch.column("v").take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], ["id", "v", "list"])

    return run


def index(vectors: DataFrame, model: dict[int, Lists]) -> DataFrame:
    """Every vector with its list, stored so that a partition holds whole lists, or an even share of a large one, in their
    order. Enters the sizes of the lists into the model."""
    spark = vectors.sparkSession
    assigned = stored(vectors.mapInArrow(_assign(spark.sparkContext.broadcast(model)), _INDEXED))
    kept = F.size("v").isin(list(model)) if model else F.lit(False)
    sizes = assigned.where(kept).groupBy(F.size("v").alias("d"), "list").count().orderBy("d", "list").collect()  # at most LENGTHS x LISTS rows
    total = assigned.count()
    each = min(1 << 16, max(ROWS, total // 64))
    places, before = [], 0
    for d, number, n in sizes:
        model[d].sizes[number] = n
        places.append((d, number, before // each, (before + n - 1) // each - before // each + 1))
        before += n
    parts = max(1, -(-total // each))
    # Vectors without lists are dealt over all partitions.
    place = spark.createDataFrame(places, "d int, number int, first int, shards int")
    rows = assigned.join(F.broadcast(place), (F.size("v") == F.col("d")) & (F.col("list") == F.col("number")), "left")
    to = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(parts)).cast("long")).cast("int")
    return stored(rows.withColumn("to", to).repartitionById(parts, F.col("to")).select("id", "v", "list").sortWithinPartitions(F.size("v"), "list"))


def _probing(shared, least: int):
    def run(batches):
        for batch in batches:
            first, rest = [b"\x80"] * batch.num_rows, [b"\x00"] * batch.num_rows
            for d, at in _by_length(batch):
                if d in shared.value:
                    for k in range(0, len(at), 1024):
                        some = at[k : k + 1024]
                        masks = shared.value[d].probed(_matrix(batch.column("v").take(pa.array(some))), least)
                        for out, mask in zip((first, rest), masks, strict=True):
                            for i, bits in zip(some.tolist(), np.packbits(mask, axis=1), strict=True):
                                out[i] = bits.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(first, pa.binary()), pa.array(rest, pa.binary())], ["query_id", "q", "first", "rest"])

    return run


class _Block:
    """Queries of one number of components: ids, vectors, the lists they probe, the score each has to beat."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("query_id").to_numpy()
        self.q = _matrix(rows.column("q").combine_chunks())
        self.bits = np.stack([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
        self.least = np.array([-np.inf if x is None else x for x in rows.column("least").to_pylist()], float)

    def probing(self, number: int) -> np.ndarray:
        return np.flatnonzero((self.bits[:, number >> 3] >> (7 - (number & 7))) & 1)


class Scan:
    """What a task knows of the queries of one length: the best scores so far and the rows that reach them."""

    def __init__(self, block: _Block, top: int):
        self.block, self.top, d = block, top, block.q.shape[1]
        self.turned = block.q @ rotation(d)
        self.best = np.full((len(block.ids), top), -np.inf)
        self.least = block.least.copy()
        self.slack = 1e-12 * d * np.abs(block.q).max(axis=1)
        self.found, self.size = [], 0
        #: Products of pairs and columns that a scan of everything would make, and those made.
        self.whole = self.made = 0

    def add(self, number: int, ids: np.ndarray, x: np.ndarray) -> None:
        asked = self.block.probing(number)
        if not len(asked):
            return
        # Equal vectors are compared once; more than top + 1 of their ids can't be among a query's best.
        same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, same))
        starts = np.flatnonzero(np.diff(same[order], prepend=-1))
        ends = np.minimum(np.append(starts[1:], len(order)), starts + self.top + 1)
        x = np.ascontiguousarray(x[order[starts]])
        turned = x @ rotation(x.shape[1])
        for k in range(0, len(asked), QUERIES_AT_ONCE):
            self._pairs(asked[k : k + QUERIES_AT_ONCE], x, turned, ids[order], starts, ends)

    def _pairs(self, asked, x, turned, ids, starts, ends) -> None:
        q, d = self.turned[asked], x.shape[1]
        qq, xx = (q * q).cumsum(axis=1), (turned * turned).cumsum(axis=1)
        self.whole += len(asked) * len(x) * d
        # A vector that only the query itself has is no candidate.
        dead = (ids[starts] == self.block.ids[asked][:, None]) & (ends - starts == 1)
        rows, cols = np.arange(len(asked)), np.arange(len(x))
        part, pairs = np.zeros((len(asked), len(x))), None
        need = self.least[asked] - self.slack[asked] * np.abs(x).max()
        for lo in range(0, d, COLUMNS):
            hi = min(lo + COLUMNS, d)
            if pairs is None:
                self.made += part.size * (hi - lo)
                part += q[np.ix_(rows, range(lo, hi))] @ turned[np.ix_(cols, range(lo, hi))].T
            else:
                self.made += len(part) * (hi - lo)
                part += np.einsum("pd,pd->p", q[pairs[0], lo:hi], turned[pairs[1], lo:hi])
            if hi == d:
                break
            factor = (1 + EPSILON / np.sqrt(hi)) ** 2 * hi / d
            if pairs is None:
                gone = qq[rows, hi - 1][:, None] + xx[cols, hi - 1] - 2 * part > factor * (qq[rows, -1][:, None] + xx[cols, -1] - 2 * need[rows][:, None])
                alive = ~(gone | dead)
                if alive.mean() < 0.05:  # few are left: pair by pair
                    i, j = np.nonzero(alive)
                    pairs, part = (rows[i], cols[j]), part[i, j]
                else:
                    r, c = alive.any(axis=1), alive.any(axis=0)
                    rows, cols, part, dead = rows[r], cols[c], part[np.ix_(r, c)], ~alive[np.ix_(r, c)]
            else:
                i, j = pairs
                keep = qq[i, hi - 1] + xx[j, hi - 1] - 2 * part <= factor * (qq[i, -1] + xx[j, -1] - 2 * need[i])
                pairs, part = (i[keep], j[keep]), part[keep]
        if pairs is None:
            i, j = np.nonzero(~dead & (part >= need[rows][:, None]))
            i, j, score = rows[i], cols[j], part[i, j]
        else:
            keep = part >= need[pairs[0]]
            i, j, score = pairs[0][keep], pairs[1][keep], part[keep]
        self._take(asked, i, j, score, x, ids, starts, ends)

    def _take(self, asked, i, j, score, x, ids, starts, ends) -> None:
        """The best `top` vectors of each query, and those that tie with the last of them, become hits."""
        if not len(i):
            return
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        merged = np.full((len(asked), 2 * self.top), -np.inf)
        merged[:, : self.top] = self.best[asked]
        few = place < self.top
        merged[i[few], self.top + place[few]] = score[few]
        self.best[asked] = -np.sort(-merged, axis=1)[:, : self.top]
        self.least[asked] = np.maximum(self.least[asked], self.best[asked, -1])
        slack = self.slack[asked] * np.abs(x).max()
        keep = score >= self.least[asked][i] - slack[i]
        i, j = i[keep], j[keep]
        exact = np.zeros(len(i))
        for k in range(x.shape[1]):  # in this order in every task, so that equal vectors have equal scores
            exact += self.block.q[asked[i], k] * x[j, k]
        n = (ends - starts)[j]
        at = np.repeat(starts[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, hit = np.repeat(asked[i], n), ids[at]
        other = hit != self.block.ids[who]
        self.found.append((who[other], hit[other], np.repeat(exact, n)[other]))
        self.size += int(other.sum())
        if self.size > 1 << 20:
            self._prune()

    def _prune(self) -> None:
        who, hit, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((hit, -score, who))
        who, hit, score = who[order], hit[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.top
        self.found, self.size = [(who[keep], hit[keep], score[keep])], int(keep.sum())

    def hits(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        self._prune()
        who, hit, score = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.block.ids[who]), pa.array(hit), pa.array(score)], ["query_id", "id", "score"])


def _scan(shared, top: int):
    def run(batches):
        scans = {d: Scan(block, top) for d, block in shared.value.items()}
        for batch in batches:
            numbers = batch.column("list").to_numpy()
            for d, at in _by_length(batch):
                if d in scans:
                    cuts = [0, *(np.flatnonzero(np.diff(numbers[at])) + 1).tolist(), len(at)]
                    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                        for k in range(lo, hi, ROWS):
                            some = at[k : min(k + ROWS, hi)]
                            scans[d].add(int(numbers[some[0]]), batch.column("id").to_numpy()[some], _matrix(batch.column("v").take(pa.array(some))))
        for scan in scans.values():
            found = scan.hits()
            if found is not None:
                for k in range(0, found.num_rows, 1 << 16):
                    yield found.slice(k, 1 << 16)

    return run


def _round(indexed: DataFrame, queries: DataFrame, bits: str, blocks: int, top: int) -> DataFrame:
    """(query_id, id, score) of the lists that `bits` names; the index is read once for each block of queries."""
    found = None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "q", F.col(bits).alias("bits"), "least").orderBy("query_id").toArrow()
        lengths = pa.compute.list_value_length(held.column("q"))
        parts = {d: _Block(held.filter(pa.compute.equal(lengths, d))) for d in pa.compute.unique(lengths).to_pylist()}
        hits = stored(indexed.mapInArrow(_scan(indexed.sparkSession.sparkContext.broadcast(parts), top), _HITS))
        found = hits if found is None else found.unionByName(hits)
    return found


def search(base: DataFrame, queries: DataFrame, top: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = 0.95) -> DataFrame:
    """(query_id, rank, id, score) of the `top` nearest found for each of the stated queries."""
    vectors = stored(usable(base, key, vector))
    model = fit(vectors, top, target)
    indexed = index(vectors, model)
    shared = base.sparkSession.sparkContext.broadcast(model)
    probing = usable(queries, key, vector).mapInArrow(_probing(shared, top + 1), "query_id long, q array<double>, first binary, rest binary")
    asked = stored(probing).withColumn("least", F.lit(None).cast("double"))
    n_bytes = asked.agg(F.sum(8 * F.size("q") + F.octet_length("first") + 64)).first()[0] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    early = _round(indexed, asked, "first", blocks, top).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    early = stored(early.drop("rank"))
    least = early.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
    late = _round(indexed, stored(asked.drop("least").join(least, "query_id", "left")), "rest", blocks, top)
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "id", "score")


def op11_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op11_dimension_scan": op11_dimension_scan}
