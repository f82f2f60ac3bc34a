"""Token counts under a sentence-piece BPE model, by rank-synchronous merging of numpy arrays.

The model's white space symbol only ever opens a piece (or stands in runs of its own), and no piece holds a line
feed, so a text falls into pre-tokens that merge independently: a run of spaces with what follows it up to the next
space, and each line feed. Both facts are tested on the vocabulary when it is loaded. The distinct new pre-tokens of
a batch are held as a ragged array of symbols; in every step each sequence applies its pair of lowest rank (leftmost
first), all sequences at once, until none has a pair left. Surviving symbols are counted; one outside the vocabulary
counts its UTF-8 bytes, as byte fallback does. Counts are remembered by pre-token in a table of bounded size.

Defined results: a null or empty text has 0 tokens; rows are independent of each other, so repeated rows, null
keys and empty tables need no rule; texts of any length are counted whole; other columns of any name are not looked at.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import keyed, table

_PRETOKEN = re.compile(" *[^ \n]+| +|\n")
#: Pre-tokens remembered by a worker, and the longest one that is remembered.
REMEMBERED, LONGEST = 1_000_000, 64
#: Longer pre-tokens are merged by a heap, whose cost is n log n; the synchronous steps would cost n**2.
SYNCHRONOUS = 96
_LOADED: dict[str, PieceModel] = {}


class PieceModel:
    """The merge table of a model: symbols by number, ranks of pairs, bytes of what byte fallback has to spell."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        if any("▁" in p.lstrip("▁") or "\n" in p for p, _ in pieces):
            raise ValueError("a piece crosses the pre-tokens of this operator")
        score = dict(pieces)
        self.symbol = {p: i for i, p in enumerate(dict.fromkeys([*score, *(c for p in score for c in p)]))}
        rank = {s: r for r, s in enumerate(sorted({-s for s in score.values()}))}
        self.cost = np.array([1 if s in score else len(s.encode()) for s in self.symbol], np.int64)
        table = sorted({(self.symbol[p[:k]] << 32 | self.symbol[p[k:]], rank[-v], self.symbol[p]) for p, v in score.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol})
        self.pairs, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*table, strict=True))
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; a rank beyond all others where the pair has no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], 1 << 40), self.merged[at]

    def symbols(self, token: str) -> tuple[list[int], int]:
        """(symbols, -1 for those that no piece holds; UTF-8 bytes of the latter)."""
        out = [self.symbol.get(c, -1) for c in token]
        return out, sum(len(c.encode("utf-8", "surrogatepass")) for c, s in zip(token, out, strict=True) if s < 0)

    def count_many(self, tokens: list[str]) -> list[int]:
        """Counts of distinct pre-tokens, the steps of all of about one length together."""
        out = [0] * len(tokens)
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        lo = 0
        while lo < len(order):
            width = len(tokens[order[lo]])
            if width > SYNCHRONOUS:
                out[order[lo]] = self.count_long(tokens[order[lo]])
                lo += 1
                continue
            hi = lo
            while hi < len(order) and len(tokens[order[hi]]) <= width + 2 and hi - lo < 1 << 15:
                hi += 1
            for i, n in zip(order[lo:hi], self._merge([tokens[i] for i in order[lo:hi]]), strict=True):
                out[i] = n
            lo = hi
        return out

    def _merge(self, tokens: list[str]) -> list[int]:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        width = int(sizes.max())
        grid = np.full((len(tokens), width), -2, np.int64)  # -2: no symbol there any more
        flat, spelled = [], np.zeros(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            s, spelled[i] = self.symbols(t)
            flat += s
        grid[np.arange(width) < sizes[:, None]] = flat
        counts, alive = np.zeros(len(tokens), np.int64), np.arange(len(tokens))
        rank, to = self.rank_of(grid[:, :-1], grid[:, 1:]) if width > 1 else (np.zeros((len(tokens), 0), np.int64),) * 2
        while True:
            if grid.shape[1] > 1:
                at = rank.argmin(axis=1)  # the first of equal ranks: the leftmost
                rows = np.arange(len(grid))
                more = rank[rows, at] < 1 << 40
            else:
                more = np.zeros(len(grid), bool)
            if not more.all():
                done = grid[~more]
                counts[alive[~more]] = np.where(done >= 0, self.cost[done], 0).sum(axis=1)
                grid, rank, to, alive = grid[more], rank[more], to[more], alive[more]
                if not len(grid):
                    return (counts + spelled).tolist()
                at, rows = at[more], np.arange(len(grid))
            # The right symbol goes and what follows moves one place to the left.
            new = to[rows, at]
            places = np.arange(grid.shape[1] - 1)
            source = places + (places > at[:, None])
            grid = np.take_along_axis(grid, source, axis=1)
            grid[rows, at] = new
            places = places[:-1]
            source = places + (places > at[:, None])
            rank, to = np.take_along_axis(rank, source, axis=1), np.take_along_axis(to, source, axis=1)
            for place, ok in ((at - 1, at > 0), (at, at < rank.shape[1])):
                r, p = rows[ok], place[ok]
                rank[r, p], to[r, p] = self.rank_of(grid[r, p], grid[r, p + 1])

    def count_long(self, token: str) -> int:
        """The same merges by a heap of pairs over a linked list."""
        symbols, spelled = self.symbols(token)
        n = len(symbols)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = np.array(symbols, np.int64)
        rank, to = self.rank_of(first[:-1], first[1:])
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), to.tolist(), strict=True)) if r < 1 << 40]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], nxt[i] = m, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and nxt[left] < n:
                    r, t = self.rank_of(np.array([symbols[left]]), np.array([symbols[nxt[left]]]))
                    if r[0] < 1 << 40:
                        heapq.heappush(heap, (int(r[0]), left, symbols[left], symbols[nxt[left]], int(t[0])))
        return spelled + sum(int(self.cost[s]) for s, ok in zip(symbols, alive, strict=True) if ok and s >= 0)

    def count_texts(self, texts: list[str | None]) -> list[int]:
        # The model puts one space before a text that isn't empty, and takes its own space symbol for a space.
        parts = [_PRETOKEN.findall(" " + t.replace("▁", " ")) if t else () for t in texts]
        new = list({p for ps in parts for p in ps if p not in self.known})
        counted = dict(zip(new, self.count_many([p.replace(" ", "▁") for p in new]), strict=True))
        if len(self.known) + len(new) > REMEMBERED:
            counted |= {p: self.known[p] for ps in parts for p in ps if p in self.known}
            self.known = {}
        self.known.update(counted)
        get = self.known.__getitem__
        out = [sum(map(get, ps)) for ps in parts]
        for p in counted:
            if len(p) > LONGEST:
                del self.known[p]
        return out


def model_at(path: str) -> PieceModel:
    """One model a worker, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: n_bytes, n_tokens and whether it has more than `limit` tokens."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        model = model_at(model_path)
        for batch in batches:
            for part in ta.slices(batch, "text"):
                texts = part.column("text")
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                counts = pa.array(model.count_texts(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, counts], ["doc_id", "n_bytes", "n_tokens"])

    return keyed(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_token_counts": op8_token_counts}
