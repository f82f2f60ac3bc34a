"""Vector search by lists: vectors are dealt to the nearest of some centres, and a query looks into the nearest lists.

The centres are fitted on a bounded sample; every vector is indexed. Written as a table partitioned by `list`, a query
reads the partitions it probes only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import compared, unit


def _units(values) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in values])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def fit(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres (unit vectors) of spherical k-means on at most about `sample` vectors, chosen by a hash of id and values."""
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    n = rows.count()
    if n > sample:  # a 64-bit bound: the share of a sample among any number of rows is above 0
        rows = rows.where(F.xxhash64(id_col, vector, F.lit(3)) < F.lit((sample << 64) // n - (1 << 63)))
    held = rows.select(id_col, vector).toPandas().sort_values(id_col)
    x = _units(held[vector]) if len(held) else np.zeros((0, 1))
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=len(centres)) == 0
        sums[empty] = centres[empty]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(centres, count: int):
    @F.pandas_udf("array<int>")
    def near(values: pd.Series) -> pd.Series:
        c = centres.value
        ok = values.map(lambda v: v is not None and len(v) == c.shape[1])
        out = pd.Series([[]] * len(values), index=values.index, dtype=object)
        if ok.any():
            order = np.argsort(-(_units(values[ok]) @ c.T), axis=1, kind="stable")[:, :count]
            out[ok] = pd.Series(order.tolist(), index=values.index[ok])
        return out

    return near


def assign(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every vector with the number of its list; those of another length or null have none."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    return vectors.withColumn("list", F.try_element_at(_nearest(shared, 1)(vector), F.lit(1)))


def search(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, top: int, probes: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank) among the lists nearest to each query, by matrix products of a list's vectors and the queries
    that probe it; the query itself is left out, and so is a vector without a direction."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    side = F.lit(None).cast("string").alias("side")
    q = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vector)).alias("q"), side, _nearest(shared, probes)(vector).alias("lists"))
    rows = indexed.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v"), side, "list")
    return compared(rows, q, top)
