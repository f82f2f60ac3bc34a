"""Exact statistics on counts and series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import cumulative, mean_ranks


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher test of the 2x2 table [[a, b], [c, d]]: P(at least a) in the hypergeometric tail."""
    top = int(max(1, (a + b + c + d).fillna(0).max())) if len(a) else 1
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 2)))))
    out = []
    for w, x, y, z in zip(a, b, c, d, strict=True):
        if any(math.isnan(v) for v in (w, x, y, z)):
            out.append(None)
            continue
        w, x, y, z = int(w), int(x), int(y), int(z)
        k = np.arange(w, min(w + x, w + y) + 1)
        const = log[w + x] + log[y + z] + log[w + y] + log[x + z] - log[w + x + y + z]
        p = np.exp(const - log[k] - log[w + x - k] - log[w + y - k] - log[z - w + k])
        out.append(min(1.0, float(p.sum())))
    return pd.Series(out, dtype="float64")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> dict[str, Column]:
    """lo, hi and middle of Wilson's interval; without trials (0, 1, 0.5)."""
    p, z2 = hits / n, z * z
    denominator = 1 + z2 / n
    middle = (p + z2 / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denominator
    pick = lambda x, empty: F.when(n > 0, x).otherwise(F.lit(empty))
    return {"lo": pick(F.greatest(middle - half, F.lit(0.0)), 0.0), "hi": pick(F.least(middle + half, F.lit(1.0)), 1.0), "mid": pick(middle, 0.5)}


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str], tie: Sequence[str] = (), q: float = 0.05) -> DataFrame:
    """q-values by step-up, and whether each test is rejected at level q. Equal p have equal q, whatever their order (`tie` is not
    needed any more). A family may hold most of the tests: ranks and the least of what follows are found by ranges of p."""
    c = cumulative(df, p, key=family)
    c = c.withColumn("_raw", F.col(p) * (F.col("le") + F.col("ge") - F.col("c")) / F.col("le"))
    after = Window.partitionBy(*family, "range").orderBy(F.desc(p))
    least = c.groupBy(*family, "range").agg(F.min("_raw").alias("_least"))
    beyond = Window.partitionBy(*family).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.withColumn("_beyond", F.min("_least").over(beyond)).drop("_least")  # a row for each family and range
    found = c.withColumn("_here", F.min("_raw").over(after)).join(least, [*family, "range"])
    found = found.select(*family, p, F.least(F.lit(1.0), "_here", "_beyond").alias("q_value"))
    return df.where(F.col(p).isNotNull()).join(found, [*family, p]).select(*df.columns, "q_value", (F.col("q_value") <= q).alias("rejected"))


def finite_lift(a: Column, n: Column, b: Column, m: Column) -> Column:
    """(a / n) over (b / m), the latter at least half an event."""
    return F.when((n > 0) & (m > 0), (a / n) / F.greatest(b / m, 1 / (2 * m)))


def spearman(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties. Ranks are found by counts of values, not by ordering a key in one task."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, x, y)
    ranked = mean_ranks(mean_ranks(rows, key, x, "_x"), key, y, "_y")
    return ranked.groupBy(*key).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def theil_sen(df: DataFrame, key: Sequence[str], x: str, y: str, most: int = 4000) -> DataFrame:
    """Median of pairwise slopes and the intercept, per key. A key holds at most `most` points (a bounded series,
    such as one value a year); more are an error, as the pairs of one key meet in one task."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[x, y])
        if len(rows) > most:
            raise ValueError(f"a series of {len(rows)} points")
        a, b = rows[x].to_numpy(float), rows[y].to_numpy(float)
        i, j = np.triu_indices(len(a), 1)
        ok = a[i] != a[j]
        slope = float(np.median((b[j] - b[i])[ok] / (a[j] - a[i])[ok])) if ok.any() else 0.0
        out = rows[list(key)].head(1).copy()
        out["slope"], out["intercept"], out["n"] = slope, float(np.median(b - slope * a)) if len(b) else 0.0, len(b)
        return out

    schema = ", ".join(f"{f} {t}" for f, t in df.dtypes if f in key) + ", slope double, intercept double, n long"
    return df.select(*key, x, y).groupBy(*key).applyInPandas(fit, schema)


def near_miss(fires: Column, followed: Column, near_fires: Column, near_followed: Column, base: Column) -> dict[str, Column]:
    """FUSION if fires are followed at least twice as often as near misses, and not by chance."""
    rate = followed / fires
    near = F.when(near_fires > 0, near_followed / near_fires).otherwise(0.0)
    near_floor = F.greatest(near, base, 1 / (2 * F.when(near_fires > 0, near_fires).otherwise(fires)))
    ratio = F.when(fires > 0, rate / near_floor).otherwise(0.0)
    p = F.when(fires > 0, fisher_greater(followed, fires - followed, near_followed, near_fires - near_followed)).otherwise(1.0)
    return {"ratio": ratio, "p": p, "verdict": F.when((ratio >= 2) & (p < 0.05), "FUSION").otherwise("DECORATION")}


#: Links that a task joins to trees at once.
LINKS = 1 << 19


def _trees(batches):
    """(id, root) of a task's links (a, b): each id with the smallest one it is joined with, roots with themselves."""
    parts = list(batches)
    if not parts:
        return
    held = pa.Table.from_batches(parts)
    ids, at = np.unique(np.concatenate([held.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    low, high = at.reshape(2, -1)
    root = np.arange(len(ids))
    while len(low):
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        low, high = np.minimum(root[low], root[high]), np.maximum(root[low], root[high])
        apart = low != high
        low, high = low[apart], high[apart]
    yield pa.RecordBatch.from_arrays([pa.array(ids, held.schema.field("a").type), pa.array(ids[root], held.schema.field("a").type)], ["id", "root"])


def union_find(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component.

    In a round each task joins a range of the links to trees under their smallest ids. An id that is nowhere a root takes the label of
    its root and is done with; the links of the next round are those between roots that such an id has in several tasks, and those of
    roots below other roots. The greatest id is never a root, so each round has fewer ids, and the last one's links fit a task."""
    known = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    kind = known.schema["a"].dataType.simpleString()
    links, settled = known.where("a <> b"), []
    while n := links.count():
        tasks = -(-n // LINKS)
        trees = links.repartitionByRange(tasks, "a", "b").mapInArrow(_trees, f"id {kind}, root {kind}").checkpoint()
        if tasks == 1:
            settled.append(trees.where("id <> root").select("id", F.col("root").alias("up")))
            break
        g = trees.groupBy("id").agg(F.max(F.col("id") == F.col("root")).alias("top"), F.sort_array(F.collect_set(F.when(F.col("id") != F.col("root"), F.col("root")))).alias("roots"))
        settled.append(g.where("not top").select("id", F.get("roots", F.lit(0)).alias("up")))
        below = g.where("top").select(F.explode("roots").alias("a"), F.col("id").alias("b"))
        beside = g.where("not top").select(F.get("roots", F.lit(0)).alias("a"), F.explode(F.slice("roots", 2, 1 << 30)).alias("b"))
        links = below.union(beside).distinct().checkpoint()
    labels = known.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    if settled:
        found = settled.pop().withColumnRenamed("up", "label")
        for step in reversed(settled):
            later = found.select(F.col("id").alias("up"), "label")
            found = step.join(later, "up", "left").select("id", F.coalesce("label", "up").alias("label")).union(found)
        labels = labels.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return labels


def empirical_p(observed: DataFrame, nulls: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """The observed rows with p = (1 + null values of the key that reach the observed one) / (1 + null values of the key).
    A key's null values are its replicates, a stated number; keys are many."""
    pool = nulls.select(*key, F.col(value).alias("_null"))
    counts = observed.join(pool, list(key), "left").groupBy(*key, value).agg(F.count_if(F.col("_null") >= F.col(value)).alias("_k"), F.count("_null").alias("_n"))
    return counts.select(*key, value, F.col("_n").alias("replicates"), ((1 + F.col("_k")) / (1 + F.col("_n"))).alias("p"))
