"""Ranks and running sums within keys that may hold most of the rows: by ranges, so that no task sees a whole key.

Rows are dealt into sorted ranges and kept there by a checkpoint; what a range needs to know of those before it is one row for each
key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.archive import shared_folder

PARTS = 64


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "number", total: str | None = None, parts: int = PARTS) -> DataFrame:
    """Row numbers from 1 within each key in the order of columns (nulls first), as row_number() gives them; with `total` also the key's
    rows. Rows equal in key and order have numbers in any order among themselves, and the same ones for good."""
    shared_folder(df.sparkSession)
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": place}).checkpoint()
    by = [*key, "_part"]
    ranges = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each key and range that holds some of it.
    window = Window.partitionBy(*key)
    before = ranges.withColumn("_before", F.sum("_n").over(window.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(window))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = rows.alias("l").join(before.alias("r"), same)
    made = {out: (F.col("_at") - F.col("_first") + F.col("_before") + 1)} | ({total: F.col("_all")} if total else {})
    return joined.select(*(F.col(f"l.{c}") for c in df.columns if c not in made), *(c.alias(name) for name, c in made.items()))


def cumulative(values: DataFrame, value: str, weight: Column | None = None, parts: int = PARTS, key: Sequence[str] = ()) -> DataFrame:
    """(key, value, c, le, ge) for each key and distinct value: how often it occurs, and how many values of the key lie at or below and at
    or above it; with a weight, its sums instead. Counted by value first, then dealt into ranges of values that all keys share."""
    shared_folder(values.sparkSession)
    per = values.where(F.col(value).isNotNull()).groupBy(*key, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("c"))
    cuts = per.agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 10_000).alias("_cuts"))
    part = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda b: b < F.col(value).cast("double")))
    rows = per.crossJoin(F.broadcast(cuts)).select(*key, value, "c", part.alias("_part")).checkpoint()  # one row
    sums = rows.groupBy(*key, "_part").agg(F.sum("c").alias("_sum"))
    window = Window.partitionBy(*key)
    before = sums.select(*key, "_part", (F.sum("_sum").over(window.orderBy("_part")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(window).alias("_all"))  # `parts` rows a key at most
    rows = rows.withColumn("_in", F.sum("c").over(Window.partitionBy(*key, "_part").orderBy(value)))
    out = rows.join(before if key else F.broadcast(before), [*key, "_part"])
    le = F.col("_before") + F.col("_in")
    return out.select(*key, value, "c", le.alias("le"), (F.col("_all") - le + F.col("c")).alias("ge"), F.col("_part").alias("range"))


def mean_ranks(df: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """The rows with a value, with its rank within the key; equal values share the mean of their ranks."""
    ranks = cumulative(df, value, key=key).select(*key, value, (F.col("le") - (F.col("c") - 1) / 2).alias(out))
    return df.where(F.col(value).isNotNull()).join(ranks, [*key, value])
