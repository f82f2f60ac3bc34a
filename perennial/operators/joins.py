"""Joins that Spark has no operator for: intervals, what followed, as of, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_day: str, right_day: str, lo: int, hi: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose right day lies lo..hi days after the left one.

    Days are dealt into buckets as wide as the interval; a left row goes to the one or two buckets that its interval
    meets. So it is an equi-join on keys and bucket, which shuffles and spills, and no nested loop: a row meets the
    rows of two interval widths only. The right side's columns must have other names than the left side's, but for
    the keys.
    """
    if lo > hi:
        raise ValueError("lo is after hi")
    width = hi - lo + 1
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    right = right.withColumn("_bucket", F.floor(number(right_day) / width)).where(F.col(right_day).isNotNull())
    first, last = (F.floor((number(left_day) + k) / width) for k in (lo, hi))
    keyed = left.withColumn("_bucket", F.explode_outer(F.array_distinct(F.array(first, last))))
    inside = F.datediff(F.col(right_day), F.col(left_day)).between(lo, hi)
    if how == "inner":
        return keyed.join(right, [*on, "_bucket"]).where(inside).drop("_bucket")
    if how != "left":
        raise ValueError("inner or left")
    tagged = left.withColumn("_row", F.struct(*left.columns))
    matched = interval_join(tagged.select("_row", *left.columns), right.drop("_bucket"), on, left_day, right_day, lo, hi)
    rest = [c for c in right.columns if c not in (*on, "_bucket")]
    grouped = matched.groupBy("_row").agg(F.collect_list(F.struct(*rest)).alias("_found"))
    distinct = left.withColumn("_row", F.struct(*left.columns))
    out = distinct.join(grouped, distinct["_row"].eqNullSafe(grouped["_row"]), "left").withColumn("_one", F.explode_outer("_found"))
    return out.select(*left.columns, *(F.col(f"_one.{c}").alias(c) for c in rest))


def followed(left: DataFrame, right: DataFrame, on: Sequence[str], left_day: str, right_day: str, days: int, first: Sequence[Column], key: Sequence[str]) -> DataFrame:
    """For each left row the first, by `first`, of the right rows in the next 1..days days; nulls if nothing followed."""
    hits = interval_join(left, right, on, left_day, right_day, 1, days)
    ranked = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*first))).where("_k = 1").drop("_k")
    rest = [c for c in ranked.columns if c not in left.columns]
    return left.join(ranked.select(*key, *rest), list(key), "left")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], within: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row at or before it: one union and one window, one shuffle.
    `within` limits how old it may be; it sees left_time and right_time."""
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_time].dataType).alias(right_time), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in on]
    r = right.select(*on, *blank, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), right_time, *values).where(F.col(right_time).isNotNull())
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct(right_time, *values)), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("_last", last).where("_side = 1")
    out = out.select(*left.columns, F.col(f"_last.{right_time}").alias(right_time), *(F.col(f"_last.{v}").alias(v) for v in values))
    if within is not None:
        out = out.withColumns({c: F.when(within, F.col(c)) for c in (*values, right_time)})
    return out


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by `order`."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def first_of(base: DataFrame, on: Sequence[str], sources: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """The value from the first source that has it, with the source's name."""
    out = base
    for k, (_, source) in enumerate(sources):
        out = out.join(source.select(*on, F.col(value).alias(f"_v{k}")), list(on), "left")
    columns = [F.col(f"_v{k}") for k in range(len(sources))]
    label = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for c, (name, _) in zip(columns, sources, strict=True)))
    return out.select(*base.columns, F.coalesce(*columns).alias(value), label.alias("source"))


def nearest(points: DataFrame, places: DataFrame, distance: Column, key: Sequence[str], tie: Sequence[str], most_places: int = 100_000) -> DataFrame:
    """Each point with its nearest place. The places are a dimension: their number is counted and must stay below
    `most_places`, as each task holds them all."""
    if places.count() > most_places:
        raise ValueError("too many places to hold in each task; give them cells and use an equi-join")
    hits = points.join(F.broadcast(places), how="cross").withColumn("distance", distance)
    return latest(hits, key, [F.col("distance"), *map(F.col, tie)])
