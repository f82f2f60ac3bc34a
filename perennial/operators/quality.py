"""Guards on sensor series, frost dates and tides: readings that are refused, not repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import doy_frost, season_year
from ..sources.archive import shared_folder
from .ranks import PARTS
from .series import day_number, equal_runs


def sensor_flags(df: DataFrame, key: Sequence[str], day: str, low: str, high: str, stuck: int = 5, season: Column | None = None) -> DataFrame:
    """The first flag of each row that has one: inversion (low above high), stuck (equal highs in a row), season."""
    runs = equal_runs(df, key, day, high, stuck).select(*key, F.explode(F.sequence("start_day", "end_day")).alias(day), F.lit(True).alias("_stuck"))
    flag = F.when(F.col(low) > F.col(high), "inversion").when(F.col("_stuck"), "stuck")
    if season is not None:
        flag = flag.when(season, "season")
    out = df.join(runs, [*key, day], "left").withColumn("flag", flag).drop("_stuck")
    return out.where("flag is not null")


def frost_dates(df: DataFrame, key: Sequence[str], day: str, low: str, high: str, freeze: float = 32.0, spread: float = 38.0, most_removed: float = 0.4) -> DataFrame:
    """Per key and year the last frost before 1 July and the first after it, with the season between; rows whose
    spread is implausible are removed, and a year that loses more than 40 % of its rows is dropped."""
    year = F.year(day)
    rows = df.withColumn("year", year).withColumn("_ok", (F.col(high) - F.col(low)).between(0, spread))
    share = rows.groupBy(*key, "year").agg(F.avg((~F.coalesce("_ok", F.lit(False))).cast("int")).alias("removed"))
    frost = rows.where(F.col("_ok") & (F.col(low) <= freeze))
    doy = doy_frost(F.col(day))
    spring, fall = F.max(F.when(F.month(day) < 7, doy)), F.min(F.when(F.month(day) >= 7, doy))
    out = frost.groupBy(*key, "year").agg(spring.alias("last_spring"), fall.alias("first_fall"))
    return out.join(share.where(F.col("removed") <= most_removed).select(*key, "year"), [*key, "year"]).withColumn("season_days", F.col("first_fall") - F.col("last_spring"))


def frost_climatology(dates: DataFrame, key: Sequence[str], least: int = 5) -> DataFrame:
    """10th, 50th and 90th percentiles of the frost dates, linear between ranks."""
    p = lambda c, q, name: F.percentile(c, F.lit(q)).alias(name)
    out = dates.groupBy(*key).agg(F.count("*").alias("years"), *(p(c, q, f"{c}_p{int(q * 100)}") for c in ("last_spring", "first_fall") for q in (0.1, 0.5, 0.9)))
    return out.where(F.col("years") >= least)


def tide_at(curve: DataFrame, asked: DataFrame, station: Sequence[str], at: str, height: str, step_minutes: int) -> DataFrame:
    """The height at each asked time on a line between the samples around it, its direction and a status: refused
    outside the curve, across a gap of more than two steps, or next to a missing height, and never 0 instead."""
    shared_folder(curve.sparkSession)
    point = F.struct(F.col("_t").alias("t"), F.col("_h").alias("h"))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    c = curve.select(*station, micros.alias("_t"), F.lit(0).alias("_side"), F.col(height).cast("double").alias("_h")).dropna(subset=[*station, "_t"])
    a = asked.select(*station, micros.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_h"))
    # Ranges of a station's times; what a range needs of those before and after it is one sample on each side.
    rows = c.unionByName(a).repartitionByRange(PARTS, *station, "_t", "_side").withColumn("_part", F.spark_partition_id()).checkpoint()
    by = [*station, "_part"]
    sample = F.when(F.col("_side") == 0, point)
    ends = rows.groupBy(*by).agg(F.min(sample).alias("_first"), F.max(sample).alias("_last"))
    others = lambda order: Window.partitionBy(*station).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, F.last("_last", ignorenulls=True).over(others(F.col("_part"))).alias("_before"), F.last("_first", ignorenulls=True).over(others(F.desc("_part"))).alias("_after"))
    # Both windows run from their first row to the current one: one that reaches forward would read the rest again for each row.
    so_far = lambda *order: F.last(sample, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    j = rows.withColumns({"_b": so_far("_t", "_side"), "_a": so_far(F.desc("_t"), F.desc("_side"))}).where("_side = 1")
    j = j.alias("l").join(ends.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    j = j.select(*(F.col(f"l.{k}") for k in station), "_t", F.coalesce("_b", "_before").alias("_b"), F.coalesce("_a", "_after").alias("_a"))
    exact = F.col("_b.t") == F.col("_t")
    gap = (F.col("_a.t") - F.col("_b.t")) / 6e7
    status = F.when(exact, F.when(F.col("_b.h").isNotNull(), "ok").otherwise("missing")).when(F.col("_b").isNull() | F.col("_a").isNull(), "out of range").when(gap > 2 * step_minutes, "gap").when(F.col("_b.h").isNull() | F.col("_a.h").isNull(), "missing").otherwise("ok")
    line = F.col("_b.h") + (F.col("_a.h") - F.col("_b.h")) * (F.col("_t") - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    value = F.when(F.col("status") == "ok", F.when(exact, F.col("_b.h")).otherwise(line))
    change = F.col("_a.h") - F.col("_b.h")
    direction = F.when(F.col("status") == "ok", F.when(change > 0, "rising").when(change < 0, "falling").otherwise("slack"))
    return j.withColumn("status", status).select(*station, F.timestamp_micros("_t").alias(at), value.alias(height), direction.alias("direction"), "status")


def season_of(day: Column) -> Column:
    return season_year(day)


def recent_by_doy(df: DataFrame, key: Sequence[str], day: str, value: str, as_of: str, within: int) -> DataFrame:
    """The freshest value of each key in the `within` days up to as_of, with its age."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(day))
    rows = df.where(age.between(0, within) & F.col(value).isNotNull())
    return rows.groupBy(*key).agg(F.max_by(value, day_number(day)).alias(value), F.min(age).alias("age_days"))
