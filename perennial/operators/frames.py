"""Frames: a day's slots as bytes, and days that rhyme with another."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import doy_offset

MISSING = 255


def to_byte(pct: Column) -> Column:
    """round(pct * 254), 255 for a missing one."""
    return F.coalesce(F.floor(pct * 254 + 0.5).cast("int"), F.lit(MISSING))


def tail_value(byte: Column) -> Column:
    """sign(u) * |u| ** 1.5 of u = 2 * byte / 254 - 1; null for a missing one."""
    u = 2 * byte / 254.0 - 1
    return F.when(byte != MISSING, F.signum(u) * F.pow(F.abs(u), F.lit(1.5)))


def pack(slots: DataFrame, day: str, slot: str, byte: str, n_slots: int) -> DataFrame:
    """One row a day with all bytes as hex text; slots without a row are missing."""
    held = F.map_from_entries(F.collect_list(F.struct(slot, byte)))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("_m", i), F.lit(MISSING)).cast("long")), 2, "0"))
    return slots.groupBy(day).agg(held.alias("_m")).select(day, F.array_join(cells, "").alias("dots"))


def serve(frames: DataFrame, day_from: str, day_to: str, layout: int, day: str = "day", most: int = 120) -> DataFrame:
    """The frames of a range of at most `most` days that have the current layout; frames of another one are left out, as their bytes mean
    other slots. A range that ends before it begins, or is too long, is refused."""
    first, last = dt.date.fromisoformat(day_from), dt.date.fromisoformat(day_to)
    if last < first:
        raise ValueError(f"the range ends on {day_to}, before {day_from}")
    if (last - first).days > most:
        raise ValueError(f"a range of {(last - first).days} days; at most {most} are served")
    return frames.where(F.col(day).between(F.lit(first), F.lit(last)) & (F.col("layout") == layout))


def unpack(frames: DataFrame, day: str, dots: str) -> DataFrame:
    """The long form of packed frames: day, slot, byte (null if missing); odd or non-hex text is an error."""
    ok = frames.withColumn("_ok", F.when((F.length(dots) % 2 == 0) & F.col(dots).rlike("^[0-9A-Fa-f]*$"), True).otherwise(F.raise_error(F.lit("not a packed frame")).cast("boolean")))
    cells = F.transform(F.sequence(F.lit(0), (F.length(dots) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(F.col(dots), i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    out = ok.where("_ok").select(day, F.posexplode(cells).alias("slot", "byte"))
    return out.withColumn("byte", F.when(F.col("byte") != MISSING, F.col("byte")))


def match(frames: DataFrame, targets: DataFrame, min_overlap: int = 80, top: int = 12, exclude: int = 3, doy_window: int | None = None, day: str = "day", slot: str = "slot", byte: str = "byte") -> DataFrame:
    """The days most like each target day: cosine times agreement of magnitudes over the slots both have.

    All sums for all pairs of days come from one join on the slot and one aggregation. `targets` (a column `day`)
    is a stated query set; its frames meet all frames, and nothing else does."""
    long = frames.select(F.col(day).alias("day"), F.col(slot).alias("slot"), tail_value(F.col(byte)).alias("y")).where("y is not null")
    query = long.join(targets.select(F.col("day")), "day").select(F.col("day").alias("target"), "slot", F.col("y").alias("x"))
    apart = (F.col("day") != F.col("target")) & (F.abs(F.datediff("day", "target")) > exclude)
    if doy_window is not None:
        apart &= doy_offset(F.col("day"), F.col("target")) <= doy_window
    sums = long.join(query, "slot").where(apart).groupBy("target", "day").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("overlap"))
    scored = sums.where((F.col("overlap") >= min_overlap) & (F.col("xx") > 0) & (F.col("yy") > 0))
    ratio = F.sqrt(F.col("xx") / F.col("yy"))
    scored = scored.withColumn("cos", F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).withColumn("mag_agree", F.least(ratio, 1 / ratio))
    scored = scored.withColumn("score", F.col("cos") * F.col("mag_agree"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.round("score", 9).desc(), "day"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("target", "day", "score", "cos", "mag_agree", "overlap", "rank")
