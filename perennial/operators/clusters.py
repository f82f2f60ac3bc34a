"""Anchor merging, state arcs and polygons: the few operators whose fold is ordered or whose shape is no join."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_anchors(df: DataFrame, family: str, row_id: str, day: str, states: str, within: int = 7) -> DataFrame:
    """Each row with the number of its cluster: rows of a family in order of day and id, each into the first cluster
    whose last day is at most `within` days before and which shares a state; clusters bridged later stay apart.

    The rule is an ordered fold. No cluster reaches across a gap of more than `within` days without a row, so a family is cut there
    exactly, each island is folded by itself, and numbers go on from island to island."""
    days = df.select(family, day).distinct()
    w = Window.partitionBy(family).orderBy(day)
    days = days.withColumn("_new", F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > within).cast("int"), F.lit(1)))
    days = days.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([day, row_id], kind="stable")
        live: list[list] = []
        out, number = [], 0
        for d, s in zip(pd.to_datetime(rows[day]), rows[states], strict=True):
            mine = set(s) if s is not None else set()
            live = [c for c in live if (d - c[1]).days <= within]
            hit = next((c for c in live if c[2] & mine), None)
            if hit is None:
                hit = [number, d, set()]
                live.append(hit)
                number += 1
            hit[1] = max(hit[1], d)
            hit[2] |= mine
            out.append(hit[0])
        return rows[[family, row_id, "_island"]].assign(_own=np.array(out, np.int64))

    kinds = dict(df.dtypes)
    rows = df.select(family, row_id, day, states).join(days, [family, day])
    folded = rows.groupBy(family, "_island").applyInPandas(fold, f"{family} {kinds[family]}, {row_id} {kinds[row_id]}, _island long, _own long")
    # How many clusters the islands before have: a row for each island.
    counts = folded.groupBy(family, "_island").agg((F.max("_own") + 1).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(family).orderBy("_island")) - F.col("_n")).drop("_n")
    return folded.join(before, [family, "_island"]).select(family, row_id, (F.col("_own") + F.col("_before")).alias("cluster"))


def merged_spans(df: DataFrame, row_id: str, key: Sequence[str], start: str, end: str) -> DataFrame:
    """The rows with `label`: the smallest id among the rows that a row is linked with, where rows of equal keys are linked if their
    spans of days (both ends counted) share a day. A row without a key, start or end is alone, and one without an id is left out.

    Spans that overlap form islands along the calendar, so no pair of rows is made: a row for each key and day is ordered, and a day
    that no earlier span reaches begins an island. A span that ends before it starts meets only those that hold both its days.
    Rows of one id link their islands."""
    from .statistics import union_find

    turned = F.col(end) < F.col(start)
    low, high = F.least(start, end), F.greatest(start, end)
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    for c in key:
        whole = whole & F.col(c).isNotNull()
    rows = df.where(F.col(row_id).isNotNull()).withColumns({"_low": F.when(whole, low), "_high": high, "_turned": turned, "_own": F.when(turned, high).otherwise(low)})
    at = [*key, "_low", "_turned", "_own"]
    spans = rows.where(whole).groupBy(*at).agg(F.max("_high").alias("_high"), F.min(row_id).alias("_least"))
    w = Window.partitionBy(*key).orderBy("_low", "_turned")
    reach = F.max(F.when(~F.col("_turned"), F.col("_high"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_reach", reach)
    new = ~F.col("_turned") & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_low")))
    spans = spans.withColumn("_island", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.where(~F.col("_turned") | (F.col("_reach") >= F.col("_high"))).withColumn("label", F.min("_least").over(Window.partitionBy(*key, "_island")))
    out = rows.join(spans.select(*at, "label"), at, "left").select(*df.columns, F.coalesce("label", row_id).alias("label"))
    if rows.groupBy(row_id).count().where("count > 1").isEmpty():
        return out
    out = out.checkpoint()
    several = out.groupBy(row_id).agg(F.sort_array(F.collect_set("label")).alias("_all")).where(F.size("_all") > 1)
    links = union_find(several.select(F.get("_all", F.lit(0)).alias("a"), F.explode("_all").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("_to"))
    return out.join(links, "label", "left").select(*df.columns, F.coalesce("_to", "label").alias("label"))


def arcs(scores: DataFrame, key: Sequence[str], day: str, score: str, rise: float, peak: float, quiet: int) -> DataFrame:
    """Arcs of a key's daily score: one opens when the score rises by more than `rise` and none is open, is
    recognised at `peak`, and closes after `quiet` days below its opening score. A fold of a key's days as columns."""
    step = F.struct
    null_day = F.lit(None).cast("date")
    closed_type = "array<struct<opened:date,recognised:date,closed:date>>"
    days = F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(score).cast("double").alias("s"))))
    start = step(F.lit(None).cast("double").alias("last"), null_day.alias("opened"), F.lit(None).cast("double").alias("base"), null_day.alias("recognised"), F.lit(0).alias("calm"), F.array().cast(closed_type).alias("done"))

    def move(a, x):
        opens = a["opened"].isNull() & a["last"].isNotNull() & (x["s"] - a["last"] > rise)
        opened = F.when(opens, x["d"]).otherwise(a["opened"])
        base = F.when(opens, a["last"]).otherwise(a["base"])
        recognised = F.when(opened.isNotNull() & a["recognised"].isNull() & (x["s"] >= peak), x["d"]).otherwise(a["recognised"])
        calm = F.when(opened.isNotNull() & (x["s"] <= base), a["calm"] + 1).otherwise(F.lit(0))
        closes = calm >= quiet
        done = F.when(closes, F.concat(a["done"], F.array(step(opened.alias("opened"), recognised.alias("recognised"), x["d"].alias("closed"))))).otherwise(a["done"])
        return step(x["s"].alias("last"), F.when(~closes, opened).alias("opened"), F.when(~closes, base).alias("base"), F.when(~closes, recognised).alias("recognised"), F.when(closes, F.lit(0)).otherwise(calm).alias("calm"), done.alias("done"))

    folded = scores.groupBy(*key).agg(days.alias("_d")).select(*key, F.aggregate("_d", start, move).alias("a"))
    still = F.when(F.col("a.opened").isNotNull(), F.array(step(F.col("a.opened").alias("opened"), F.col("a.recognised").alias("recognised"), null_day.alias("closed")))).otherwise(F.array().cast(closed_type))
    return folded.select(*key, F.explode(F.concat("a.done", still)).alias("r")).select(*key, "r.opened", "r.recognised", "r.closed")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 5.0) -> DataFrame:
    """(point, polygon) for points inside a polygon by the even-odd rule, so rings inside are holes.

    points: point, x, y. polygons: polygon, rings (array of rings of (x, y)). Polygons are dealt to the grid cells of
    their box and points to their cell: an equi-join, then the rule as a column over the polygon's edges."""
    low = lambda a: F.floor(F.array_min(a) / cell)
    high = lambda a: F.floor(F.array_max(a) / cell)
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    cells = polygons.withColumn("_x", F.explode(F.sequence(low(xs), high(xs)))).withColumn("_y", F.explode(F.sequence(low(ys), high(ys))))
    at = points.withColumn("_x", F.floor(F.col("x") / cell)).withColumn("_y", F.floor(F.col("y") / cell))

    def crossings(ring):
        shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
        return F.size(F.filter(F.arrays_zip(ring.alias("a"), shifted.alias("b")), lambda e: ((e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))) & (F.col("x") < (e["b"]["x"] - e["a"]["x"]) * (F.col("y") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])))

    total = F.aggregate(F.transform("rings", crossings), F.lit(0), lambda s, c: s + c)
    return at.join(cells, ["_x", "_y"]).where(total % 2 == 1).select("point", "polygon")


#: The type of a polygon's rings.
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
