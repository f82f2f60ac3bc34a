"""Judging sensors: stuck runs in two passes, impossible seasons, frost guards, and station rollups that leave bad stations out.

A reading is flagged, never repaired. All operators take rows of one key (a station or an area), a day, and an id that
orders rows of one day, so that results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import doy_frost


@dataclass(frozen=True)
class Reading:
    """One sensor of a row: the column, its distance from what the area says (positive away from the centre), and where
    a value of it is impossible for the season. `corroborated` is what a lone impossible value needs besides."""

    name: str
    value: Column
    spread: Column
    impossible: Column
    corroborated: Column


@dataclass(frozen=True)
class Confirmation:
    """When a run of equal values proves itself: by a median spread above `spread`, by `long` days and a median spread above
    `long_spread`, or by a value that is impossible for the season. Shorter runs than `least` are none."""

    least: int = 5
    spread: float = 30.0
    long: int = 10
    long_spread: float = 15.0


def upper_median(values: Column) -> Column:
    """Of the values of a group the one at floor(n / 2) of their order, nulls left out."""
    kept = F.array_sort(F.collect_list(values))
    return F.get(kept, F.floor(F.size(kept) / 2).cast("int"))


def _tall(df: DataFrame, key: Sequence[str], day: str, tie: str, readings: Sequence[Reading]) -> DataFrame:
    """A row for each reading, with the number of the run of equal values on consecutive days that it belongs to."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("field"), r.value.cast("double").alias("value"), r.spread.cast("double").alias("spread"), F.coalesce(r.impossible, F.lit(False)).alias("impossible"), F.coalesce(r.corroborated, F.lit(False)).alias("corroborated")) for i, r in enumerate(readings)))
    rows = df.select(*key, day, tie, F.explode(each).alias("r")).select(*key, day, tie, "r.*")
    w = Window.partitionBy(*key, "field").orderBy(day, tie)
    same = (F.datediff(F.col(day), F.lag(day).over(w)) == 1) & (F.col("value") == F.lag("value").over(w))
    return rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def stuck_runs(tall: DataFrame, key: Sequence[str], day: str, proof: Confirmation = Confirmation(), era: Column | None = None) -> DataFrame:
    """Runs of `least` days and more, each confirmed or not. First pass: runs that prove themselves. Second pass: the
    values they prove broken, by key and field, confirm the other runs of the same value (with `era`, an expression over
    start_day and end_day, those of the same era), wherever the season hides them."""
    by = [*key, "field", "run"]
    runs = tall.where("value is not null").groupBy(*by).agg(
        F.first("value").alias("value"), F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("days"), upper_median(F.col("spread")).alias("median_spread"), F.max("impossible").alias("impossible")
    )
    runs = runs.where(F.col("days") >= proof.least)
    proven = (F.col("median_spread") > proof.spread) | ((F.col("days") >= proof.long) & (F.col("median_spread") > proof.long_spread)) | F.col("impossible")
    runs = runs.withColumn("by_itself", F.coalesce(proven, F.lit(False))).withColumn("era", F.lit(0) if era is None else era)
    known = runs.where("by_itself").select(*key, "field", "value", "era").distinct().withColumn("known", F.lit(True))
    return runs.join(known, [*key, "field", "value", "era"], "left").withColumn("confirmed", F.coalesce("known", F.lit(False))).drop("known", "era")


def sensor_scan(df: DataFrame, key: Sequence[str], day: str, tie: str, low: str, high: str, readings: Sequence[Reading], proof: Confirmation = Confirmation()) -> DataFrame:
    """Rows with a flag, the first that applies: inversion (low above high), then for each reading in turn stuck, then for
    each in turn seasonal. Stuck rows say the run's days, its median spread and whether it was proven by itself."""
    tall = _tall(df, key, day, tie, readings)
    runs = stuck_runs(tall, key, day, proof).where("confirmed").select(*key, "field", "run", "days", "median_spread", "by_itself")
    judged = tall.join(runs, [*key, "field", "run"], "left")
    n = len(readings)
    rank = F.when(F.col("days").isNotNull(), 1 + F.col("i")).when(F.col("impossible") & F.col("corroborated"), 1 + n + F.col("i"))
    name = F.when(F.col("days").isNotNull(), F.concat(F.col("field"), F.lit(" stuck"))).otherwise(F.concat(F.col("field"), F.lit(" seasonal")))
    found = judged.withColumn("rank", rank).where("rank is not null").select(*key, day, tie, F.struct("rank", name.alias("flag"), "value", "days", "median_spread", "by_itself").alias("f"))
    kind = found.schema["f"].dataType
    turned = df.where(F.col(low) > F.col(high)).select(*key, day, tie, F.struct(F.lit(0).alias("rank"), F.lit("inversion").alias("flag"), F.col(low).cast("double").alias("value"), F.lit(None), F.lit(None), F.lit(None)).cast(kind).alias("f"))
    return found.unionByName(turned).groupBy(*key, day, tie).agg(F.min("f").alias("f")).select(*key, day, tie, "f.flag", "f.value", "f.days", "f.median_spread", "f.by_itself")


def suspects(df: DataFrame, key: Sequence[str], day: str, tie: str, readings: Sequence[Reading], proof: Confirmation = Confirmation()) -> DataFrame:
    """What the scan reports and does not flag: runs that nothing confirms, and lone impossible values that are not
    corroborated and lie in no confirmed run (as a run of one day)."""
    tall = _tall(df, key, day, tie, readings)
    runs = stuck_runs(tall, key, day, proof)
    open_runs = runs.where("not confirmed").select(*key, "field", F.lit("run").alias("kind"), "value", "start_day", "end_day", "days", "median_spread")
    lone = tall.where("impossible and not corroborated").join(runs.where("confirmed").select(*key, "field", "run"), [*key, "field", "run"], "left_anti")
    return open_runs.unionByName(lone.select(*key, "field", F.lit("season").alias("kind"), "value", F.col(day).alias("start_day"), F.col(day).alias("end_day"), F.lit(1).cast("long").alias("days"), F.col("spread").alias("median_spread")))


@dataclass(frozen=True)
class FrostGuards:
    """What removes a frost (a minimum of `freeze` or less), the first of: it lies more than `spread` below the mean low; its exact
    value recurs on `stuck` frosts of the year or more, with a median spread above `stuck_spread`; no other day of `near` or less, that
    these two left, lies within `alone` days of it in its year. A year that loses more than `most_removed` of its frosts has no date."""

    freeze: float = 32.0
    near: float = 36.0
    spread: float = 38.0
    stuck: int = 20
    stuck_spread: float = 30.0
    alone: int = 10
    most_removed: float = 0.4


def guarded_frosts(df: DataFrame, key: Sequence[str], day: str, low: str, mean_low: str, guards: FrostGuards = FrostGuards()) -> DataFrame:
    """The cold days (`near` or less) with their year, whether they are frosts, and the guard that removes a frost."""
    by = [*key, "year"]
    cold = df.where(F.col(low) <= guards.near).select(*key, F.year(day).alias("year"), day, F.col(low).cast("double").alias("low"), (F.col(mean_low) - F.col(low)).cast("double").alias("spread"))
    cold = cold.withColumn("frost", F.col("low") <= guards.freeze).withColumn("far", F.coalesce(F.col("frost") & (F.col("spread") > guards.spread), F.lit(False)))
    values = cold.where("frost and not far").groupBy(*by, "low").agg(F.count("*").alias("n"), upper_median(F.col("spread")).alias("middle"))
    stuck = values.where((F.col("n") >= guards.stuck) & (F.col("middle") > guards.stuck_spread)).select(*by, "low", F.lit(True).alias("stuck"))
    rows = cold.join(stuck, [*by, "low"], "left")
    guard = F.when(F.col("far"), "spread").when(F.col("frost") & F.col("stuck"), "stuck")
    rows = rows.withColumn("guard", guard).drop("far", "stuck")
    # A day that these guards removed can't vouch for its neighbours, nor can a second row of the same day.
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    around = Window.partitionBy(*by).orderBy(number)
    stays = F.col("guard").isNull().cast("int")
    others = F.sum(stays).over(around.rangeBetween(-guards.alone, guards.alone)) - F.sum(stays).over(around.rangeBetween(0, 0))
    alone = F.col("frost") & F.col("guard").isNull() & (others == 0)
    return rows.withColumn("guard", F.when(alone, "alone").otherwise(F.col("guard")))


def frost_years(df: DataFrame, key: Sequence[str], day: str, low: str, mean_low: str, guards: FrostGuards = FrostGuards()) -> DataFrame:
    """Per key and covered year: frosts, how many each guard removed, last spring and first fall frost (before and from
    1 July) of those that stay, days between them, and whether the year counts. A year without a frost is there, with no dates."""
    found = guarded_frosts(df, key, day, low, mean_low, guards).where("frost")
    stays, doy = F.col("guard").isNull(), doy_frost(F.col(day))
    dates = found.groupBy(*key, "year").agg(
        F.count("*").alias("frosts"), *(F.count_if(F.col("guard") == g).alias(g) for g in ("spread", "stuck", "alone")),
        F.max(F.when(stays & (F.month(day) < 7), doy)).alias("last_spring"), F.min(F.when(stays & (F.month(day) >= 7), doy)).alias("first_fall"),
    )
    covered = df.where(F.col(low).isNotNull()).select(*key, F.year(day).alias("year")).distinct()
    out = covered.join(dates, [*key, "year"], "left").fillna(0, ["frosts", "spread", "stuck", "alone"])
    kept = F.col("spread") + F.col("stuck") + F.col("alone") <= guards.most_removed * F.col("frosts")
    return out.withColumns({"kept": kept, "season_days": F.col("first_fall") - F.col("last_spring")})


def with_area_mean(df: DataFrame, area: Sequence[str], day: str, low: str, high: str) -> DataFrame:
    """First pass of a rollup: every reading beside the area's preliminary means of its day, over all stations."""
    means = df.groupBy(*area, day).agg(F.avg(low).alias("area_low"), F.avg(high).alias("area_high"))
    return df.join(means, [*area, day])


def screened(df: DataFrame, area: Sequence[str], station: str, day: str, low: str, high: str, readings: Sequence[Reading], proof: Confirmation = Confirmation()) -> DataFrame:
    """Second pass: the rows with `low_out` and `high_out`, the reason a reading is left out (stuck, seasonal or inversion: a
    low above its own high loses both), null for one that counts. A value proven broken counts against its station's year."""
    key, tie = [*area, station], "_tie"
    rows = df.withColumn(tie, F.lit(0))
    tall = _tall(rows, key, day, tie, readings)
    runs = stuck_runs(tall, key, day, proof, F.year("start_day")).where("confirmed").select(*key, "field", "run", F.lit(True).alias("stuck"))
    judged = tall.join(runs, [*key, "field", "run"], "left")
    reason = F.when(F.col("stuck"), "stuck").when(F.col("impossible") & F.col("corroborated"), "seasonal")
    by_field = judged.groupBy(*key, day).agg(*(F.max(F.when(F.col("field") == f, reason)).alias(f"{f}_out") for f in (low, high)))
    out = df.join(by_field, [*key, day], "left")
    both = F.col(f"{low}_out").isNull() & F.col(f"{high}_out").isNull() & (F.col(low) > F.col(high))
    return out.withColumns({f"{c}_out": F.when(both, "inversion").otherwise(F.col(f"{c}_out")) for c in (low, high)})


def rollup(screened_rows: DataFrame, area: Sequence[str], station: str, day: str, low: str, high: str, amount: str | None = None) -> DataFrame:
    """Third pass, per area and day: mean low and high, lowest low and highest high with their stations (of equal ones the
    station that sorts first), largest `amount` with its station, stations that count (a low or a high left), readings left out
    by reason. A side without a reading is null, never 0; a day without any has no row."""
    good = {c: F.when(F.col(f"{c}_out").isNull(), F.col(c)) for c in (low, high)}
    there = good[low].isNotNull() | good[high].isNotNull()
    first = lambda v, sign: F.min(F.when(v.isNotNull(), F.struct((sign * v).alias("v"), F.col(station).alias("s"))))
    parts = [F.avg(good[low]).alias("mean_low"), F.avg(good[high]).alias("mean_high"), first(good[low], 1).alias("_lo"), first(good[high], -1).alias("_hi"), F.count_if(there).alias("stations")]
    if amount is not None:
        parts.append(first(F.when(there, F.col(amount)), -1).alias("_most"))
    for reason in ("stuck", "seasonal", "inversion"):
        parts.append((F.count_if(F.col(f"{low}_out") == reason) + F.count_if(F.col(f"{high}_out") == reason)).alias(reason))
    out = screened_rows.groupBy(*area, day).agg(*parts).where("stations > 0")
    most = [] if amount is None else [(-F.col("_most.v")).alias(f"most_{amount}"), F.col("_most.s").alias("most_station")]
    return out.select(*area, day, "mean_low", "mean_high", F.col("_lo.v").alias("low"), F.col("_lo.s").alias("low_station"), (-F.col("_hi.v")).alias("high"), F.col("_hi.s").alias("high_station"), *most, "stations", "stuck", "seasonal", "inversion")
