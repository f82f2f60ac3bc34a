"""Operators on daily series: gaps, runs, episodes, deltas, rolling windows and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def _by(key: Sequence[str], day: str) -> Window:
    return Window.partitionBy(*key).orderBy(day)


def gap_delta(df: DataFrame, key: Sequence[str], day: str, value: str, out: str = "delta") -> DataFrame:
    """Change from the day before; null unless the row before is exactly the day before."""
    w = _by(key, day)
    return df.withColumn(out, F.when(F.datediff(F.col(day), F.lag(day).over(w)) == 1, F.col(value) - F.lag(value).over(w)))


def rolling(df: DataFrame, key: Sequence[str], day: str, value: str, days: int, how: str = "sum", complete: bool = True, out: str = "rolled") -> DataFrame:
    """sum, avg, min or max over the calendar days d-days+1 .. d; with `complete` null unless each has a value."""
    w = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(-(days - 1), 0)
    rolled = getattr(F, how)(value).over(w)
    return df.withColumn(out, F.when(F.count(value).over(w) == days, rolled) if complete else rolled)


def trailing_z(df: DataFrame, key: Sequence[str], day: str, value: str, days: int = 21, least: int = 10, floor: float = 0.5, most: float = 8.0, out: str = "z") -> DataFrame:
    """Deviation from the calendar days before, today excluded: sample deviation with a floor, z clamped."""
    w = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(-(days - 1), -1)
    z = (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_samp(value).over(w), F.lit(floor))
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.greatest(F.least(z, F.lit(most)), F.lit(-most))))


def episodes(df: DataFrame, key: Sequence[str], day: str, gap: int = 0) -> DataFrame:
    """Runs of days with at most `gap` days missing between two of them: start, end and number of days."""
    days = df.select(*key, day).distinct()
    w = _by(key, day)
    new = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap + 1).cast("int"), F.lit(1))
    runs = days.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "_run").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("matched_days")).drop("_run")


def equal_runs(df: DataFrame, key: Sequence[str], day: str, value: str, least: int = 5) -> DataFrame:
    """Runs of consecutive days with one and the same value, of `least` days or more."""
    w = _by(key, day)
    same = (F.datediff(F.col(day), F.lag(day).over(w)) == 1) & (F.col(value) == F.lag(value).over(w))
    runs = df.where(F.col(value).isNotNull()).withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "_run").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("days"), F.first(value).alias(value))
    return out.where(F.col("days") >= least).drop("_run")


def sign_runs(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Of each row the length of the run of equal signs of change that ends there."""
    w = _by(key, order)
    df = df.withColumn("_sign", F.signum(F.col(value) - F.lag(value).over(w)))
    df = df.withColumn("_new", F.when(F.col("_sign") == F.lag("_sign").over(w), 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("run", F.when(F.col("_sign").isNotNull(), F.row_number().over(Window.partitionBy(*key, "_run").orderBy(order)))).withColumnRenamed("_sign", "direction").drop("_new", "_run")


def masked_mean(df: DataFrame, key: Sequence[str], day: str, value: str, usable: Column, days: int = 14, least: int = 10, out: str = "mean") -> DataFrame:
    """Mean of the usable values on the `days` days before, if there are `least` of them."""
    w = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(-days, -1)
    kept = F.when(usable, F.col(value))
    return df.withColumn(out, F.when(F.count(kept).over(w) >= least, F.avg(kept).over(w)))


def densify(df: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Every day from first to last; values between known ones on a line, `filled` says which."""
    span = df.groupBy(*key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(*key, F.explode(F.sequence("_a", "_b")).alias(day))
    full = days.join(df.select(*key, day, value), [*key, day], "left")
    w = _by(key, day)
    known = F.when(F.col(value).isNotNull(), F.struct(day_number(day).alias("d"), F.col(value).alias("v")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    full = full.withColumn("_p", prev).withColumn("_n", nxt)
    share = (day_number(day) - F.col("_p.d")) / (F.col("_n.d") - F.col("_p.d"))
    line = F.coalesce(F.col(value), F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share, F.col("_p.v"), F.col("_n.v"))
    return full.select(*key, day, line.alias(value), F.col(value).isNull().alias("filled"))


def latest_z(df: DataFrame, key: Sequence[str], order: Sequence[Column], value: str, least: int = 4, threshold: float = 2.0) -> DataFrame:
    """The newest row against the rest of its group: population deviation, at least three others, |z| >= threshold."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = df.where(F.col(value).isNotNull()).withColumn("_k", k)
    rest = F.when(F.col("_k") > 1, F.col(value))
    out = rows.groupBy(*key).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("newest"), F.avg(rest).alias("mean"), F.stddev_pop(rest).alias("sd"), F.count(value).alias("n"))
    out = out.where((F.col("n") >= max(least, 4)) & (F.col("sd") > 0)).withColumn("z", (F.col("newest") - F.col("mean")) / F.col("sd"))
    return out.where(F.abs("z") >= threshold).withColumn("severity", F.when(F.abs("z") >= 3, "high").when(F.abs("z") >= 2.5, "medium").otherwise("low"))


def front_signal(df: DataFrame, key: Sequence[str], day: str, value: str, days: int = 4, drop: float = 8.0, step: float = 3.0) -> DataFrame:
    """Per day the signal of the run of readings on the calendar days d-days+1 .. d: a front passes if the last reading is
    `drop` or more below the run's peak; else cooling or warming by `step` from the first to the last; else steady. A
    run of fewer than two readings is unknown. Days without a reading have no row."""
    w = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(-(days - 1), 0)
    v = F.col(value)
    rows = df.where(v.isNotNull()).withColumns({"readings": F.count(value).over(w), "change": v - F.first(value).over(w), "drop_from_peak": F.max(value).over(w) - v})
    signal = F.when(F.col("readings") < 2, "unknown").when(F.col("drop_from_peak") >= drop, "front").when(F.col("change") <= -step, "cooling").when(F.col("change") >= step, "warming").otherwise("steady")
    return rows.withColumn("signal", signal)


def motion(df: DataFrame, key: Sequence[str], day: str, value: str, usable: Column, days: int = 14, least: int = 10, out: str = "motion") -> DataFrame:
    """Mean over the `days` days before of how far each usable day lies above its own trailing mean. Both windows need
    `least` usable days; in the outer one only days with a trailing mean of their own count."""
    inner = masked_mean(df, key, day, value, usable, days, least, "_mean")
    return masked_mean(inner.withColumn("_off", F.col(value) - F.col("_mean")), key, day, "_off", usable & F.col("_mean").isNotNull(), days, least, out).drop("_mean", "_off")


def frequency_dictionary(pools: DataFrame, key: Sequence[str], day: str, value: str, gap: int = 0) -> DataFrame:
    """Per pool its days in order of value, its years, the number of occasions (runs of days with at most `gap` missing
    between two) and the first day of the latest one. A pool holds the days of one time of year, a few a year."""
    w = _by(key, day)
    new = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap + 1).cast("int"), F.lit(1))
    rows = pools.where(F.col(value).isNotNull()).withColumn("_new", new)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(day).alias("d")))), lambda x: x["d"])
    return rows.groupBy(*key).agg(
        ranked.alias("days"), F.array_sort(F.collect_set(F.year(day))).alias("years"), F.sum("_new").alias("episodes"), F.max(F.when(F.col("_new") == 1, F.col(day))).alias("last_occurrence"),
    )


def voted_mean(df: DataFrame, key: Sequence[str], mean: str, low: str, high: str) -> DataFrame:
    """Mean over the points of an area: points without a mean do not vote, nor do their extremes; `points` says how many
    voted, `spread` how far apart their means lie (null for fewer than two)."""
    votes = F.col(mean).isNotNull()
    out = df.groupBy(*key).agg(F.avg(mean).alias("mean"), F.avg(F.when(votes, F.col(low))).alias("low"), F.avg(F.when(votes, F.col(high))).alias("high"), F.count(mean).alias("points"), (F.max(mean) - F.min(mean)).alias("_apart"))
    return out.withColumn("spread", F.when(F.col("points") > 1, F.col("_apart"))).drop("_apart")


def step_or_trend(df: DataFrame, key: Sequence[str], day: str, value: str, days: int = 5, trend: float = 100.0, step: float = 150.0) -> DataFrame:
    """Per day with a reading, of the readings on the `days` calendar days up to it, if there are three or more: the peak, how many
    rises in a row lead into the last one, and the arm: step if the last one is `step` or more, trend if two rises follow each other
    and it is `trend` or more. Days without an arm have no row."""
    w = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(-(days - 1), 0)
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.collect_list(value).over(w)).where(F.size("_v") >= 3)
    n = F.size("_v")
    rises = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("_v", i) > F.get("_v", i - 1))
    rows = rows.withColumn("_r", rises)
    two = F.exists(F.sequence(F.lit(1), F.size("_r")), lambda i: F.get("_r", i - 1) & F.coalesce(F.get("_r", i), F.lit(False)))
    last_fall = F.array_max(F.transform("_r", lambda r, i: F.when(~r, i + 1).otherwise(0)))
    arm = F.when(F.col(value) >= step, "step").when(two & (F.col(value) >= trend), "trend")
    return rows.select(*key, day, value, F.array_max("_v").alias("peak"), (F.size("_r") - last_fall).alias("run"), arm.alias("arm")).where("arm is not null")
