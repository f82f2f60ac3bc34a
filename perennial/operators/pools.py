"""Day-of-year pools: how deep a value lies in the tail of all years around its calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendars import doy_common
from ..functions.numbers import round_half_up
from .ranks import numbered
from .series import episodes


def with_offsets(df: DataFrame, day: str, half: int) -> DataFrame:
    """Each row once for each calendar day whose pool it belongs to: `pool_doy` within `half` days of its own."""
    shifts = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    return df.withColumn("_shift", shifts).withColumn("pool_doy", F.pmod(doy_common(F.col(day)) + F.col("_shift") - 1, F.lit(365)) + 1).drop("_shift")


def pool_ecdf(df: DataFrame, key: Sequence[str], day: str, value: str, half: int = 10) -> DataFrame:
    """The pools as distribution functions: per key, calendar day and distinct value how many lie strictly below.
    One aggregation by value and one running sum; scoring a day is then an equi-join, never a scan of its pool."""
    members = with_offsets(df.where(F.col(value).isNotNull()), day, half)
    counts = members.groupBy(*key, "pool_doy", F.col(value).alias("val")).agg(F.count("*").alias("c"))
    pool = Window.partitionBy(*key, "pool_doy")
    below = F.sum("c").over(pool.orderBy("val").rowsBetween(Window.unboundedPreceding, -1))
    years = members.groupBy(*key, "pool_doy").agg(F.countDistinct(F.year(day)).alias("years"))
    return counts.withColumn("below", F.coalesce(below, F.lit(0))).withColumn("n", F.sum("c").over(pool)).join(years, [*key, "pool_doy"]).drop("c")


def tail_columns(below: Column, n: Column, years: Column, direction: str = "two-sided", min_years: int = 10, cap: float = 0.6) -> dict[str, Column]:
    """pct, won and low_confidence: strictly-below shares, a tie of both tails goes to the low one, a thin pool is capped."""
    low, high = 1 - below / n, below / n
    pct, won = {"low": (low, F.lit("low")), "high": (high, F.lit("high"))}.get(direction, (F.greatest(low, high), F.when(low >= high, "low").otherwise("high")))
    thin = years < min_years
    return {"pct": round_half_up(F.when(thin, F.least(pct, F.lit(cap))).otherwise(pct), 3), "won": won, "low_confidence": thin}


def tail_depth(df: DataFrame, key: Sequence[str], day: str, value: str, direction: str = "two-sided", half: int = 10, min_years: int = 10) -> DataFrame:
    """Each row with the depth of its value in its own pool."""
    ecdf = pool_ecdf(df, key, day, value, half)
    rows = df.where(F.col(value).isNotNull()).withColumn("pool_doy", doy_common(F.col(day))).withColumn("val", F.col(value))
    joined = rows.join(ecdf, [*key, "pool_doy", "val"])
    return joined.withColumns(tail_columns(F.col("below"), F.col("n"), F.col("years"), direction, min_years)).drop("val", "below")


def pool_lut(df: DataFrame, key: Sequence[str], day: str, value: str, half: int = 10) -> DataFrame:
    """The pools with their values and strictly-below counts as arrays."""
    pairs = F.array_sort(F.collect_list(F.struct("val", "below")))
    out = pool_ecdf(df, key, day, value, half).groupBy(*key, "pool_doy").agg(pairs.alias("_p"), F.first("n").alias("n"), F.first("years").alias("years"))
    return out.select(*key, "pool_doy", F.col("_p.val").alias("vals"), F.col("_p.below").alias("below"), "n", "years")


def lut_byte(lut_vals: Column, lut_below: Column, n: Column, years: Column, value: Column, direction: str = "high", min_years: int = 10) -> Column:
    """The byte of a value against a pool's arrays: how many lie strictly below, by the first entry not less than it."""
    less = F.size(F.filter(lut_vals, lambda v: v < value))
    below = F.when(less < F.size(lut_vals), F.element_at(lut_below, less + 1)).otherwise(n)
    return F.floor(tail_columns(below, n, years, direction, min_years)["pct"] * 254 + 0.5).cast("int")


def invert_pct(lut_vals: Column, lut_below: Column, n: Column, pct: Column) -> Column:
    """The largest value with at most this share strictly below it."""
    return F.element_at(F.filter(F.arrays_zip(lut_vals.alias("v"), lut_below.alias("b")), lambda x: x["b"] <= pct * n), -1)["v"]


def _last_at_most(xs: Column, x: Column) -> Column:
    """Place (from 0) of the last entry of a sorted array that is at most x, 0 if none is: a search by halves, in a fixed
    number of steps that is enough for any array."""
    start = F.struct(F.lit(0).alias("lo"), (F.size(xs) - 1).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        low = F.get(xs, middle) <= x
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & low, middle).otherwise(s["lo"]).alias("lo"), F.when(go & ~low, middle - 1).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, half, lambda s: s["lo"])


def inverse(lut_vals: Column, lut_below: Column, n: Column, pct: Column, side: str = "high") -> Column:
    """The value at a depth of pct (0 to 1) on a side of the pool: between two values of the pool on a line by the number
    strictly below, the least value at 0 (of the high side), the greatest one beyond the last step; null for an empty pool."""
    p = F.least(F.greatest(pct, F.lit(0.0)), F.lit(1.0))
    target = (p if side == "high" else 1 - p) * n
    place = _last_at_most(lut_below, target)

    def at(k: Column) -> Column:
        v, b = F.get(lut_vals, k), F.get(lut_below, k)
        step = (target - b) / (F.get(lut_below, k + 1) - b)
        return F.when(k >= F.size(lut_vals) - 1, v).otherwise(v + step * (F.get(lut_vals, k + 1) - v))

    return F.when(F.size(lut_vals) > 0, F.when(target <= 0, F.get(lut_vals, F.lit(0))).otherwise(F.get(F.transform(F.array(place), at), F.lit(0))))


def depth_between(lut_vals: Column, lut_below: Column, n: Column, value: Column, side: str = "high") -> Column:
    """The depth of any value on the same lines: what inverse() turns around, up to the last step."""
    place = _last_at_most(lut_vals, value)

    def at(k: Column) -> Column:
        v, b = F.get(lut_vals, k), F.get(lut_below, k)
        inside = (value - v) / (F.get(lut_vals, k + 1) - v) * (F.get(lut_below, k + 1) - b)
        return F.when((k >= F.size(lut_vals) - 1) | (value <= v), b.cast("double")).otherwise(b + inside)

    share = F.get(F.transform(F.array(place), at), F.lit(0)) / n
    return F.when(F.size(lut_vals) > 0, share if side == "high" else 1 - share)


def band_census(df: DataFrame, key: Sequence[str], day: str, value: str, band: float, side: str = "low", gap: int = 7) -> DataFrame:
    """The ceil(band * n) most extreme members of each key's pool: threshold, ties at it, episodes, their years."""
    rows = df.where(F.col(value).isNotNull())
    ranked = numbered(rows, key, [value, day], "_r", "pool_n")
    take = F.ceil(F.lit(band) * F.col("pool_n"))
    inside = F.col("_r") <= take if side == "low" else F.col("_r") > F.col("pool_n") - take
    members = ranked.where(inside)
    edge = F.max(value) if side == "low" else F.min(value)
    facts = members.groupBy(*key).agg(edge.alias("threshold"), F.count("*").alias("matched_days"), F.first("pool_n").alias("pool_n"))
    ties = rows.join(facts.select(*key, "threshold"), list(key)).where(F.col(value) == F.col("threshold")).groupBy(*key).agg(F.count("*").alias("ties"))
    runs = episodes(members, key, day, gap).groupBy(*key).agg(F.count("*").alias("episodes"), F.countDistinct(F.year("start_day")).alias("years"), F.max("start_day").alias("last_occurrence"))
    return facts.join(ties, list(key)).join(runs, list(key))


def band_facts(dictionary: DataFrame, low: float, high: float, gap: int = 7, least_episodes: int = 3, least_years: int = 3) -> DataFrame:
    """Of a pool dictionary (days in order of value, as series.frequency_dictionary() bakes them) the slice between two ranks, from
    floor(low n) to before ceil(high n): matched days, episodes (at most `gap` days missing within one), the years they start in,
    the last start, episodes by decade, and a reason to say nothing. Work on a row's arrays: no pool is read again."""
    n = F.size("days")
    lo, hi = F.greatest(F.lit(0), F.floor(low * n)).cast("int"), F.least(n, F.ceil(high * n).cast("int"))
    rows = dictionary.withColumn("_band", F.array_sort(F.slice("days", lo + 1, F.greatest(F.lit(0), hi - lo))))
    fresh = F.filter("_band", lambda d, i: (i == 0) | (F.datediff(d, F.get("_band", i - 1)) > gap + 1))
    rows = rows.withColumn("_starts", fresh)
    years = F.array_distinct(F.transform("_starts", lambda d: F.year(d)))
    decade = lambda d: (F.floor(F.year(d) / 10) * 10).cast("int")
    decades = F.transform(F.array_distinct(F.transform("_starts", decade)), lambda x: F.struct(x.alias("decade"), F.size(F.filter("_starts", lambda d: decade(d) == x)).alias("episodes")))
    count, reach = F.size("_starts"), F.size(years)
    refusal = F.when(count == 0, "nothing on record").when(count < least_episodes, "too few episodes").when(reach < least_years, "too few years")
    return rows.withColumns({"matched_days": F.size("_band"), "episode_count": count, "episode_years": years, "last_start": F.get("_starts", count - 1), "decades": decades, "refusal": refusal}).drop("_band", "_starts")
