"""The dossier of a place and day: what is unusual about it, what was like it, what followed then, and the base rate beside it.

One pool for all of it: the day meets the values of other years around its place in the year once, every member brings what followed
it, and all parts are aggregates over that one join. What was on file on the closest days joins afterwards, for these days only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import front_signal
from .studies import MOON_DAYS, aftermath, precedent_pool, temperature_alike, tide_alike


def dossiers(df: DataFrame, on_file: DataFrame, key: Sequence[str], day: str, value: str, tide: str, moon_distance: Column, closest: int = 3, bar: float = 5.0, least: int = 3, least_years: int = 5, least_tides: int = 60) -> DataFrame:
    """A row for each day of a place with a pool (see studies.precedent_pool):

    z: deviation from the other years' values of the same calendar day, sample deviation, null for fewer than `least_years`; signal: the
    front signal of the run that ends here; alike: the `closest` days of the pool by value, each with what followed and what was on
    file; mode and lined_up: as studies.line_ups(); control: of all same calendar days, and of the lined-up days, how many with `least`
    recorded days after them cooled by `bar`. on_file: key, day, type. moon_distance: between `p` and `day`."""
    by = [*key, "day"]
    pool = precedent_pool(df, key, day, value, least_years=least_years, carry=[tide])
    after = aftermath(df, key, day, value, bar=bar, least=least).select(*key, F.col(day).alias("p"), "recorded", "verb", F.get("drops", F.lit(6)).alias("_drop"))
    rows = pool.join(after, [*key, "p"], "left")
    same, warm, moon = F.col("off") == 0, temperature_alike(F.col("anomaly"), F.col("today")), moon_distance <= MOON_DAYS
    tides = F.coalesce(tide_alike(F.col(f"p_{tide}"), F.col(tide)), F.lit(False))
    told = F.col("recorded") >= least
    cooled = F.coalesce(F.col("_drop") >= bar, F.lit(False))
    of = lambda which, name: (F.count_if(which & told).alias(f"{name}_n"), F.count_if(which & told & cooled).alias(f"{name}_cooled"))
    found = rows.groupBy(*by).agg(
        F.first("v0").alias("value"), F.first("today").alias("anomaly"), F.count_if(same).alias("years"), F.avg(F.when(same, F.col("v"))).alias("_mean"), F.stddev_samp(F.when(same, F.col("v"))).alias("_sd"),
        F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("v") - F.col("v0")).alias("away"), F.col("p").alias("date"), F.col("v").alias("value"), "verb"))), 1, closest).alias("_alike"),
        F.count(f"p_{tide}").alias("_tides"), F.first(tide).alias("_tide"), F.count_if(warm & moon).alias("_two"), F.count_if(warm & moon & tides).alias("_three"), *of(same, "all"), *of(warm & moon, "_two"), *of(warm & moon & tides, "_three"),
    )
    use = F.col("_tide").isNotNull() & (F.col("_tides") >= least_tides)
    choose = lambda name: F.when(use, F.col(f"_three{name}")).otherwise(F.col(f"_two{name}"))
    z = F.when((F.col("years") >= least_years) & (F.col("_sd") > 0), (F.col("value") - F.col("_mean")) / F.col("_sd"))
    found = found.withColumns({"z": z, "mode": F.when(use, "moon_tide_temp").otherwise("moon_temp"), "lined_up": choose(""), "matched_n": choose("_n"), "matched_cooled": choose("_cooled")})
    # On file: only the dates that a dossier names are looked up.
    named = found.select(*by, F.posexplode("_alike").alias("_k", "_a"))
    types = on_file.groupBy(*key, F.col(day).alias("_date")).agg(F.array_sort(F.collect_set("type")).alias("on_file"))
    named = named.withColumn("_date", F.col("_a.date")).join(types, [*key, "_date"], "left")
    entry = F.struct(F.col("_k"), F.col("_a.date").alias("date"), F.col("_a.value").alias("value"), F.col("_a.away").alias("away"), F.col("_a.verb").alias("verb"), F.coalesce("on_file", F.array().cast("array<string>")).alias("on_file"))
    alike = named.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("_k")).alias("alike"))
    signal = front_signal(df, key, day, value).select(*key, F.col(day).alias("day"), "signal", "drop_from_peak")
    out = found.join(signal, by, "left").join(alike, by, "left")
    return out.select(*by, "value", "anomaly", "years", "z", "signal", "drop_from_peak", "alike", "mode", "lined_up", "all_n", "all_cooled", "matched_n", "matched_cooled")
