"""Studies with their controls: paired precedents, events against a placebo, rotations of the calendar, and chains of gates.

Every comparison is built from equi-joins on calendar keys and aggregates; what one day is compared with never leaves its
key and time of year, so that work grows with the days times the years on record, and nothing is compared with everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import day_number

# --- distributions as columns ---

#: Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """For x of 0.5 and more."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + k)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's rule, a fixed number of steps."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def one(s: Column, term: Column) -> Column:
        d, c = 1 / safe(1 + term * s["d"]), safe(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # The state after the even term is bound once, by a one-element array.
        return F.get(F.transform(F.array(one(s, even)), lambda t: one(t, odd)), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution with df degrees of freedom, which need be no whole number: the incomplete beta
    function, of the two sides the one whose fraction converges."""
    a, b, x, rest = df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)
    turned = x >= (a + 1) / (a + b + 2)
    side = F.struct(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), F.when(turned, rest).otherwise(x).alias("x"), turned.alias("turned"))

    def share(s: Column) -> Column:
        front = F.exp(log_gamma(s["a"] + s["b"]) - log_gamma(s["a"] + 1) - log_gamma(s["b"]) + s["a"] * F.log(s["x"]) + s["b"] * F.log1p(-s["x"]))
        part = front * _beta_fraction(s["a"], s["b"], s["x"])
        return F.when(s["turned"], 1 - part).otherwise(part)

    # The side is worked out once, by an array of one element.
    return F.when(t == 0, 1.0).otherwise(F.get(F.transform(F.array(side), share), F.lit(0)))


def normal_upper(z: Column) -> Column:
    """P(Z >= z): the rational approximation for the error function up to 6, the first terms of its tail beyond."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    far = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / F.abs(z) * (1 - 1 / (z * z))
    upper = F.when(F.abs(z) > 6, far).otherwise(0.5 * (1 - erf))
    return F.when(z < 0, 1 - upper).otherwise(upper)


def mcnemar(b: Column, c: Column) -> Column:
    """One-sided p of b against c discordant pairs by the normal approximation; 1 without any."""
    return F.when(b + c > 0, normal_upper((b - c) / F.sqrt(b + c))).otherwise(1.0)


# --- paired precedents ---


def aftermath(df: DataFrame, key: Sequence[str], day: str, value: str, days: int = 7, bar: float = 5.0, least: int = 3) -> DataFrame:
    """Per day with a value: what followed on the next `days` calendar days. `verb` is cooled (largest fall `bar` or more and no
    smaller than the largest rise), warmed, held, or null with fewer than `least` recorded days; `span` the days to the
    first of the lowest (cooled) or highest (warmed) ones. `drops` and `rises` hold the largest fall and rise up to each day, `holes`
    the days without a value."""
    rows = df.where(F.col(value).isNotNull())
    near = Window.partitionBy(*key).orderBy(day_number(day)).rangeBetween(1, days)
    after = F.collect_list(F.struct(day_number(day).alias("d"), F.col(value).alias("v"))).over(near)
    rows = rows.select(*key, day, F.col(value).alias("_v"), F.transform(after, lambda a: F.struct((a["d"] - day_number(day)).alias("k"), (a["v"] - F.col(value)).alias("move"))).alias("_after"))
    moves = F.col("_after")
    low, high = F.array_min(F.transform(moves, lambda a: F.struct(a["move"], a["k"]))), F.array_min(F.transform(moves, lambda a: F.struct((-a["move"]).alias("move"), a["k"])))
    rows = rows.withColumns({"_low": low, "_high": high, "recorded": F.size(moves)})
    fall, rise = -F.col("_low.move"), -F.col("_high.move")
    verb = F.when(F.col("recorded") < least, None).when((fall >= bar) & (fall >= rise), "cooled").when(rise >= bar, "warmed").otherwise("held")
    rows = rows.withColumn("verb", verb).withColumn("span", F.when(F.col("verb") == "cooled", F.col("_low.k")).when(F.col("verb") == "warmed", F.col("_high.k")))
    upto = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.array_max(F.transform(F.filter(moves, lambda a: a["k"] <= k), lambda a: sign * a["move"])))
    holes = F.array_except(F.sequence(F.lit(1), F.lit(days)), F.transform(moves, lambda a: a["k"]))
    return rows.select(*key, day, "recorded", "verb", "span", upto(-1).alias("drops"), upto(1).alias("rises"), holes.alias("holes"))


def graded(verb: Column, span: Column, drops: Column, rises: Column, holes: Column, days: int = 7, bar: float = 5.0) -> Column:
    """1 if the claim (verb, span) came true in an aftermath, 0 if not, null if holes leave it open. A move within the span
    stands whatever is missing; "held" is broken by any move of `bar` in `days` days, and true only without holes."""
    reached = lambda xs: F.coalesce(F.element_at(xs, span) >= bar, F.lit(False))
    open_ = F.exists(holes, lambda h: h <= span)
    moved = F.coalesce(F.element_at(drops, F.lit(days)) >= bar, F.lit(False)) | F.coalesce(F.element_at(rises, F.lit(days)) >= bar, F.lit(False))
    claim = lambda xs: F.when(reached(xs), 1).when(~open_, 0)
    return F.when(verb == "cooled", claim(drops)).when(verb == "warmed", claim(rises)).when(verb == "held", F.when(moved, 0).when(F.size(holes) == 0, 1))


def anchored(df: DataFrame, key: Sequence[str], day: str, value: str, window: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Each value once for every calendar day that it lies within `window` days of: `md` (month and day) and `off`. Columns of `carry`
    go with it as p_<name>."""
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(day).alias("p"), F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("off"), *(F.col(c).alias(f"p_{c}") for c in carry))
    return rows.withColumn("md", F.date_format(F.expr("date_sub(p, off)"), "MM-dd")).withColumn("year", F.year("p"))


def own_year_out(anchors: DataFrame, key: Sequence[str], least: int = 5) -> DataFrame:
    """(key, md, year, means): for each year the mean of each offset over all other years, as a map from offset to mean; offsets
    with fewer than `least` values are missing. The years are those that any anchor of the calendar day has."""
    by = [*key, "md"]
    total = anchors.groupBy(*by, "off").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    own = anchors.groupBy(*by, "off", "year").agg(F.sum("v").alias("own"), F.count("*").alias("n"))
    years = anchors.select(*by, "year").distinct()
    rows = years.join(total, by).join(own, [*by, "off", "year"], "left")
    left = F.col("c") - F.coalesce("n", F.lit(0))
    mean = F.when(left >= least, (F.col("s") - F.coalesce("own", F.lit(0.0))) / left)
    pairs = rows.withColumn("mean", mean).where("mean is not null").groupBy(*by, "year").agg(F.map_from_entries(F.collect_list(F.struct("off", "mean"))).alias("means"))
    return pairs


#: Fixed values of the line-up: near-normal and tolerated anomalies, an elevated tide, days of the moon's age.
NEAR, TOLERANCE, ELEVATED, MOON_DAYS = 2.0, 5.0, 0.5, 2.0


def temperature_alike(anomaly: Column, today: Column) -> Column:
    """Both near normal, or of one sign and no further apart than tolerated."""
    return F.when(F.abs(today) < NEAR, F.abs(anomaly) < NEAR).otherwise((F.signum(anomaly) == F.signum(today)) & (F.abs(anomaly - today) <= TOLERANCE))


def tide_alike(residual: Column, today: Column) -> Column:
    """Both not elevated, or both elevated to one side."""
    return F.when(F.abs(today) < ELEVATED, F.abs(residual) < ELEVATED).otherwise((F.signum(residual) == F.signum(today)) & (F.abs(residual) >= ELEVATED))


def precedent_pool(df: DataFrame, key: Sequence[str], day: str, value: str, window: int = 3, guard: int = 10, least_years: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of a day and each member of its pool: values of other years within `window` days of its place in the year and more than
    `guard` days away, with both values `v0` and `v`. `today` and `anomaly` are how far the day and the member `p` lie above the mean of their offset over the years
    other than the day's; a day whose own offset has fewer than `least_years` such years has no pool. Columns of `carry` are there
    for the day under their names and for the member as p_<name>."""
    anchors = anchored(df, key, day, value, window, carry)
    means = own_year_out(anchors, key, least_years)
    index = df.where(F.col(value).isNotNull()).select(*key, F.col(day).alias("day"), F.col(value).cast("double").alias("v0"), F.date_format(day, "MM-dd").alias("md"), F.year(day).alias("year"), *carry)
    index = index.join(means, [*key, "md", "year"]).withColumn("today", F.col("v0") - F.try_element_at("means", F.lit(0))).where("today is not null")
    pool = index.join(anchors.withColumnRenamed("year", "p_year"), [*key, "md"])
    pool = pool.where((F.col("p_year") != F.col("year")) & (F.abs(F.datediff("p", "day")) > guard))
    return pool.withColumn("anomaly", F.col("v") - F.try_element_at("means", F.col("off"))).where("anomaly is not null").drop("means", "md", "year")


def line_ups(df: DataFrame, key: Sequence[str], day: str, value: str, tide: str, moon_distance: Column, least_tides: int = 60, **pool) -> DataFrame:
    """Per day with a pool: its members, those alike in temperature, those alike in the moon's age besides, and those that line up: alike
    in the tide besides where the day and `least_tides` members have one (mode moon_tide_temp), else in temperature and moon
    (moon_temp). moon_distance: days between the ages of `p` and `day`."""
    pairs = precedent_pool(df, key, day, value, carry=[tide], **pool)
    warm, moon = temperature_alike(F.col("anomaly"), F.col("today")), moon_distance <= MOON_DAYS
    tides = F.coalesce(tide_alike(F.col(f"p_{tide}"), F.col(tide)), F.lit(False))
    out = pairs.groupBy(*key, "day").agg(
        F.count("*").alias("pool"), F.count(f"p_{tide}").alias("tides"), F.first(tide).alias("_today"), F.count_if(warm).alias("alike"), F.count_if(warm & moon).alias("with_moon"), F.count_if(warm & moon & tides).alias("_all"), F.max(F.when(warm & moon & tides, F.col("p"))).alias("_last_all"), F.max(F.when(warm & moon, F.col("p"))).alias("_last"),
    )
    use = F.col("_today").isNotNull() & (F.col("tides") >= least_tides)
    out = out.withColumns({"mode": F.when(use, "moon_tide_temp").otherwise("moon_temp"), "lined_up": F.when(use, F.col("_all")).otherwise(F.col("with_moon")), "last_day": F.when(use, F.col("_last_all")).otherwise(F.col("_last"))})
    return out.drop("_today", "_all", "_last_all", "_last")


def paired_precedents(df: DataFrame, key: Sequence[str], day: str, value: str, pooled: Column, treated: Column, window: int = 3, guard: int = 10, least_years: int = 5, days: int = 7, bar: float = 5.0, carry: Sequence[str] = (), shifts: Sequence[int] = ()) -> DataFrame:
    """For each day with a value two arms over one pool, each arm's most recent precedent, and how its claim came out.

    The pool is that of precedent_pool(), as far as `pooled` holds; `treated` deals it to the arms: expressions over its columns. A precedent
    claims what followed it, and the claim is graded by what followed the day. Rows: key, day, `with_day`, `without_day`,
    `with_verb`, `without_verb`, `with_hit`, `without_hit`; null where an arm is empty, claims nothing or can't be graded. With `shifts` all
    of it once for each of them, as column `k`, which `treated` may use."""
    pool = precedent_pool(df, key, day, value, window, guard, least_years, carry).where(pooled)
    again = ["k"] if shifts else []
    if shifts:
        pool = pool.withColumn("k", F.explode(F.array(*(F.lit(k) for k in shifts))))
    arms = pool.groupBy(*key, "day", *again).agg(F.max(F.when(treated, F.col("p"))).alias("with_day"), F.max(F.when(~F.coalesce(treated, F.lit(False)), F.col("p"))).alias("without_day"))
    after = aftermath(df, key, day, value, days, bar).withColumnRenamed(day, "day")
    out = arms
    for arm in ("with", "without"):
        claim = after.select(*key, F.col("day").alias(f"{arm}_day"), F.col("verb").alias(f"{arm}_verb"), F.col("span").alias(f"{arm}_span"))
        out = out.join(claim, [*key, f"{arm}_day"], "left")
    out = out.join(after.select(*key, "day", "drops", "rises", "holes"), [*key, "day"], "left")
    for arm in ("with", "without"):
        out = out.withColumn(f"{arm}_hit", graded(F.col(f"{arm}_verb"), F.col(f"{arm}_span"), F.col("drops"), F.col("rises"), F.col("holes"), days, bar))
    return out.select(*key, "day", *again, "with_day", "without_day", "with_verb", "without_verb", "with_hit", "without_hit")


def paired_difference(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The funnel of paired_precedents() and its statistics: days, days with both arms, both claiming, graded pairs, hits of each arm, mean
    difference, discordant pairs and McNemar's p."""
    both, claims = F.col("with_day").isNotNull() & F.col("without_day").isNotNull(), F.col("with_verb").isNotNull() & F.col("without_verb").isNotNull()
    pair = F.col("with_hit").isNotNull() & F.col("without_hit").isNotNull()
    more, less = F.count_if(F.col("with_hit") > F.col("without_hit")), F.count_if(F.col("with_hit") < F.col("without_hit"))
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("days"), F.count_if(both).alias("both_arms"), F.count_if(both & claims).alias("claims"), F.count_if(pair).alias("paired"),
        F.coalesce(F.sum(F.when(pair, F.col("with_hit"))), F.lit(0)).alias("with_hits"), F.coalesce(F.sum(F.when(pair, F.col("without_hit"))), F.lit(0)).alias("without_hits"), more.alias("more"), less.alias("less"),
    )
    return out.withColumns({"delta": F.when(F.col("paired") > 0, (F.col("more") - F.col("less")) / F.col("paired")), "p": mcnemar(F.col("more"), F.col("less"))})


# --- events against a placebo ---


def placebo_study(responses: DataFrame, events: DataFrame, partners: DataFrame, key: str, day: str, response: str, lags: Sequence[int] = (1, 2, 3), guard: int = 3) -> DataFrame:
    """(key, arm, event day, lag, value): the response of the event's own key (matched) and of its partner (placebo) on the same
    dates, so that the season is held constant. Events whose partner had one of its own within `guard` days have no placebo
    (`contaminated` rows say so, without a value)."""
    ev = events.select(F.col(key).alias("key"), F.col(day).alias("event")).distinct()
    near = ev.select(F.col("key").alias("partner"), F.explode(F.sequence(F.date_sub("event", guard), F.date_add("event", guard))).alias("event")).distinct().withColumn("hit", F.lit(True))
    with_partner = ev.join(partners.select(F.col(key).alias("key"), "partner"), "key").join(near, ["partner", "event"], "left")
    matched = ev.select("key", F.lit("matched").alias("arm"), "event", F.col("key").alias("read"))
    placebo = with_partner.select("key", F.when(F.col("hit"), "contaminated").otherwise("placebo").alias("arm"), "event", F.when(F.col("hit").isNull(), F.col("partner")).alias("read"))
    asked = matched.unionByName(placebo).withColumn("lag", F.explode(F.array(*(F.lit(x) for x in lags)))).withColumn("on", F.expr("date_add(event, lag)"))
    values = responses.where(F.col(response).isNotNull()).select(F.col(key).alias("read"), F.col(day).alias("on"), F.col(response).cast("double").alias("value"))
    return asked.join(values, ["read", "on"], "left").where("value is not null or arm = 'contaminated'").select("key", "arm", "event", "lag", "value")


def placebo_tests(study: DataFrame, by: Sequence[str] = ("lag",)) -> DataFrame:
    """Per group: events, mean and one-sample t of both arms with their p, Welch's t of matched against placebo with its degrees of
    freedom and p, and the contaminated events. Statistics of fewer than two values, or without spread, are null."""
    arm = lambda a: F.when(F.col("arm") == a, F.col("value"))
    out = study.groupBy(*by).agg(*(f(arm(a)).alias(f"{a}_{n}") for a in ("matched", "placebo") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))), F.count_if(F.col("arm") == "contaminated").alias("contaminated"))
    for a in ("matched", "placebo"):
        se = F.sqrt(F.col(f"{a}_var") / F.col(f"{a}_n"))
        out = out.withColumn(f"{a}_t", F.when((F.col(f"{a}_n") > 1) & (se > 0), F.col(f"{a}_mean") / se))
        out = out.withColumn(f"{a}_p", student_two_sided(F.col(f"{a}_t"), F.col(f"{a}_n") - 1.0))
    m, p = F.col("matched_var") / F.col("matched_n"), F.col("placebo_var") / F.col("placebo_n")
    ok = (F.col("matched_n") > 1) & (F.col("placebo_n") > 1) & (m + p > 0)
    out = out.withColumn("welch_t", F.when(ok, (F.col("matched_mean") - F.col("placebo_mean")) / F.sqrt(m + p)))
    out = out.withColumn("welch_df", F.when(ok, (m + p) * (m + p) / (m * m / (F.col("matched_n") - 1) + p * p / (F.col("placebo_n") - 1))))
    return out.withColumn("welch_p", student_two_sided(F.col("welch_t"), F.col("welch_df")))


# --- rotations and gates ---


def turned_day(day: Column, k: Column, first_year: int, last_year: int) -> Column:
    """The day that lies k years before, around the circle of years first_year .. last_year; 29 February becomes the 28th where there is none."""
    year = first_year + F.pmod(F.year(day) - first_year - k, F.lit(last_year - first_year + 1))
    month_end = F.dayofmonth(F.last_day(F.make_date(year, F.month(day), F.lit(1))))
    return F.make_date(year, F.month(day), F.least(F.dayofmonth(day), month_end))


def certified(differences: DataFrame, by: Sequence[str], delta: str = "delta", floor: float = 0.02) -> DataFrame:
    """Per group, from its differences observed (k = 0) and under rotations (k > 0): the largest rotated one, whether the observed one exceeds
    all of them and is `floor` or more (certified), and p = (1 + rotations that reach it) / (1 + rotations). A rotation without a
    difference outranks nothing; without an observed one p is 1."""
    seen, turned = F.max(F.when(F.col("k") == 0, F.col(delta))), F.col("k") > 0
    out = differences.groupBy(*by).agg(seen.alias("observed"), F.max(F.when(turned, F.col(delta))).alias("largest"), F.count_if(turned).alias("rotations"), F.sort_array(F.collect_list(F.when(turned, F.col(delta)))).alias("_all"))  # a stated number
    reach = F.size(F.filter("_all", lambda x: x >= F.col("observed")))
    beats = F.col("observed").isNotNull() & (F.col("largest").isNull() | (F.col("observed") > F.col("largest")))
    met = F.coalesce(F.col("observed") >= floor, F.lit(False))
    p = F.when(F.col("observed").isNull(), 1.0).otherwise((1 + reach) / (1 + F.col("rotations")))
    return out.withColumns({"beats_all": beats, "floor_met": met, "certified": beats & met, "p": p}).drop("_all")


def rotations(df: DataFrame, key: Sequence[str], day: str, first_year: int, last_year: int, shifts: Sequence[int]) -> DataFrame:
    """The series once for each shift `k` (0 leaves it as it is): each day of first_year .. last_year reads the day that lies k years
    before it, around the circle of years; 29 February reads the 28th where there is none. Days that read nothing have no row."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date"))).alias("_to"))
    days = days.withColumn("k", F.explode(F.array(*(F.lit(k) for k in shifts))))
    source = turned_day(F.col("_to"), F.col("k"), first_year, last_year)
    return days.withColumn("_from", source).join(df.withColumnRenamed(day, "_from"), "_from").withColumnRenamed("_to", day).drop("_from")


def onset_windows(breadth: DataFrame, day: str, value: str, usable: Column, days: int = 14, least: int = 10) -> DataFrame:
    """(k, day, w): mean of the usable values of the `days` days before, of every calendar day that has `least` of them."""
    near = Window.partitionBy("k").orderBy(day_number(day)).rangeBetween(-days, -1)
    kept = F.when(usable, F.col(value))
    rows = breadth.withColumns({"_n": F.count(kept).over(near), "w": F.avg(kept).over(near)})
    return rows.where(F.col("_n") >= least).select("k", day, "w")


def epoch_controls(anchors: DataFrame, windows: DataFrame, barred: DataFrame, first_year: int, last_year: int, half: int = 15, most: int = 8, seed: str = "controls") -> DataFrame:
    """(k, id, control, w): for each anchor (id, day) at most `most` control days within `half` days of its place in the year, in any
    year, that are not barred and have a window; nearest years first, then by a hash of seed, anchor and day."""
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    base = F.make_date("y", F.month("day"), F.least(F.dayofmonth("day"), F.dayofmonth(F.last_day(F.make_date(F.col("y"), F.month("day"), F.lit(1))))))
    # A calendar day that a year doesn't have anchors nothing there.
    near = anchors.withColumn("y", years).withColumn("base", base).where(F.dayofmonth("base") == F.dayofmonth("day"))
    near = near.select("id", "day", F.explode(F.sequence(F.date_sub("base", half), F.date_add("base", half))).alias("control")).where(F.year("control").between(first_year, last_year)).distinct()
    free = near.join(barred.select(F.col("day").alias("control")).distinct(), "control", "left_anti")
    found = free.join(windows.withColumnRenamed("day", "control"), "control")
    order = Window.partitionBy("k", "id").orderBy(F.abs(F.year("control") - F.year("day")), F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("control").cast("string"))), "control")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("k", "id", "control", "w")


def onset_contrast(anchors: DataFrame, windows: DataFrame, controls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per k and anchor: its window, median and upper quartile of its controls; per k: the mean windows and their difference).
    Anchors without a window are dropped; controls pool over all anchors that have one."""
    own = anchors.join(windows.withColumnRenamed("w", "own"), "day").select("k", "id", "own")
    theirs = controls.groupBy("k", "id").agg(F.percentile("w", F.lit(0.5)).alias("middle"), F.percentile("w", F.lit(0.75)).alias("upper"), F.count("*").alias("controls"), F.sum("w").alias("_s"))
    each = own.join(theirs, ["k", "id"], "left").fillna(0, ["controls"])
    total = each.groupBy("k").agg(F.count("*").alias("anchors"), F.sum("controls").alias("controls"), F.avg("own").alias("mean_own"), (F.sum("_s") / F.sum("controls")).alias("mean_controls"))
    return each.drop("_s"), total.withColumn("delta", F.col("mean_own") - F.col("mean_controls"))


def decile_lift(windows: DataFrame, followed: DataFrame, barred: DataFrame) -> DataFrame:
    """Per k over the days that are not barred: base rate of `followed`, rate in the top tenth by window within the month, and lift.
    A month's days over all years are one ordered group, bounded by the years on record."""
    days = windows.join(barred.select("day").distinct(), "day", "left_anti").join(followed.select("day", F.lit(1).alias("f")).distinct(), "day", "left").fillna(0, ["f"])
    within = Window.partitionBy("k", F.month("day"))
    tenth = F.least(F.lit(9), F.floor((F.row_number().over(within.orderBy("w", "day")) - 1) * 10 / F.count("*").over(within)))
    out = days.withColumn("tenth", tenth).groupBy("k").agg(F.count("*").alias("days"), F.avg("f").alias("base"), F.coalesce(F.avg(F.when(F.col("tenth") == 9, F.col("f"))), F.lit(0.0)).alias("top"))
    return out.withColumn("lift", F.when(F.col("base") > 0, F.col("top") / F.col("base")).otherwise(F.when(F.col("top") > 0, 1.7976931348623157e308).otherwise(0.0)))


def digest(df: DataFrame) -> Column:
    """Of a table's rows, whatever their order: an aggregate over all columns."""
    return F.sum(F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)"))


def gates(each: DataFrame, contrast: DataFrame, lifts: DataFrame, roll_call: DataFrame, outer: int, again: DataFrame | None = None, least_anchors: int = 10) -> DataFrame:
    """One row: what each gate says, and the verdict of the chain, which stops at the first gate that fails.

    floor: `least_anchors` anchors with a window. G0, positive control: each anchor of the roll call exceeds the median of
    its controls, and all but one their upper quartile. G2, negative control: the series rotated by `outer` years, taken for the
    observed one, passes neither test. G3: `again`, the contrast made a second time, has the same digest. Test 1: the observed
    difference exceeds that of every rotation. Test 2: the top tenth is followed twice as often as the base, and its lift
    exceeds that of every rotation. A rotation without a statistic outranks nothing."""
    stats = contrast.select("k", "anchors", "delta").join(lifts.select("k", "base", "top", "lift"), "k", "full")
    # One row for each rotation: a stated number.
    rows = F.collect_list(F.struct("k", "anchors", "delta", "base", "top", "lift"))
    held = stats.agg(rows.alias("all"))

    def tests(seen: Column) -> tuple[Column, Column]:
        """Does rotation `seen` pass the tests against all others?"""
        me = lambda: F.get(F.filter("all", lambda r: r["k"] == seen), F.lit(0))
        others = F.filter("all", lambda r: r["k"] != seen)
        one = me()["delta"].isNotNull() & F.forall(others, lambda r: r["delta"].isNull() | (me()["delta"] > r["delta"]))
        two = (me()["base"] > 0) & (me()["top"] >= 2 * me()["base"]) & F.forall(others, lambda r: r["lift"].isNull() | (me()["lift"] > r["lift"]))
        return F.coalesce(one, F.lit(False)), F.coalesce(two, F.lit(False))

    called = roll_call.select("id").distinct().join(each.where("k = 0"), "id", "left")
    call = called.agg(F.count("*").alias("_c"), F.count_if(F.col("own") > F.col("middle")).alias("_m"), F.count_if(F.col("own") > F.col("upper")).alias("_u"))
    out = held.crossJoin(call)  # one row each
    same = F.lit(True)
    if again is not None:
        out = out.crossJoin(contrast.agg(digest(contrast).alias("_a"))).crossJoin(again.agg(digest(again).alias("_b")))
        same = F.col("_a") == F.col("_b")
    observed, rotated = tests(F.lit(0)), tests(F.lit(outer))
    enough = F.coalesce(F.get(F.filter("all", lambda r: r["k"] == 0), F.lit(0))["anchors"] >= least_anchors, F.lit(False))
    out = out.select(
        enough.alias("floor"), ((F.col("_c") > 0) & (F.col("_m") == F.col("_c")) & (F.col("_u") >= F.col("_c") - 1)).alias("g0"), (~(rotated[0] | rotated[1])).alias("g2"), same.alias("g3"), observed[0].alias("test1"), observed[1].alias("test2"),
    )
    chain = [("floor", "too few anchors"), ("g0", "positive control failed"), ("g2", "a test passed on rotated data"), ("g3", "not reproducible"), ("test1", "no contrast before onsets"), ("test2", "no lift")]
    verdict = F.lit("signal")
    for name, reason in reversed(chain):
        verdict = F.when(~F.col(name), reason).otherwise(verdict)
    return out.withColumn("verdict", verdict)
