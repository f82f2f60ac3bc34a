"""Seeded choices that come out alike everywhere: 32-bit hashing of text and a generator of fractions, as bitwise columns.

32-bit words are held in longs between 0 and 2^32 - 1. A product of two words is made of their halves, so that nothing
passes 63 bits (under ANSI rules an overflow would be an error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = (1 << 32) - 1
#: FNV-1a's basis and prime, and the step of the generator.
FNV_BASIS, FNV_PRIME, STEP = 0x811C9DC5, 0x01000193, 0x6D2B79F5


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def times(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product of two words."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    high = F.shiftrightunsigned(a, 16) * b.bitwiseAND(F.lit(_WORD))
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_WORD))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the text's UTF-16 code units, as a word: characters beyond the first plane count as their two units."""
    digits = F.hex(F.encode(text, "UTF-16BE"))  # four for each code unit
    units = F.transform(F.sequence(F.lit(1), F.length(digits) - 3, F.lit(4)), lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(digits) > 0, units).otherwise(F.array().cast("array<long>"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("long"), lambda h, u: times(h.bitwiseXOR(u), FNV_PRIME))


def fraction(seed: Column, n: Column | int) -> Column:
    """The n-th (from 1) fraction in [0, 1) of the generator that a word seeds: each is a function of seed and number alone, so
    that any one can be had without those before it."""
    n = F.lit(n) if isinstance(n, int) else n
    state = (seed + times(F.lit(STEP).cast("long"), n.cast("long").bitwiseAND(F.lit(_WORD)))).bitwiseAND(F.lit(_WORD))

    def first(a: Column) -> Column:
        return times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))

    def second(t: Column) -> Column:
        mixed = times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))
        return ((t + mixed).bitwiseAND(F.lit(_WORD))).bitwiseXOR(t)

    word = _bound(_bound(_bound(state, first), second), lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14)))
    return word / F.lit(float(1 << 32))


def seeded_picks(rows: DataFrame, group: Sequence[str], seed: Column, built: Sequence[Column], first: Sequence[Column], most: int, out: str = "pick") -> DataFrame:
    """Of each group at most `most` rows: the whole group if it is no larger, else the first by `first` and then by the
    fraction that each row draws. The rows draw in the order `built`, one each, from the generator that fnv1a(seed) seeds (a text
    that is the same for a group). `out` is the place of the row among those picked, from 1."""
    by = Window.partitionBy(*group)
    drawn = rows.withColumns({"_n": F.row_number().over(by.orderBy(*built)), "_all": F.count("*").over(by), "_seed": fnv1a(seed)})
    drawn = drawn.withColumn("_draw", fraction(F.col("_seed"), F.col("_n")))
    whole = F.col("_all") <= most
    place = F.row_number().over(by.orderBy(*(F.when(~whole, c) for c in first), F.when(~whole, F.col("_draw")), "_n"))
    return drawn.withColumn(out, place).where(F.col(out) <= most).drop("_n", "_all", "_seed", "_draw")
