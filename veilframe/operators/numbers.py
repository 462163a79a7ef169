"""Numeric surrogates: numbers stand in for numbers of the same size, sign and format, and come back."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import settled


def canonical(text: str | None) -> str | None:
    """1200, 1200.0 and 1.2E3 are one number; null for what is none."""
    try:
        value = Decimal((text or "").strip())
    except (InvalidOperation, ValueError):
        return None
    if not value.is_finite() or abs(value.adjusted()) > 400:
        return None
    out = format(value.normalize(), "f")
    return "0" if out in ("-0", "") else out


def _canonical_all(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def canonical_number(text: Column) -> Column:
    """canonical() of a column. Plain integers and decimals take the native way."""
    plain = text.rlike(r"^-?[0-9]{1,30}(?:\.[0-9]{1,30})?$")
    cut = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    cut = F.regexp_replace(cut, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(plain, F.when(cut == "-0", F.lit("0")).otherwise(cut)).otherwise(F.pandas_udf(_canonical_all, "string")(text))


def should_replace(canon: Column) -> Column:
    """False for small whole numbers (to 12) and for years (1900 to 2100), which give nothing away."""
    whole = ~F.contains(canon, F.lit("."))
    value = canon.try_cast("decimal(38,0)")
    return ~(whole & value.isNotNull() & ((F.abs(value) <= 12) | value.between(1900, 2100)))


def candidate(canon: Column, key: str, attempt: Column | int, turn: int = 0) -> Column:
    """A surrogate by a keyed hash: a factor of 0.55 to 1.85, whole for whole numbers, with more places for others.

    From the third turn on the factor grows, for numbers so dense that none is left beside them.
    """
    tries = F.lit(attempt) if isinstance(attempt, int) else attempt
    unit = F.pmod(F.xxhash64(F.lit(key), canon, tries), F.lit(1_000_000_000)) / F.lit(1_000_000_000.0)
    value = canon.try_cast("decimal(38,12)")
    value = F.when(value == 0, F.lit(1).cast("decimal(38,12)")).otherwise(value)
    wide = 4.0 ** max(0, turn - 1)
    product = value * F.round((F.lit(0.55) + unit * F.lit(1.3)) * wide, 6).cast("decimal(20,6)")
    places = F.when(F.contains(canon, F.lit(".")), F.length(F.substring_index(canon, ".", -1))).otherwise(0)
    whole = F.round(product, 0).cast("decimal(38,0)")
    # a round number would give itself away
    odd = F.when((F.abs(whole) >= 100) & (whole % 10 == 0), whole + F.pmod(F.xxhash64(canon, tries), F.lit(9)).cast("int") + 1).otherwise(whole)
    extra = F.when(F.abs(value) < 100, 2).otherwise(1)
    scale = F.pow(F.lit(10.0), places + extra)
    fraction = F.format_string("%.9f", F.round(product.cast("double") * scale, 0) / scale)
    return canonical_number(F.when(places == 0, odd.cast("string")).otherwise(fraction))


#: Turns after which numbers are too dense to be hidden, and tries of a number in one turn.
TURNS, TRIES = 14, 8


def surrogates(numbers: DataFrame, known: DataFrame, key: str, amounts: bool = False) -> DataFrame:
    """known (original, surrogate) with surrogates for all new ones among numbers (original, canonical).

    Of those only what should_replace() names, unless they are known to be amounts: then every one.

    A surrogate differs from its original, from every original and from every other surrogate. In
    each turn a number that has none tries a few; of several that want one the smallest original has it, and
    only what is taken is reserved. The others go on in the next turn, until all have one.
    """
    originals = settled(numbers.select("original").where("original IS NOT NULL").distinct())
    have = known.select("original", "surrogate")
    fresh = settled(originals.where(F.lit(True) if amounts else should_replace(F.col("original"))).join(have, "original", "left_anti"))
    for turn in range(TURNS):
        if fresh.limit(1).count() == 0:
            return have
        tries = fresh.select("original", F.explode(F.sequence(F.lit(turn * TRIES), F.lit((turn + 1) * TRIES - 1))).alias("attempt"))
        tries = tries.withColumn("surrogate", candidate(F.col("original"), key, F.col("attempt"), turn)).where("surrogate IS NOT NULL AND surrogate != '0' AND surrogate != original").where(should_replace(F.col("surrogate")))
        tries = tries.join(originals.select(F.col("original").alias("surrogate")), "surrogate", "left_anti").join(have.select("surrogate"), "surrogate", "left_anti")
        owner = tries.groupBy("surrogate").agg(F.min(F.struct("attempt", "original")).alias("o")).select("surrogate", "o.attempt", "o.original")
        taken = settled(owner.groupBy("original").agg(F.min_by("surrogate", "attempt").alias("surrogate")))
        have = have.unionByName(taken)
        fresh = settled(fresh.join(taken, "original", "left_anti"))
    if (left := fresh.count()) > 0:
        raise ValueError(f"{left} numbers have no surrogate: they are too dense")
    return have


def apply_numbers(cells: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """cells with column (canonical text) replaced where the mapping has it."""
    return cells.join(mapping.select(F.col("original").alias("__o"), F.col("surrogate").alias("__s")), F.col(column) == F.col("__o"), "left").withColumn(column, F.coalesce("__s", column)).drop("__o", "__s")


def restore_numbers(cells: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    back = mapping.select(F.col("surrogate").alias("original"), F.col("original").alias("surrogate"))
    return apply_numbers(cells, back, column)
