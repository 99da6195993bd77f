"""Joins beyond equality: pairs within a group, interval links, similar twins, reconciliation with a list."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state


def reconcile(reads: DataFrame, listed: DataFrame, key: str, listed_key: Column, order: list, fields: list[str]) -> DataFrame:
    """reads left joined with the first row per key of the list, and a verdict; values are compared as text.

    The list is grouped to one row per key before the join, so a repeated key never multiplies reads; Spark broadcasts
    it where its measured size allows.
    """
    names = [f"listed_{f}" for f in fields]
    first = listed.select(listed_key.alias("_key"), F.struct(*order, *(F.col(f).alias(n) for f, n in zip(fields, names, strict=True))).alias("_row")).groupBy("_key").agg(F.min("_row").alias("_row"))
    joined = reads.join(first, reads[key] == first["_key"], "left")
    same = F.lit(True)
    for f, n in zip(fields, names, strict=True):
        same = same & (F.col(f) == F.col(f"_row.{n}"))
    verdict = F.when(F.coalesce(F.col(key), F.lit("")) == "", "no_ply").when(F.col("_key").isNull(), "ply_absent").when(same, "exact").otherwise("values_differ")
    return joined.select(*reads.columns, *(F.col(f"_row.{n}").alias(n) for n in names), verdict.alias("verdict"))


def within(left: DataFrame, right: DataFrame, keys: list[str], t: str, span: int, name: str) -> DataFrame:
    """Rows of left with those of right (renamed other_*) of the same keys at most span before or at them.

    Both sides are dealt by keys and a bucket of span; right rows also go to the next bucket, so what is joined stays
    near the pairs that hold.
    """
    bucket = F.floor(F.col(t) / span)
    a = left.withColumn("_b", bucket)
    b = right.select(*keys, *(F.col(c).alias(f"{name}{c}") for c in right.columns if c not in keys)).withColumn("_b", F.explode(F.array(F.floor(F.col(f"{name}{t}") / span), F.floor(F.col(f"{name}{t}") / span) + 1)))
    return a.join(b, [*keys, "_b"]).where(F.col(t).between(F.col(f"{name}{t}"), F.col(f"{name}{t}") + span)).drop("_b")


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b, strict=True))
    known = {p: state.similarity(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype="float64")


def sequence_ratio(a, b) -> Column:
    """Similarity of the digits of two texts, newer first; Arrow batches, no state."""
    return F.pandas_udf(_ratios, T.DoubleType())(a, b)


def ratio_bound(a, b) -> Column:
    """The most that the similarity of two texts can be: twice the digits they have in common, whatever their order, over all their digits; 0 if either has none."""
    x, y = (F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "[^0-9]", "") for c in (a, b))
    times = lambda c, d: F.length(c) - F.length(F.replace(c, F.lit(str(d)), F.lit("")))
    common = reduce(Column.__add__, (F.least(times(x, d), times(y, d)) for d in range(10)))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), 2 * common / (F.length(x) + F.length(y))).otherwise(0.0)


def alike(a, b, least: float) -> Column:
    """Whether two texts are at least so similar. As a condition of a filter the bound comes first, so Python sees only pairs that it leaves."""
    return (ratio_bound(a, b) >= least) & (sequence_ratio(a, b) >= least)


def digits(text) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def digit_counts(text) -> Column:
    """How often each digit occurs in a text of digits, six bits each in one long; null beyond 63 digits."""
    times = (F.length(text) - F.length(F.replace(text, F.lit(str(d)), F.lit(""))) for d in range(10))
    packed = reduce(Column.bitwiseOR, (F.shiftleft(n.cast("long"), 6 * d) for d, n in enumerate(times)))
    return F.when(F.length(text) <= 63, packed)


def first_alike(left: DataFrame, right: DataFrame, keys: list[str], t: str, row: str, reading: str, apart: str, span: int, least: float, name: str = "other_") -> DataFrame:
    """row and <name>row: for each row id of left the first of right (by t, then row) of the same keys, at most span before it
    or at it, with another id, another value of apart and a similarity of reading of at least `least` (above 0).

    Of right rows that differ in their id alone the two smallest ids can be first, so only they are joined. Digits are
    counted once per row: a pair costs a few operations on two longs, and the exact ratio is for what that bound leaves.
    """
    of = lambda df: df.select(*keys, t, row, apart, digits(F.col(reading)).alias("_digits")).where((F.col("_digits") != "") & F.col(row).isNotNull())
    lowest = Window.partitionBy(*keys, apart, t, "_digits").orderBy(row)
    b = of(right).distinct().withColumn("_r", F.row_number().over(lowest)).where("_r <= 2").drop("_r")
    a, b = (df.withColumn("_counts", digit_counts(F.col("_digits"))) for df in (of(left), b))
    common = reduce(Column.__add__, (F.least(*(F.shiftright(c, 6 * d).bitwiseAND(F.lit(63)) for c in ("_counts", f"{name}_counts"))) for d in range(10)))
    bound = F.coalesce(2 * common / (F.length("_digits") + F.length(f"{name}_digits")), F.lit(1.0))
    pairs = within(a, b, keys, t, span, name).where((F.col(apart) != F.col(name + apart)) & (F.col(row) != F.col(name + row)) & (bound >= least))
    similar = (F.col("_digits") == F.col(f"{name}_digits")) | (sequence_ratio("_digits", f"{name}_digits") >= least)
    return pairs.where(similar).groupBy(row).agg(F.min(F.struct(name + t, name + row))[name + row].alias(name + row))


def first_in(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
