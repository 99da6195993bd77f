"""Kernels over arrays of numbers, as higher-order functions: shares, variance, quantiles, scaling. Results match published definitions in property, not bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_share(values: Column, at: float) -> Column:
    """Share of values of at or more; 0 of an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda x: x >= at)) / n).otherwise(0.0)


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def variance(values: Column) -> Column:
    """Population variance, 0 of an empty array."""
    own = lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m))))
    return F.when(F.size(values) > 0, let(values, own)).otherwise(0.0)


def laplacian(values: Column) -> Column:
    """Second differences of a row."""
    return F.transform(F.sequence(F.lit(2), F.size(values) - 1), lambda i: F.element_at(values, i - 1) - 2 * F.element_at(values, i) + F.element_at(values, i + 1))


def quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array."""
    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(s)))
        return a + (b - a) * (at - low)

    return let(F.array_sort(values), of)


def stretch(values: Column, low: float, high: float) -> Column:
    """Values scaled so that the two quantiles become 0 and 1, clamped."""
    ends = F.struct(quantile(values, low).alias("a"), quantile(values, high).alias("b"))
    return let(ends, lambda e: F.transform(values, lambda x: F.greatest(F.least((x - e["a"]) / F.greatest(e["b"] - e["a"], F.lit(1e-6)), F.lit(1.0)), F.lit(0.0))))


def minmax(values: Column) -> Column:
    ends = F.struct(F.array_min(values).alias("a"), F.array_max(values).alias("b"))
    return let(ends, lambda e: F.transform(values, lambda x: F.when(e["b"] > e["a"], (x - e["a"]) / (e["b"] - e["a"]) * 255.0).otherwise(0.0)))
