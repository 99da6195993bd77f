"""Interval links between two streams: each row of one with the first row of the other a short time before it.

Both sides carry a watermark and the condition bounds the distance of their clocks, so Spark drops a row from the join's
state as soon as no row that could meet it may still come. Of a row's partners the first one is a minimum whose group
includes the row's clock; it is given out once the watermark has passed it. Rows without a partner give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other_"


def linked_first(left: DataFrame, right: DataFrame, keys: list[str], clock: str, row: str, span: str, late: str, where: Column | None = None) -> DataFrame:
    """clock, row and other_row: for each row of left the first of right (by clock, then row) of the same keys, at most span before it and not after it, that meets where.

    clock: a timestamp column of both; row: their id. where may use left's columns and right's as other_<name>. span and
    late are intervals, such as "6 hours"; rows that come later than late behind the newest one are dropped.
    """
    a = left.withWatermark(clock, late)
    b = right.select(*(F.col(c).alias(OTHER + c) for c in right.columns)).withWatermark(OTHER + clock, late)
    near = (F.col(OTHER + clock) >= F.col(clock) - F.expr(f"INTERVAL {span}")) & (F.col(OTHER + clock) <= F.col(clock))
    same = near
    for k in keys:
        same = same & (F.col(k) == F.col(OTHER + k))
    pairs = a.join(b, same, "inner")
    if where is not None:
        pairs = pairs.where(where)
    first = F.min(F.struct(OTHER + clock, OTHER + row))[OTHER + row]
    return pairs.groupBy(clock, row).agg(first.alias(OTHER + row))
