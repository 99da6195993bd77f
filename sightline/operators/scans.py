"""Scans in one global order without one global task: ranges, a sum for each, and what is carried into each.

The rows are dealt into ranges of the order, sorted there and stored with their range and their place in it. One small
row per range (its count, its last value, its total) is folded on the driver, in the order of the ranges, into what each
range starts from; the rest is a window within each range. The number of ranges is that of the shuffle's partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: list) -> DataFrame:
    """df, stored, with _scan_range and _scan_place (from 0): ranges follow one another in the order, and places within them. Rows equal in the order come in any order."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return stored(ordered.withColumn("_scan_at", at)).withColumns({"_scan_range": F.shiftright("_scan_at", 33).cast("int"), "_scan_place": F.col("_scan_at").bitwiseAND(F.lit(_PLACE))}).drop("_scan_at")


def _carried(rows: DataFrame, sums: DataFrame, start, step, kind: str) -> DataFrame:
    """rows with _scan_carry: what start has become, by step(carry, value), over the values that sums has for the ranges before."""
    into, now = [], start
    for r in sorted(sums.collect()):  # one row per range
        into.append((r[0], now))
        now = step(now, r[1])
    table = rows.sparkSession.createDataFrame(into, f"_scan_range int, _scan_carry {kind}")
    return rows.join(F.broadcast(table), "_scan_range", "left")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the number (from 1) of each row in the order."""
    rows = ranged(df, order)
    counts = rows.groupBy("_scan_range").agg(F.count("*").alias("n"))
    return _carried(rows, counts, 0, int.__add__, "bigint").withColumn(name, F.col("_scan_carry") + F.col("_scan_place") + 1).select(*df.columns, name)


def with_previous(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """df with the column's value in the row before, by the order; null in the first."""
    rows = ranged(df, order)
    last = rows.groupBy("_scan_range").agg(F.max_by(column, "_scan_place").alias("v"))
    here = F.lag(column).over(Window.partitionBy("_scan_range").orderBy("_scan_place"))
    kind = df.schema[column].dataType.simpleString()
    return _carried(rows, last, None, lambda _, v: v, kind).withColumn(name, F.when(F.col("_scan_place") == 0, F.col("_scan_carry")).otherwise(here)).select(*df.columns, name)


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of a whole-numbered value over the rows up to and with each, by the order; null counts as 0."""
    rows = ranged(df.withColumn("_scan_value", F.coalesce(value.cast("bigint"), F.lit(0))), order)
    totals = rows.groupBy("_scan_range").agg(F.sum("_scan_value").alias("v"))
    here = F.sum("_scan_value").over(Window.partitionBy("_scan_range").orderBy("_scan_place").rowsBetween(Window.unboundedPreceding, 0))
    return _carried(rows, totals, 0, int.__add__, "bigint").withColumn(name, F.col("_scan_carry") + here).select(*df.columns, name)


def forward_filled(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """df with the column's last value that is not null, up to and with each row, by the order."""
    rows = ranged(df, order)
    last = rows.groupBy("_scan_range").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_scan_place"))).alias("v"))
    here = F.last(column, ignorenulls=True).over(Window.partitionBy("_scan_range").orderBy("_scan_place").rowsBetween(Window.unboundedPreceding, 0))
    kind = df.schema[column].dataType.simpleString()
    return _carried(rows, last, None, lambda now, v: now if v is None else v, kind).withColumn(name, F.coalesce(here, "_scan_carry")).select(*df.columns, name)
