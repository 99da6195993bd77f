"""Ordered operators: trailing extent, gaps and islands, interval merging, forward fill, run collapse, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def trailing_extent(df: DataFrame, key: str, t: str, value: str, span: int, tie: str) -> DataFrame:
    """extent: largest less smallest value over the last span of t, inclusive; one point gives 0."""
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-span, 0)
    return df.withColumn("extent", F.max(value).over(w) - F.min(value).over(w))


def displacement(df: DataFrame, key: str, order: list[str], t: str, x: str, y: str, span: int, most: int = 120) -> DataFrame:
    """moved: the larger of the extents in x and y over the last most rows that are no older than span; one point gives 0.

    Of the two frames, by rows and by time, one lies in the other, so an extent is the smaller of theirs. Rows of equal
    time are seen together.
    """
    by_rows = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - most, 0)
    by_time = Window.partitionBy(key).orderBy(t).rangeBetween(-span, 0)
    extent = lambda c: F.least(*(F.max(c).over(w) - F.min(c).over(w) for w in (by_rows, by_time)))
    return df.withColumn("moved", F.greatest(extent(x), extent(y)))


def islands(df: DataFrame, key: str, order: list[str], t: str, gap: int) -> DataFrame:
    """island (from 1): a new one starts where t is more than gap after the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w) + 1).drop("_new")


def merged_intervals(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Per key the number of intervals after merging those that meet; touching ones merge."""
    w = Window.partitionBy(key).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).groupBy(key).agg(F.sum("_new").alias("n_merged"))


def forward_fill(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def collapse_runs(df: DataFrame, key: str, order: list[str], symbol: Column, blank: str) -> DataFrame:
    """Per key the symbols joined, runs once and blanks left out; a blank between equal symbols keeps both."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_s", symbol)
    rows = rows.withColumn("_new", (F.col("_s") != blank) & ~F.col("_s").eqNullSafe(F.lag("_s").over(w)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct(*order, "_s"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_s"]), "").alias("collapsed"))


def change_points(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is not null and differs from the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("before")))


def first_at_or_after(rows: DataFrame, t: str, columns: list[str], tick: int) -> DataFrame:
    """Forward as-of: for each multiple of tick, from the one before the first row on, the first row at or after it (of ties the smallest first column).

    Rows are aggregated to the first one of each tick's interval, with partial sums before the shuffle. A tick without rows
    of its own takes the next interval's: each interval with rows answers all ticks since the one before it, which a scan
    over ranges of intervals finds.
    """
    firsts = rows.groupBy(F.floor(F.col(t) / tick).alias("_n")).agg(F.min(F.struct(t, *columns)).alias("_row")).where("_n IS NOT NULL")
    since = scans.with_previous(firsts, ["_n"], "_n", "_before")
    ticks = since.withColumn("_tick", F.explode(F.sequence(F.coalesce(F.col("_before") + 1, F.col("_n")), F.col("_n"))))
    return ticks.select((F.col("_tick") * tick).alias("tick"), *(F.col(f"_row.{c}").alias(c) for c in columns))


def each_once_at_or_after(rows: DataFrame, key: str, order: list[str], t: str, tick: int) -> DataFrame:
    """Forward as-of that takes no row twice: per key, tick after tick (n, from that of the first row on) the first row not
    taken yet that is at or after the tick, as long as there is one. key, n and the columns of rows.

    The n-th tick takes the row after the one taken before, or the first one due if that is later: place n + the largest of
    (place due - n) so far, a running maximum over ticks. Only ticks that have rows of their own change what is due.
    """
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(w)).withColumn("_n", F.floor(F.col(t) / tick))
    due = placed.groupBy(key, "_n").agg(F.min("_place").alias("_due"))  # ticks without a row of their own take the next one's
    by_tick = Window.partitionBy(key).orderBy("_n")
    low = F.coalesce(F.lag("_n").over(by_tick) + 1, F.col("_n"))
    ticks = due.select(key, "_due", low.alias("_low"), "_n").select(key, "_due", F.explode(F.sequence("_low", "_n")).alias("_tick"))
    lead = F.max(F.col("_due") - F.col("_tick")).over(Window.partitionBy(key).orderBy("_tick"))
    taken = ticks.select(F.col(key).alias("_key"), F.col("_tick").alias("n"), (F.col("_tick") + lead).alias("_at"))
    return taken.join(placed, (taken["_key"] == placed[key]) & (taken["_at"] == placed["_place"])).select("n", *rows.columns)
