"""Exact quantiles by distributed selection: no task holds the values of a group, only counts of bins.

A quantile lies between two ranks. For each rank a round counts the group's values in BINS bins between the least and the
largest value that the rank may have, keeps the bin that holds it, and goes on with that bin's own least and largest
value. Both ends of the interval are values, so no round leaves it as it was; once few values are left they are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Bins of a round, and values of an interval that are few enough to be ranked.
BINS, FEW = 1024, 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, share and quantile, interpolated between neighbouring values: for every share of each group. Null and NaN values are left out, infinite ones too; a group without values has no rows."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, x.alias("_x"))
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    place = F.col("share") * (F.col("n") - 1)
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).select("*", wanted))
    low, high = F.floor(place), F.ceil(place)
    ranks = groups.select(*keys, "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"), F.explode(F.array(low, high)).alias("rank"))
    todo, found = stored(ranks.distinct()), None
    while True:
        settled = todo.where((F.col("inside") <= few) | (F.col("lo") == F.col("hi")))
        found = settled if found is None else found.union(settled)
        wide = todo.where((F.col("inside") > few) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        near = rows.join(wide, keys).where(F.col("_x").between(F.col("lo"), F.col("hi")))
        part = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the distance can't overflow
        counted = near.groupBy(*keys, "rank", "below", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("inside"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most bins rows
        placed = counted.withColumn("below", F.col("below") + before)
        todo = stored(placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))).select(*ranks.columns))
    same = found.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))
    few_left = rows.join(found.where("lo < hi"), keys).where(F.col("_x").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys, "rank").orderBy("_x")  # at most few rows
    ranked = few_left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == F.col("rank") - F.col("below") + 1).select(*keys, "rank", F.col("_x").alias("v"))
    values = stored(same.union(ranked))
    at = lambda rank, name: values.withColumnRenamed("rank", rank).withColumnRenamed("v", name)
    both = groups.select(*keys, "share", place.alias("place"), low.alias("_low"), high.alias("_high")).join(at("_low", "a"), [*keys, "_low"]).join(at("_high", "b"), [*keys, "_high"])
    return both.select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("_low"))).alias("quantile"))
