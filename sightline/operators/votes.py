"""Votes of repeated readings: counts, thresholded winner, confidence, leader. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, votes; null values don't vote."""
    return df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"))


def tally(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: top value (of ties the smallest), its votes, those of the second, and all votes. Mergeable aggregates only: a key of any number of values takes no memory."""
    c = counts(df, key, value)
    best = c.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v"))).alias("b"), F.sum("votes").alias("total"))
    others = c.join(best.select(F.col(key).alias("_key"), F.col("b.v").alias("_top")), F.col(key) == F.col("_key")).where(F.col(value) != F.col("_top"))
    second = others.groupBy("_key").agg(F.max("votes").alias("_votes"))
    both = best.join(second, F.col(key) == F.col("_key"), "left")
    return both.select(key, F.col("b.v").alias("top"), (-F.col("b.n")).alias("top_votes"), F.coalesce("_votes", F.lit(0)).alias("second_votes"), "total")


def winner(df: DataFrame, key: str, value: str, least: int = 2, margin: int = 1) -> DataFrame:
    """key and winner: the top value if it has enough votes and leads by the margin, else null."""
    ok = (F.col("top_votes") >= least) & (F.col("top_votes") - F.col("second_votes") >= margin)
    return tally(df, key, value).withColumn("winner", F.when(ok, F.col("top")))


def leader(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and leader: the most frequent value, of ties the one seen first."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return c.groupBy(key).agg(F.max_by(value, F.struct("votes", -F.col("first"))).alias("leader"))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row per key, by a mergeable maximum instead of a sort."""
    newest = F.max(F.struct(*order, *columns)).alias("newest")
    return df.groupBy(key).agg(newest).select(key, *(F.col(f"newest.{c}").alias(c) for c in [*order, *columns]))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group of keys."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
