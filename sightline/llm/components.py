"""Connected components by alternating stars, all in shuffles; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges(a, b), both long.

    Loops and repeated edges are harmless; no edges give no rows. Large groups stay stars: no pair list of a group is
    ever made, and a hub's edges are split by AQE's skew join.
    """
    e = written(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    mark = _mark(e)
    while mark[0]:
        e, last = written(_small(_large(e))), e
        forget(last)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _tidy(e: DataFrame) -> DataFrame:
    return e.where("a > b").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def _large(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(least.select("a", F.col("m").alias("b")).union(moved))
