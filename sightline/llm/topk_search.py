"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks by a hash of their id; each pair of a query block and a candidate block is
one group. There the candidates become postings (term = dimension, weight != 0), each sparse query row scatters its
weights through them into a dense score array, a partition selects the block's k best, and Spark merges the blocks.
What one group holds is bounded by the block sizes whatever the input; nothing is broadcast or collected.

Defined results: vectors that are null or hold a null or non-finite component take no part; a missing component counts
as zero; rows with the query's own id are not its candidates; of repeated query ids the smallest vector asks; ties go
to the smaller id; fewer than k candidates give fewer rows; an empty table gives none; rows without an id take no part;
vectors may be of any and of different lengths; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, STRIP = 2048, 2048, 256


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and terms (array of long): floor(scale * x) of each component; unusable vectors are left out."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("terms"))


def _dense(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack([np.asarray(r, np.int64) for r in rows]) if width else np.zeros((len(rows), 0), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def scatter(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Dense score arrays of the queries over n candidates, one term at a time."""
    scores = np.zeros((len(queries), n), np.int64)
    for term in range(min(queries.shape[1], len(postings))):
        at, weight = postings[term]
        rows = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(at):
            continue
        part = queries[rows, term, None] * weight
        if len(at) == n and len(rows) == len(queries):
            scores += part
        else:
            scores[np.ix_(rows, at)] += part
    return scores


def best_of_block(k: int):
    def run(_, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values("id", kind="stable")
            ids, weights = candidates["id"].to_numpy(), _dense(candidates["terms"])
            postings = [(at := np.flatnonzero(weights[:, t]), weights[at, t]) for t in range(weights.shape[1])]
            asked, asks = queries["id"].to_numpy(), _dense(queries["terms"])
            for low in range(0, len(asked), STRIP):
                for own, row in zip(asked[low : low + STRIP], scatter(asks[low : low + STRIP], postings, len(ids)), strict=True):
                    keep = np.flatnonzero(ids != own)
                    s = row[keep]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        above, ties = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
                        pick = np.concatenate([above, ties[: k - len(above)]])  # ids ascend: the smaller ones first
                    else:
                        pick = np.arange(len(s))
                    found += [(int(own), int(ids[keep[i]]), int(s[i])) for i in pick]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest integer inner products."""
    rows = quantised(df, scale, id_col, vector_col)
    asks = quantised(df.where(is_query), scale, id_col, vector_col).groupBy("id").agg(F.min("terms").alias("terms"))
    n_blocks, n_asks = max(1, -(-rows.count() // BLOCK)), max(1, -(-asks.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("block", dealt(n_blocks)).withColumn("ask", every(n_asks))
    right = asks.withColumn("ask", dealt(n_asks)).withColumn("block", every(n_blocks))
    best = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInPandas(best_of_block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
