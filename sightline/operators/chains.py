"""Chains of rows by pointers: what a greedy walk over one key accepts, where links lead, and which pairs a greedy choice takes.

Each is a number of rounds that grows with the logarithm of a chain's length, or with the depth of a choice, and every
round is joins and aggregates over all keys at once; a key that holds all rows is spread like any other. Each round is
stored, and the one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discarded, stored
from . import scans


def accepted(df: DataFrame, key: str, t: str, tie: list[str], least: int) -> DataFrame:
    """The rows that a walk in the order of (t, tie) accepts in each key: its first one, and each that is at least so long after the last accepted one. Rows without a time are left out.

    Every row points at the first one that comes long enough after it, which a scan finds in one order of rows and of
    moments sought; the accepted rows are those that lie on the pointers' path from a key's first row. Marks and pointers
    double their reach in every round.
    """
    order = [key, t, *tie]
    rows = stored(scans.numbered(df.where(F.col(t).isNotNull()), [F.asc_nulls_first(c) for c in order], "_n"))
    sought = rows.select(key, F.col("_n").alias("_from"), F.lit(None).cast("long").alias("_n"), (F.col(t) + least).alias("_at"), F.lit(1).alias("_late"))
    both = rows.select(key, F.lit(None).cast("long").alias("_from"), "_n", F.col(t).alias("_at"), F.lit(0).alias("_late")).union(sought)
    both = both.withColumn("_row", F.when(F.col("_late") == 0, F.struct(F.col(key).alias("k"), F.col("_n").alias("n"))))
    down = [F.desc_nulls_last(key), F.desc("_at"), F.asc("_late"), F.desc("_n")]
    found = scans.forward_filled(both, down, "_row", "_next").where("_late = 1")
    jumps = stored(found.select(F.col("_from").alias("n"), F.when(F.col("_next.k").eqNullSafe(F.col(key)), F.col("_next.n")).alias("to")).where("to IS NOT NULL"))
    marks = stored(rows.groupBy(key).agg(F.min("_n").alias("n")).select("n"))
    while True:
        more = stored(marks.join(jumps, "n").select(F.col("to").alias("n")))
        if more.isEmpty():
            discarded(more)
            break
        marks, last = stored(marks.union(more).distinct()), marks
        further = jumps.select(F.col("n").alias("to"), F.col("to").alias("_then"))
        jumps, before = stored(jumps.join(further, "to").select("n", F.col("_then").alias("to"))), jumps
        for old in (last, before, more):
            discarded(old)
    return rows.join(marks.select(F.col("n").alias("_n")), "_n").select(*df.columns)


def greedy_pairs(scored: DataFrame, keys: list[str], score: str, a: str, b: str) -> DataFrame:
    """keys, a and b of the pairs that a greedy choice takes, by the highest score, of equal ones the higher a, then the higher b; each a and b of a key at most once.

    A pair that is the best one of both its ends comes before all that could forbid it, so all such pairs are taken at
    once; what they leave open is the next round's. Repeated pairs count once; pairs without a score are left out.
    """
    rank = F.struct(score, a, b)
    left, out, before = scored.where(F.col(score).isNotNull()).select(*keys, score, a, b), None, None
    while True:
        best = [left.groupBy(*keys, end).agg(F.max(rank).alias("_best")).select(*keys, "_best.*") for end in (a, b)]
        taken = stored(best[0].join(best[1], [*keys, score, a, b]).select(*keys, a, b))
        if taken.isEmpty():
            return taken if out is None else out
        out = taken if out is None else out.union(taken)
        left = stored(left.join(taken.select(*keys, a), [*keys, a], "left_anti").join(taken.select(*keys, b), [*keys, b], "left_anti"))
        if before is not None:
            discarded(before)
        before = left


def led_to(links: DataFrame) -> DataFrame:
    """node and root of links (node, parent): where the chain of a node's parents ends, at one that is its own parent or has none. A chain that runs into a loop has the loop's smallest node as its root.

    Each node has at most one link; a parent may be larger or smaller than its node, or no node of the table.
    """
    link = links.where("node IS NOT NULL").select("node", F.coalesce("parent", "node").alias("parent"))
    up = stored(link.select("node", "parent", F.least("node", "parent").alias("least"), (F.col("node") == F.col("parent")).alias("ended")))
    reach, n = 1, up.count()
    while reach <= n and not up.where("NOT ended").isEmpty():
        higher = up.select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        both = up.join(higher, "parent", "left")
        ended = F.col("ended") | F.coalesce("_ended", F.lit(True))
        up, before = stored(both.select("node", F.coalesce("_up", "parent").alias("parent"), F.least("least", "_least").alias("least"), ended.alias("ended"))), up
        discarded(before)
        reach *= 2
    ring = up.where("NOT ended").select(F.col("node").alias("parent"), F.col("least").alias("_ring"))  # round a loop a pointer has seen all of it
    return up.join(ring, "parent", "left").select("node", F.coalesce("_ring", "parent").alias("root"))


def merged(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges (a, b), in any direction; loops and repeats are harmless.

    Every root points at the least root next to it, if that is smaller; such chains only descend, led_to follows them, and
    the edges are between fewer roots in the next round. A node with very many edges is one minimum.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    roots = stored(both.select(F.col("a").alias("node")).union(both.select("b")).distinct().withColumn("root", F.col("node")))
    left = stored(both.where("a <> b").distinct())
    while not left.isEmpty():
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("least"))
        to = stored(led_to(near.select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))))
        name = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        roots, before = stored(roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))), roots
        left, edges_before = stored(left.join(name("a"), "a").join(name("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()), left
        for old in (before, edges_before, to):
            discarded(old)
    return roots
