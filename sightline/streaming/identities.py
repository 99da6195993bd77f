"""Identities that links merge batch by batch: connected components kept as pointers in a keyed table.

Every node that was ever linked points at a node of its component, and those pointers end at the component's smallest
node. A batch follows the pointers of its own nodes, merges the roots that its links join, and writes pointers of those
nodes and roots alone: nodes of a component that it does not name keep a pointer to an older root, which now points on. So
a batch reads and writes the buckets of what it touches, whatever the table has grown to. Links may go from a smaller node
to a larger one or back, repeat, and close loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains
from ..sources.tables import discarded, stored
from .upserts import KeyedTable


class Identities:
    """The components at a path; nodes are of one type that has an order."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.table = KeyedTable(spark, path, ["node"], ["batch"], buckets, keep)

    def find(self, nodes: DataFrame) -> DataFrame:
        """node and root of nodes(node), which may repeat; of nodes that were never linked, themselves."""
        at = stored(nodes.where("node IS NOT NULL").distinct().select("node", F.col("node").alias("root")))
        while True:
            up = self.table.lookup(at.select(F.col("root").alias("node")).distinct())
            if up is None:
                return at
            moved = up.select(F.col("node").alias("root"), F.col("parent").alias("_up"))
            at, before = stored(at.join(moved, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("_moved"))), at
            discarded(before)
            if at.where("_moved").isEmpty():
                return at.select("node", "root")

    def merge(self, links: DataFrame, batch_id: int) -> None:
        """Merge the components of links(a, b); a batch that is played again changes nothing."""
        m = self.table.manifest()
        if m and m["batch"] >= batch_id:
            return
        links = links.where("a IS NOT NULL AND b IS NOT NULL")
        found = self.find(links.select(F.col("a").alias("node")).union(links.select("b")))
        end = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        roots = chains.merged(edges)
        onward = found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root").select("node", F.col("_to").alias("parent"))
        pointers = onward.union(roots.select("node", F.col("root").alias("parent"))).distinct()
        self.table.merge(pointers.select("node", "parent", F.lit(batch_id).cast("long").alias("batch")), batch_id)

    def components(self) -> DataFrame | None:
        """node and root of every node that was ever linked; None before the first batch."""
        held = self.table.read()
        return None if held is None else chains.led_to(held.select("node", "parent"))
