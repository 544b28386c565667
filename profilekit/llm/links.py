"""Connected components of link tables, by hooking and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), the root being the smallest id it is linked with.

    Each round every node takes the smallest root among its neighbours, then pointers are followed to
    their ends, and edges are redrawn between roots. Rounds fall with the logarithm of the longest chain; an edge
    whose ends share a root is gone, so tables shrink. A node with very many links is pre-aggregated
    like any other key.
    """
    left = materialise(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while not left.isEmpty():
        # Every root hooks to its smallest neighbour below it; ids fall along hooks, so there are no cycles.
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        tops = left.select(F.col("a").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("up"))
        pointers = materialise(hooks.unionByName(tops))
        while True:
            ahead = pointers.select(F.col("node").alias("up"), F.col("up").alias("further"))
            longer = materialise(pointers.join(ahead, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
            pointers = longer.select("node", "up")
            if longer.where("moved").isEmpty():
                break
        if known is None:
            known = pointers
        else:
            ahead = pointers.select(F.col("node").alias("up"), F.col("up").alias("further"))
            known = materialise(known.join(ahead, "up", "left").select("node", F.coalesce("further", "up").alias("up")))
        root = pointers.select(F.col("node"), F.col("up"))
        left = materialise(
            left.join(root.withColumnsRenamed({"node": "a", "up": "ra"}), "a").join(root.withColumnsRenamed({"node": "b", "up": "rb"}), "b")
            .where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if known is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return known.select("node", F.col("up").alias("root"))
