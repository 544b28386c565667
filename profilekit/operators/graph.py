"""Ego graphs and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.config import NOISE
from profilekit.functions.scalar import score_bucket
from profilekit.operators.labels import with_defaults
from profilekit.operators.relational import first_per_key

NODE_DEFAULTS = {"label": NOISE, "x": 0.0, "y": 0.0, "role": "—", "flag": False, "debut_period": 0, "final_period": 0}


def ego_edges(results: DataFrame, score: str = "hybrid") -> DataFrame:
    """One scored edge from the centre to each neighbour."""
    return results.select(
        F.col("query_id").alias("center"), F.col("query_id").alias("source"), F.col("item_id").alias("target"),
        F.col(score).alias("score"), "rank",
    )


def ego_nodes(edges: DataFrame, points: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Centre and neighbours with cluster attributes; entities without a cluster row get the defaults."""
    defaults = defaults or {c: v for c, v in NODE_DEFAULTS.items() if c in points.columns}
    centres = edges.select("center", F.col("center").alias("id"), F.lit(True).alias("is_center")).distinct()
    others = edges.select("center", F.col("target").alias("id"), F.lit(False).alias("is_center"))
    nodes = first_per_key(centres.unionByName(others), ["center", "id"], [F.col("is_center").desc()])
    return with_defaults(nodes, points, "id", defaults)


def merge_graphs(nodes: DataFrame, edges: DataFrame, root: object) -> tuple[DataFrame, DataFrame]:
    """Merge ego graphs: one row per node and per undirected edge.

    Of an edge seen from both ends the one whose graph comes first (smaller centre)
    stays. A node is the centre only when it is the root, and expanded when its own
    graph is among the merged.
    """
    expanded = nodes.select(F.col("center").alias("id"), F.lit(True).alias("_e")).distinct()
    merged = first_per_key(nodes, ["id"], [F.col("center")]).drop("center").join(expanded, "id", "left").withColumns({
        "is_center": F.col("id") == F.lit(root), "expanded": F.coalesce("_e", F.lit(False)),
    }).drop("_e")
    keyed = edges.withColumns({"low": F.least("source", "target"), "high": F.greatest("source", "target")})
    kept = first_per_key(keyed, ["low", "high"], [F.col("center"), F.col("rank")])
    return merged, kept.drop("low", "high", "center", "rank").withColumn("strength", score_bucket(F.col("score")))
