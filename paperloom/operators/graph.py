"""Reachability, orphans, dangling references and tree statistics over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reachable(seeds: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", scope: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that paths from the seeds reach, seeds and dangling targets included.

    A frontier loop: all scopes (files) advance together, so rounds are as many as the longest
    shortest path. Each round is written to the checkpoint folder, which bounds the lineage.
    """
    key = [*scope, node]
    seen = cut(seeds.select(*key).distinct())
    frontier, steps = seen, edges.select(*scope, F.col(src).alias(node), F.col(dst).alias("_next"))
    while True:
        following = frontier.join(steps, key).select(*scope, F.col("_next").alias(node)).distinct()
        frontier = cut(following.join(seen, key, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def orphans(nodes: DataFrame, referenced: DataFrame, key: list[str]) -> DataFrame:
    """Nodes that nothing refers to (or that are not among the reached)."""
    return nodes.join(referenced.select(*key).distinct(), key, "left_anti")


def dangling(references: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """References whose target is missing."""
    return references.join(nodes.select(*key).distinct(), key, "left_anti")


def tree_levels(roots: DataFrame, edges: DataFrame, max_depth: int = 200, scope: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth): shortest depth below the roots' children (depth 1), first visit wins, no deeper than ``max_depth``."""
    key = [*scope, "node"]
    steps = edges.select(*scope, F.col("src").alias("node"), F.col("dst").alias("_next"))
    seen = cut(roots.select(*key).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        following = frontier.join(steps, key).select(*scope, F.col("_next").alias("node")).distinct()
        frontier = cut(following.join(seen, key, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
