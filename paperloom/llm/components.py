"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, label): the smallest id reachable from each id that has a link.

    Each round takes the smallest label among neighbours (aggregated on the map side, so a hub costs
    one row per task), then follows labels once; paths shorten exponentially.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        lower = cut(lower)
        jump = lower.select(F.col("id").alias("at"), F.col("label").alias("next"))
        after = cut(lower.join(jump, F.col("label") == F.col("at")).select("id", F.least("label", "next").alias("label"), "old"))
        if after.where("label <> old").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")
