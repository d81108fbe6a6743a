"""Ordered ladders of conditions, roll-ups with fixed categories, shares, bars and collapsed lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(rungs: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first condition that holds; a null condition doesn't hold."""
    out = F.lit(otherwise)
    for condition, label in reversed(rungs):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def fixed_rollup(df: DataFrame, category: str, size: str, labels: Sequence[str], total: str | None = "Total") -> DataFrame:
    """position, category, n, total_size for every label in order, with zeros, and a total row."""
    per = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total_size"))
    dimension = df.sparkSession.createDataFrame(list(enumerate(labels)), "position int, category string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = F.broadcast(dimension).join(per, "category", "left").select("position", "category", zero("n"), zero("total_size"))
    if total is None:
        return out
    whole = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"))
    return out.unionByName(whole.select(F.lit(len(labels)).alias("position"), F.lit(total).alias("category"), "n", "total_size"))


def group_rollup(df: DataFrame, group: str, size: str, default: str = "Miscellaneous") -> DataFrame:
    return df.groupBy(F.coalesce(group, F.lit(default)).alias("group")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("total_size"))


def with_share(df: DataFrame, size: str, scope: Sequence[str] = ()) -> DataFrame:
    """``share``: rounded percent of the scope's total; 0 if that is 0. Meant for roll-ups, where a scope has few rows."""
    total = F.sum(size).over(Window.partitionBy(*scope))
    return df.withColumn("share", F.when(total == 0, F.lit(0)).otherwise(F.floor(100 * F.col(size) / total + 0.5)).cast("long"))


def with_bar(df: DataFrame, size: str, scope: Sequence[str]) -> DataFrame:
    """``bar``: rounded percent of the largest item of the scope. The maximum is aggregated and joined, so no scope gathers in one task."""
    top = df.groupBy(*scope).agg(F.max(size).alias("_top"))
    return df.join(top, list(scope)).withColumn("bar", F.when(F.col("_top") == 0, F.lit(0)).otherwise(F.floor(100 * F.col(size) / F.col("_top") + 0.5)).cast("long")).drop("_top")


def collapsed(df: DataFrame, scope: Sequence[str], order: str, over: int = 10, first: int = 5) -> DataFrame:
    """Scopes of more than ``over`` rows keep their ``first`` rows by ``order``; ``hidden`` says how many go."""
    counts = df.groupBy(*scope).agg(F.count("*").alias("_n"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(order))).where(F.col("_rank") <= over)
    kept = ranked.join(counts, list(scope)).where((F.col("_n") <= over) | (F.col("_rank") <= first))
    return kept.withColumn("hidden", F.when(F.col("_n") > over, F.col("_n") - first).otherwise(F.lit(0)).cast("long")).drop("_n", "_rank")
