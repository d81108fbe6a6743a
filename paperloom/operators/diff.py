"""Before and after: item changes within a category, category changes, totals and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_changes(before: DataFrame, after: DataFrame, key: list[str], category: str, size: str, merged: str = "Page Content") -> DataFrame:
    """Items of positive size before, with their change in the same category: delta, or removed / stream merged. ``category_changed`` marks items that live on elsewhere."""
    same = after.select(*key, F.col(category), F.col(size).alias("after_size"))
    elsewhere = after.select(*key).distinct().withColumn("_alive", F.lit(True))
    both = before.where(F.col(size) > 0).withColumnRenamed(size, "before_size").join(same, [*key, category], "left").join(elsewhere, key, "left")
    status = F.when(F.col("after_size").isNotNull(), F.when(F.col("after_size") == F.col("before_size"), "unchanged").otherwise("changed"))
    status = status.otherwise(F.when(F.col(category) == merged, "stream merged").otherwise("removed"))
    return both.select(
        *key, category, "before_size", "after_size", (F.col("after_size") - F.col("before_size")).alias("delta"), status.alias("status"), (F.col("after_size").isNull() & F.col("_alive").isNotNull()).alias("category_changed")
    )


def category_changes(before: DataFrame, after: DataFrame, category: str = "category") -> DataFrame:
    """Roll-ups joined on their label; categories empty on both sides are left out."""
    side = lambda df, name: df.select(category, F.col("n").alias(f"{name}_n"), F.col("total_size").alias(f"{name}_size"))
    both = side(before, "before").join(side(after, "after"), category)
    return both.where("before_n > 0 or after_n > 0").withColumn("delta", F.col("after_size") - F.col("before_size"))


def saved(before: Column, after: Column) -> tuple[Column, Column]:
    """(saved bytes, saved percent in tenths, as whole numbers; 0 for empty input)."""
    gone = before - after
    return gone, F.when(before == 0, F.lit(0)).otherwise(F.floor(1000 * gone / before + 0.5)).cast("long")


def smaller_of(new: Column, old: Column, new_size: Column, old_size: Column) -> Column:
    """The size guard: the new value only if it is strictly smaller."""
    return F.when(new_size < old_size, new).otherwise(old)
