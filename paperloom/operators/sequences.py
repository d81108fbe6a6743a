"""Carried state as windows: last value carried forward, and running codes that numbers reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, value: Column, scope: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the last non-null value at or before each row of the scope."""
    window = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def running_codes(df: DataFrame, reset: Column, scope: list[str], order: list[str]) -> DataFrame:
    """Rows with a non-null ``reset`` start a run at that number; each other row takes the next code, from 0 where no number came yet."""
    upto = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_reset", reset).withColumn("_run", F.count("_reset").over(upto)).withColumn("_base", F.coalesce(F.last("_reset", ignorenulls=True).over(upto), F.lit(0)))
    in_run = Window.partitionBy(*scope, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.sum(F.when(F.col("_reset").isNull(), 1).otherwise(0)).over(in_run)
    out = marked.withColumn("code", F.when(F.col("_reset").isNull(), F.col("_base") + named - 1).cast("long"))
    return out.where("_reset is null").drop("_reset", "_run", "_base")
