"""Coverage counts, traits from mark-up, and checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, has: Column, scope: list[str] = []) -> DataFrame:
    """total, with_it, without_it per scope."""
    covered = F.coalesce(has, F.lit(False))
    return df.groupBy(*scope).agg(F.count("*").alias("total"), F.count_if(covered).alias("with_it"), F.count_if(~covered).alias("without_it"))


def checklist(df: DataFrame, key: list[str], basic: dict[str, Column], standards: dict[str, Column]) -> DataFrame:
    """One row per check: pass where it holds; else fail for basic checks, neutral for standards."""
    rows = [F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status")) for name, ok in basic.items()]
    rows += [F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("neutral").alias("status")) for name, ok in standards.items()]
    return df.select(*key, F.explode(F.array(*rows)).alias("c")).select(*key, "c.check", "c.status")
