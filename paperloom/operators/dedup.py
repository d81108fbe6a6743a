"""Hash grouping, canonical members, relinking, and what removing the copies saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: str | Column) -> Column:
    """SHA-256 over one column, or over several with their lengths, so that neighbours can't run together."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(parts) == 1:
        return F.sha2(parts[0], 256)
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def dict_text(entries: Column, skip: tuple[str, ...] = ("Length",)) -> Column:
    """Canonical text of a map<string,string>: sorted ``key=value`` entries without ``skip``."""
    kept = F.filter(F.map_entries(entries), lambda e: ~e["key"].isin(*skip))
    return F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def duplicate_groups(df: DataFrame, key: Column, id_col: str, size: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with several members: canonical (smallest id), members, and the size of the copies."""
    keyed = df.select(*scope, key.alias("digest"), F.col(id_col).alias("_id"), size.cast("long").alias("_size")).where(F.col("digest").isNotNull())
    groups = keyed.groupBy(*scope, "digest").agg(F.min("_id").alias("canonical"), F.count("*").alias("members"), F.max("_size").alias("_size"))
    return groups.where("members > 1").select(*scope, "digest", "canonical", "members", ((F.col("members") - 1) * F.col("_size")).alias("bytes_saved"))


def duplicate_map(df: DataFrame, key: Column, id_col: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """(duplicate, canonical) of every member but the smallest. Keys are grouped first, so a large group is one row when it is joined back."""
    keyed = df.select(*scope, key.alias("digest"), F.col(id_col).alias("duplicate")).where(F.col("digest").isNotNull())
    first = keyed.groupBy(*scope, "digest").agg(F.min("duplicate").alias("canonical"), F.count("*").alias("_n")).where("_n > 1")
    return keyed.join(first, [*scope, "digest"]).where("duplicate <> canonical").select(*scope, "duplicate", "canonical")


def relink(edges: DataFrame, dup_map: DataFrame, column: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Edges with ``column`` pointing at the canonical member. One hop is enough: no canonical is a duplicate."""
    target = dup_map.select(*scope, F.col("duplicate").alias(column), "canonical")
    joined = edges.join(target, [*scope, column], "left")
    return joined.select(*[F.coalesce("canonical", column).alias(c) if c == column else c for c in edges.columns])


def without_duplicates(df: DataFrame, dup_map: DataFrame, id_col: str, scope: tuple[str, ...] = ()) -> DataFrame:
    return df.join(dup_map.select(*scope, F.col("duplicate").alias(id_col)), [*scope, id_col], "left_anti")
