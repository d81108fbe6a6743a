"""Reports of a run, from roll-ups of a few rows a file."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from ..operators.diff import category_changes


def markdown(changes: DataFrame, stats: DataFrame, file_id: int) -> str:
    """Breakdown and pass tables of one file; ``changes`` as of :func:`file_changes`."""
    rows = changes.where(f"file_id = {int(file_id)}").orderBy("position").collect()
    lines = ["| Category | Before | After | Change |", "|---|---|---|---|"]
    lines += [f"| {r.category} | {r.before_size:,} ({r.before_n}) | {r.after_size:,} ({r.after_n}) | {r.delta:+,} |" for r in rows]
    lines += ["", "| Pass | Counter | n |", "|---|---|---|"]
    lines += [f"| {r['pass']} | {r.counter} | {r.n:,} |" for r in stats.where(f"file_id = {int(file_id)}").orderBy("pass_no", "counter").collect()]
    return "\n".join(lines)


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Category totals of files before and after, joined on the label; categories empty on both sides are left out."""
    position = before.select("file_id", "category", "position")
    key = ["file_id", "category"]
    merged = before.selectExpr("*", "concat(file_id, ':', category) as label").drop("category").withColumnRenamed("label", "category")
    other = after.selectExpr("*", "concat(file_id, ':', category) as label").drop("category").withColumnRenamed("label", "category")
    both = category_changes(merged, other).selectExpr("cast(split_part(category, ':', 1) as long) as file_id", "split_part(category, ':', 2) as category", "before_n", "before_size", "after_n", "after_size", "delta")
    return both.join(position, key)


def html(changes: DataFrame, stats: DataFrame, file_id: int, title: str) -> str:
    """A self-contained page."""
    body = "".join(f"<tr><td>{'</td><td>'.join(escape(c.strip()) for c in line.strip('|').split('|'))}</td></tr>" for line in markdown(changes, stats, file_id).splitlines() if line and not line.startswith("|---"))
    return f"<!DOCTYPE html><html lang=en><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{body}</table></html>"
