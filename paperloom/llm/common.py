"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, join_small, shared_dir, table  # noqa: F401  for the operators

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def release() -> None:
    """What this Python worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(batches: Iterator) -> Iterator:
    """The batches; then what the task leaves behind goes back to the system, since Python workers outlive tasks and stages. Code that came by value is in reference cycles."""
    yield from batches
    gc.collect()
    release()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, leaving no memory behind."""
    return df.mapInArrow(lambda batches: released(f(batches)), schema)


def map_groups(df: DataFrame, key: str, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``df.groupBy(key).applyInArrow``; no group leaves memory behind, as none knows whether it is its task's last."""

    def one(group: pa.Table) -> pa.Table:
        out = f(group)
        del group
        release()
        return out

    return df.groupBy(key).applyInArrow(one, schema)


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over the whole table; sizes the number of buckets, never what is processed."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def free_name(df: DataFrame) -> str:
    """A column name that ``df`` doesn't have."""
    name = "found"
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
