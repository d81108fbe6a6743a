"""Session settings, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def session(name: str = "paperloom", **settings: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; anything else comes from the cluster or ``settings``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; a cluster has to name its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; later jobs read it from there, whichever executors are left."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, in columns: later jobs read only those that they use, where a checkpoint is read whole."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a computed table: broadcast only if a count shows that it has at most ``max_rows`` rows, else by a shuffle, of which AQE splits skewed keys."""
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small.hint("shuffle_merge"), on, how)
