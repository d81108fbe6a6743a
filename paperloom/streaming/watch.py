"""Watching a folder: new PDF files are optimised as they arrive, each once.

Structured Streaming lists the folder and remembers what it has seen in its checkpoint; each
micro-batch runs the same plan as a batch job. Results are written per batch number, so a batch that
is run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans import passes

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Optimises what is there and what comes until it has caught up; start it again to go on. ``out`` gets files/ and stats/ in Parquet."""
    arrived = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    files = arrived.select(F.xxhash64("path").alias("file_id"), "path", F.col("content").alias("bytes"))

    def step(batch: DataFrame, number: int) -> None:
        data, stats = passes.run(batch.select("file_id", "bytes"), options)
        names = batch.select("file_id", "path")
        data.join(names, "file_id").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        stats.write.mode("overwrite").parquet(f"{out}/stats/batch={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
