"""Frames as they arrive: the batch operators on a file stream.

A stream of frame files with one batch at a time holds no more than one batch,
like a loop over frames that frees each one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Apply ``step`` to each batch of new Parquet files and append its rows to ``out``.

    A batch repeated after a failure replaces its own folder, so every frame is
    in the output once.
    """

    def write(df: DataFrame, batch: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_moments(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    """A01 online: count, mean, deviation and extremes so far; four sums a group are the state."""
    return stream.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
