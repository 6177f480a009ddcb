"""Tables between the steps of a loop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Write a step to a folder that all executors share and read it back.

    Iterations stay short plans, and a lost executor repeats one step at most.
    The folder is ``spark.checkpoint.dir``, or one in the warehouse where that is unset.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    path = f"{folder.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
