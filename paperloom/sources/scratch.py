"""A folder that all nodes share, for results of streams and other intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's name below the cluster's `spark.checkpoint.dir`; where it is unset, a temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isEmpty():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    return f"{base.rstrip('/')}/paperloom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df`, run now, as a table in a scratch folder."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
