"""Files: from disk through Spark's binary reader, or from any binary column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_SCHEMA = "file_id long, path string, size long, mtime timestamp, content binary"


def from_disk(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """files(file_id, path, size, mtime, content); columns that are not used are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def from_memory(df: DataFrame, content: str = "content", file_id: str = "file_id", path: str | None = None) -> DataFrame:
    """The same table from a binary column."""
    return df.select(F.col(file_id).cast("long").alias("file_id"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), F.octet_length(content).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.col(content).alias("content"))


def spread(files: DataFrame, bytes_per_task: int = 64 << 20) -> DataFrame:
    """Files dealt by hash into tasks of about equal bytes; decoding is the costly step, so it pays to even it out."""
    total = files.agg(F.sum("size")).first()[0] or 0
    return files.repartition(max(1, -(-int(total) // bytes_per_task)), "file_id")
