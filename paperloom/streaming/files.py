"""Arriving files: the same stateless decoders on a stream of a folder. No state is kept, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming files table of what arrives in a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.xxhash64("path").alias("file_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def decode_stream(files: DataFrame, decoder, target: str, checkpoint: str, available_now: bool = True):
    """Run a decoder (such as `decode.cells`) over a files stream into Parquet; each file is decoded once."""
    writer = decoder(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
