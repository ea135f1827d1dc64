"""Windowed aggregation of streams: state by window and key, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, window_end, keys and aggregates of a stream (or of a table, with the same rows).

    Rows later than `late` behind the newest one are dropped once their window
    is final, and its state with them; so state grows with the windows that are
    open, not with the stream.
    """
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.where(F.col(time).isNotNull()).groupBy(window.alias("_window"), *keys).agg(*aggregates)
    return out.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *[f"`{c}`" for c in out.columns[1:]])


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once, whatever copies of it arrive within `late` of each other."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Read all that has arrived, and the resulting table.

    `complete` writes the whole result at the end of each batch; `append` adds
    rows that are final.  Progress is kept in the folder, so that a query that
    runs again goes on where it was.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
