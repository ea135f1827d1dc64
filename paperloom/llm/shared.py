"""Shared-folder helpers: what one task writes here, every executor and the driver can read."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where it is unset, a temporary folder, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="paperloom-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Run `df` now and cut its lineage; the rows are in the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, with its memory given back at the end: workers wait for their next task as small as they began."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


#: Rows and bytes of one Arrow batch between Spark and Python; texts are long, so the defaults hold tens of MB a task.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes where they are larger."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_map(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit map of the hashes in column `h`, of 16 bits a row up to 2**27 bits, and the number of its bits.

    It only thins what is sent to a join; false hits end there.
    """
    bits = 1 << min(27, max(16, (16 * hashes.count()).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits))
    cells = hashes.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) & 63 AS int))")).alias("word")).toArrow()
    words = np.zeros(bits >> 6, dtype=np.int64)
    words[np.asarray(cells.column("cell"))] = np.asarray(cells.column("word"))
    return words, bits


def called_for(hashes: DataFrame) -> Callable[[Column], Column]:
    """Column function: whether the bit map of the hashes in column `h` has this hash; at most 16 MB travel."""
    words, bits = bit_map(hashes)
    told = hashes.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def called(h: pa.Array) -> pa.Array:
        place = np.asarray(h) % bits
        return pa.array((told.value[place >> 6] >> (place & 63)) & 1 == 1)

    return called
