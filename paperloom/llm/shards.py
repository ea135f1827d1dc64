"""Distributed counting of 64-bit keys, with the totals sent back to where the keys came from.

A chunk is a bounded group of rows with its sorted distinct keys.  Its keys
are cut into shards by value; a shard adds up the weights of all chunks and
replies to each with totals in the order of the keys it sent.  Both shuffles
move arrays, not rows; the reply of a key's shard is as long as the question,
so a frequent key costs no more than a rare one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean

REPLY_SCHEMA = "chunk long, shard int, totals binary"


#: A shard is concatenated and sorted in one task, which takes a few times this many bytes.
SHARD_BYTES = 64 << 20


def shard_count(df: DataFrame, n_bytes: int) -> int:
    """Shards for so many bytes of keys: SHARD_BYTES each at most, and no fewer than the session has shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))


def bounds(n: int) -> np.ndarray:
    """Lower ends of n equal ranges of 64-bit keys."""
    return np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)


def count_and_reply(chunks: DataFrame, n_shards: int) -> DataFrame:
    """Rows (chunk, values): uint64 values as a binary, whose sorted distinct ones are the chunk's keys.

    A key weighs as often as it occurs.  Returns one row per chunk and shard
    that met: `totals`, int64, aligned with the chunk's keys in that shard.
    Replies of a chunk in shard order line up with its keys.
    """
    lower = bounds(n_shards)

    def split(batches):
        for batch in batches:
            for chunk, values in zip(batch.column(0), batch.column(1)):
                k, w = np.unique(np.frombuffer(values.as_buffer(), dtype=np.uint64), return_counts=True)
                cut = np.r_[np.searchsorted(k, lower), len(k)]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), chunk.as_py(), dtype=np.int64)),
                        pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([w[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                    ],
                    names=["shard", "chunk", "keys", "weights"],
                )

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("keys")]
        keys = np.concatenate(parts)
        weights = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column("weights")])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        sums = np.add.reduceat(weights[order], np.flatnonzero(new))
        totals = np.empty(len(keys), dtype=np.int64)
        totals[order] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "shard": table.column("shard"),
                "totals": pa.array([totals[e - len(p) : e].tobytes() for p, e in zip(parts, ends)], pa.binary()),
            }
        )

    pieces = chunks.select("chunk", "values").mapInArrow(lean(split), "shard int, chunk long, keys binary, weights binary")
    return pieces.groupBy("shard").applyInArrow(count, REPLY_SCHEMA)


def in_key_order(replies: pa.Table) -> np.ndarray:
    """Totals of one chunk, aligned with its keys."""
    order = np.argsort(np.asarray(replies.column("shard")), kind="stable")
    parts = replies.column("totals").to_pylist()
    return np.concatenate([np.frombuffer(parts[i], dtype=np.int64) for i in order]) if parts else np.zeros(0, np.int64)
