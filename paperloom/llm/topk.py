"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie in vertical layout (one row of the matrix per dimension).  Scores
accumulate block of dimensions by block; after each block a pair survives only
if its partial score plus the largest possible remainder (the product of the
remaining norms) can still reach its query's threshold, and survivors are
compacted.  Thresholds start from an exact search of a few rows and rise as
candidates pass, so every pruned pair is provably outside the top k.

Queries are taken in blocks of bounded size; each block is broadcast and meets
every candidate where it lies, so candidates are never shuffled.  A task keeps
k + 1 rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one broadcast query block, and dimensions of one step.
QUERY_BLOCK, STEP, TILE = 8192, 16, 2048
_EXACT = float(1 << 53)


def _matrix(column: pa.Array, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices of usable rows, matrix rows x dims of floor(scale * x)); short rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = column.flatten()
    flat = np.floor(np.asarray(values.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64) * scale)
    owner = np.repeat(np.arange(len(column)), length)
    usable = np.asarray(column.is_valid())
    usable[owner[~np.isfinite(flat)]] = False
    dims = int(length[usable].max(initial=0)) if dims is None else dims
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    fits = inner < dims
    out = np.zeros((len(column), dims))
    out[owner[fits], inner[fits]] = flat[fits]
    rows = np.flatnonzero(usable)
    return rows, out[rows]


def _remaining(m: np.ndarray) -> np.ndarray:
    """Norms of what is left after each step of dimensions, steps x rows."""
    square = np.add.reduceat(m * m, np.arange(0, m.shape[1], STEP), axis=1) if m.shape[1] else np.zeros((len(m), 0))
    tail = np.cumsum(square[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail[:, 1:], np.zeros((len(m), 1))], axis=1)).T * (1 + 1e-9)


class _Best:
    """The `keep` best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, keep: int, floor: np.ndarray):
        self.keep, self.floor = keep, floor.copy()
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query, vec, score):
        query, vec, score = np.concatenate([self.query, query]), np.concatenate([self.vec, vec]), np.concatenate([self.score, score])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(query)])
        place = np.arange(len(query)) - np.repeat(first, sizes)
        full = sizes >= self.keep
        last = first[full] + self.keep - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        kept = place < self.keep
        self.query, self.vec, self.score = query[kept], vec[kept], score[kept]


def _search(q: np.ndarray, q_left: np.ndarray, x: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """All of `x` (rows x dims) against all of `q`, in tiles."""
    steps = range(0, q.shape[1], STEP)
    for at in range(0, len(x), TILE):
        tile, tile_ids = x[at : at + TILE], ids[at : at + TILE]
        columns, left = np.ascontiguousarray(tile.T), _remaining(tile)
        dense = np.zeros((len(q), len(tile)))
        pairs = None
        for k, d in enumerate(steps):
            if pairs is None:
                dense += q[:, d : d + STEP] @ columns[d : d + STEP]
                alive = dense + q_left[k][:, None] * left[k][None, :] + 1e-6 >= best.floor[:, None]
                if k + 1 == len(steps) or np.count_nonzero(alive) * 16 < alive.size:
                    a, b = np.nonzero(alive)
                    pairs = (a, b, dense[a, b])
            else:
                a, b, s = pairs
                s = s + np.einsum("ij,ij->i", q[a, d : d + STEP], tile[b, d : d + STEP])
                go = s + q_left[k][a] * left[k][b] + 1e-6 >= best.floor[a]
                pairs = (a[go], b[go], s[go])
        if pairs is None:  # vectors without dimensions: every score is 0
            a, b = np.nonzero(dense >= best.floor[:, None])
            pairs = (a, b, dense[a, b])
        best.add(pairs[0], tile_ids[pairs[1]], pairs[2])


def _exact_ints(q: np.ndarray, x: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """For components so large that doubles would round: Python integers, clamped to longs."""
    whole = [[int(v) for v in row] for row in x]
    for i, row in enumerate(q):
        a = [int(v) for v in row]
        scores = [min(max(sum(u * v for u, v in zip(a, b)), -(1 << 63)), (1 << 63) - 1) for b in whole]
        order = sorted(range(len(whole)), key=lambda j: (-scores[j], ids[j]))[: best.keep]
        best.exact.setdefault(i, []).extend((scores[j], int(ids[j])) for j in order)
        best.exact[i] = sorted(best.exact[i], key=lambda t: (-t[0], t[1]))[: best.keep]


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col="vec_id", vector_col="embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products.

    Components are floor(scale * x).  A query's candidates are all rows but
    itself; ties go to the smaller id.  Rows with a null id, a null vector or
    a null or non-finite component take no part.  Vectors of other lengths
    compare over the common leading dimensions.  A row that occurs twice is
    two candidates; as a query it is answered once for each occurrence.
    Scores beyond a long are clamped to it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    n_queries = rows.where("q").count()
    blocks = max(1, -(-n_queries // block))
    out = None
    for b in range(blocks):
        # Rows of a block are bounded: ids are dealt by hash, and equal ids are few by the nature of an id.
        part = rows.where("q").where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v").toArrow()
        at, q = _matrix(part.column("v"), scale)
        ids = np.asarray(part.column("vec_id"), dtype=np.int64)[at]
        found = _one_block(spark, rows.select("vec_id", "v"), ids, q, k, scale)
        out = found if out is None else out.unionByName(found)
    return out


def _one_block(spark, rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, scale: int) -> DataFrame:
    dims, keep = q.shape[1], k + 1
    order = np.argsort(-np.abs(q).sum(axis=0), kind="stable") if len(q) else np.arange(dims)
    q = np.ascontiguousarray(q[:, order])
    seed = _Best(len(q), keep, np.full(len(q), -np.inf))
    top = float(np.abs(q).max(initial=0))
    safe = top * top * max(dims, 1) < _EXACT
    if safe:
        _search(q, _remaining(q), q[:2048], ids[:2048], seed)
    shared = spark.sparkContext.broadcast((q, order, seed.floor))

    def scan(batches):
        q, order, floor = shared.value
        left, top = _remaining(q), float(np.abs(q).max(initial=0))
        best = _Best(len(q), keep, floor)
        best.exact = {}
        for batch in batches:
            at, x = _matrix(batch.column(1), scale, len(order))
            ids = np.asarray(batch.column(0), dtype=np.int64)[at]
            x = x[:, order]
            if top * float(np.abs(x).max(initial=0)) * max(len(order), 1) < _EXACT:
                _search(q, left, x, ids, best)
            else:
                _exact_ints(q, x, ids, best)
        query = np.r_[best.query, np.array([i for i, got in best.exact.items() for _ in got], dtype=np.int64)]
        vec = np.r_[best.vec, np.array([v for got in best.exact.values() for _, v in got], dtype=np.int64)]
        score = np.array([int(s) for s in best.score] + [s for got in best.exact.values() for s, _ in got], dtype=np.int64)
        for i in range(0, len(query), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000].astype(np.int64)) for a in (query, vec, score)], names=["qi", "vec_id", "score"])

    def norm(row):
        return min(sum(int(v) * int(v) for v in row), (1 << 63) - 1)

    found = rows.mapInArrow(scan, "qi long, vec_id long, score long")
    own = spark.createDataFrame([(int(i), int(v), norm(r)) for i, (v, r) in enumerate(zip(ids, q))], "qi long, query_id long, own long")
    by_score = Window.partitionBy("qi").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= keep)
    # Of the k + 1 best, the query's own row goes; if it is not among them, the last one does.
    best = best.join(F.broadcast(own), "qi")
    is_self = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    own_place = F.min(F.when(is_self, F.col("place"))).over(Window.partitionBy("qi"))
    best = best.withColumn("gone", F.coalesce(own_place, F.lit(keep + 1))).where(F.col("place") != F.col("gone"))
    rank = F.when(F.col("place") > F.col("gone"), F.col("place") - 1).otherwise(F.col("place"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
