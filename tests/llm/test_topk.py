import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(ok):
        if q % 20:
            continue
        scored = sorted((-min(sum(x * y for x, y in zip(u, v)), 2**63 - 1), c) for b, (c, v) in enumerate(ok) if b != a)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=20, block=topk.QUERY_BLOCK):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "rank": F.lit(2), "v": F.lit(3), "q": F.lit(1)})
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, block=block)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, k)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=37))], 0) for i in rng.permutation(400)]
    rows += [(1000 + i, [1.0] * 37, 0) for i in range(60)]
    check(spark, rows)
    check(spark, rows, k=3, block=7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (20, [], 1), (5, [], 1), (6, [3.0], 1), (7, [1.0, 2.0, 9.0], 1), (None, [1.0, 1.0], 1), (40, [-1.0, -2.0], 1), (0, [1.0, 2.0], 1), (8, [1e15, 1e15], 1)]
    check(spark, rows, k=4)


def test_fewer_candidates_and_empty(spark):
    check(spark, [(0, [1.0], 0), (1, [2.0], 0)])
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
