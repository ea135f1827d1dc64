from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import mixing

from .helpers import prose, words

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    open_, rest = set(names), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        give, rest = rest, 0.0
        for s in sorted(open_, key=str):
            out[s] += give * weight[s] / total
        for s in list(open_):
            if out[s] >= cap * sizes[s]:
                rest += out[s] - cap * sizes[s]
                out[s] = float(cap * sizes[s])
                open_.discard(s)
    return out


def check(spark, rows, slack=1):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("x"), "hash": F.lit("y"), "target": F.lit(0)})
    got = mixing.mix_sources(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(dict(sizes))
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack
    return got


def test_targets_and_budgets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, int(rng.integers(1, 200))), f"s{int(rng.zipf(1.6)) % 7}") for i in range(600)]
    rows += [(1000 + i, prose(rng, 20), None) for i in range(30)] + [(2000, None, "s1"), (2001, "", None), (2002, "  ", "é")]
    first = check(spark, rows)
    again = check(spark, list(reversed(rows)))
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_null_ids_and_repeated_rows(spark):
    check(spark, [(None, f"a{i} b c", "x") for i in range(50)] + [(5, "d e", "x")] * 2 + [(6, "f", "y")], slack=2)
    # Repeated rows share alike, each rounded down by less than a word.
    check(spark, [(None, "a b c", "x")] * 50 + [(5, "d e", "x")] * 9 + [(6, "f", "y")], slack=51)


def test_one_source_and_empty(spark):
    check(spark, [(i, "a b c d", "only") for i in range(10)])
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = mixing.mix_documents(spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], SCHEMA).withColumn("taken", F.lit("old")))
    assert [(r.doc_id, r.taken) for r in kept.collect()] == [(1, 3)]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", None), (2, "d", None), (3, None, "x"), (4, "", "y")], "doc_id long, text string, source string")
    docs = docs.withColumns({"_edge": F.lit("e"), "hash": F.lit("h"), "row": F.lit("r"), "a.b": F.lit("d"), "taken": F.lit("old"), "_of": F.lit(1), "number": F.lit(2)})
    got = mixing.mix_documents(docs)
    assert got.columns == ["doc_id", "text", "source", "_edge", "hash", "row", "a.b", "_of", "number", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert {(r["_edge"], r["hash"], r["a.b"]) for r in rows} == {("e", "h", "d")} and {r.doc_id for r in rows} <= {1, 2}
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_many_sources_are_numbered_and_levelled(spark):
    rows = [(i, "w " * (i % 37), f"s{i:04d}" if i else None) for i in range(1500)]
    got = mixing.source_targets(spark.createDataFrame([(r[2], len(r[1]) // 2) for r in rows], "source string, size long"), (3, 1, 2), 1.5, 2).collect()
    ordered = sorted(rows, key=lambda r: (r[2] is None, r[2] or ""))
    weight = {r[2]: (3, 1, 2)[n % 3] for n, r in enumerate(ordered)}
    size = {r[2]: len(r[1]) // 2 for r in rows}
    low, high, total = 0.0, 1e6, 1.5 * sum(size.values())
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], weight[s] * level) for s in size) < total else (low, level)
    assert all(abs(r.target - min(2 * size[r.source], weight[r.source] * level)) < 1e-6 for r in got) and len(got) == 1500
