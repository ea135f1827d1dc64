import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from paperloom.llm import decontaminate, queries, sql

from .helpers import components, prose, words

SF = "/root/testdata/sf0.001"


def test_stages_decide_as_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = [prose(rng, 60, 3000) for _ in range(60)]
    item = prose(rng, 20, 900)
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s1", 0), (101, base[1] + " more", "en", "s1", 0), (102, f"{base[2]} {item} {base[3]}", "en", "s0", 0), (103, "12 34", "en", "s0", 0), (104, None, None, None, None)]
    rows += [(200 + i, f"{base[i + 5]} scum idiot moron scum", "en", "s2", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i >= 200 else 0) for i in [*range(40), *range(200, 220)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for (name, stage), check in zip(P.STAGES, (toxic, language, copies, leaks, mixed)):
        out = stage(spark, now, str(tmp_path))
        before, after = now.collect(), out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
        check({r.doc_id: r for r in before}, {r.doc_id: r for r in after}, item)
        now = spark.createDataFrame([tuple(r)[:5] for r in after], docs.schema)


def toxic(before, after, item):
    assert not any(i >= 200 for i in after) and all(i in after for i in before if i < 200)


def language(before, after, item):
    assert 103 not in after and 104 not in after and len(after) >= 0.9 * (len(before) - 2)


def copies(before, after, item):
    want = {c for _, n, c in components([(i, r.text) for i, r in before.items()])}
    assert set(after) == want and 100 not in after and 101 not in after


def leaks(before, after, item):
    assert set(before) - set(after) == {i for i, r in before.items() if decontaminate.fold(item) in decontaminate.fold(r.text)} == {102}


def mixed(before, after, item):
    total = sum(len(words(r.text)) for r in before.values())
    assert abs(sum(r.taken for r in after.values()) - 1.5 * total) <= 12
    assert all(0 < r.taken <= 2 * r.size for r in after.values())


def test_run_and_registry(spark):
    out = P.run(spark, SF)
    assert out.count() > 50 and "taken" in out.columns
    assert set(sql.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, "plain words of a text here", None, None, None), (1, "plain words of a text here", None, None, None), (None, "other words that nobody else has", None, "s", 1), (3, None, None, "s", 1), (4, "", None, None, 1)], schema)
    odd = odd.withColumns({"_text": F.lit("t"), "row": F.lit("r"), "_edge": F.lit("e"), "score": F.lit(1), "h": F.lit(2)})
    want = {"toxicity": [None, 1, 1, 3, 4], "language": [None, 1, 1], "near_duplicates": [None, 1, 3, 4], "decontamination": [None, 1, 1, 3, 4], "mixing": [None, 1, 1]}
    for name, stage in P.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.columns[: len(odd.columns)] == odd.columns
        assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is not None, i)) == want[name], name


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
