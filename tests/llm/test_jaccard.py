import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard
from paperloom.llm import textkernel as K

from .helpers import components, prose, words

SCHEMA = "doc_id long, text string"


def near(rng, text, edits):
    w = text.split()
    for i in rng.choice(len(w), edits, replace=False):
        w[i] = f"edit{rng.integers(0, 10**9)}"
    return " ".join(w)


def corpus(seed):
    rng = np.random.default_rng(seed)
    texts = [prose(rng, int(n), 5000) for n in rng.integers(1, 120, 30)]
    base = prose(rng, 140, 5000)
    passage = prose(rng, 40, 5000)
    texts += [base] * 3 + [near(rng, base, int(e)) for e in rng.integers(1, 8, 60)]
    texts += [f"{prose(rng, 12, 5000)} {passage} {prose(rng, 6, 5000)}" for _ in range(30)]
    texts += [None, "", "   \t\n", "one", "One", "two words", "é " * 6, "A b C d E", "a b c d e", passage, passage.upper()]
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows))


def test_null_ids_repeated_rows_and_extra_columns(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "cls": F.lit("x"), "component_id": F.lit(9), "token": F.lit(0)})
    got = jaccard.jaccard_components(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (3, 0, 3)], key=key)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert jaccard.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = corpus(3)
    want = {c for _, n, c in components(rows) if n} | {i for i, t in rows if not words(t)}
    kept = jaccard.drop_near_copies(spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en")))
    assert kept.columns == ["doc_id", "text", "lang"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want)


def test_keeping_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "k l m n o p"), (None, "g h i j k l"), (None, ""), (None, "")]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == sorted([("1", "a b c d e f"), ("1", "q r s t u v"), ("None", "k l m n o p"), ("None", "g h i j k l"), ("None", ""), ("None", "")])


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y"), (3, "x y"), (4, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_stay_id", "_stay_hash", "_copies", "row", "called", "text_hash", "i", "h", "a.b")})
    kept = jaccard.drop_near_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["_stay_id"], r["a.b"]) for r in kept.collect()) == [(i, "_stay_id", "a.b") for i in (1, 3, 4)]


def test_large_buckets_in_parts_and_pairs_that_pivots_leave(spark, monkeypatch):
    """Documents made of common passages: some link, most do not, and every bucket is large."""
    monkeypatch.setattr(jaccard, "PART", 5)
    rng = np.random.default_rng(12)
    passages = [prose(rng, 40, 9000) for _ in range(5)]
    texts = []
    for _ in range(90):
        some = rng.choice(5, int(rng.integers(1, 4)), replace=False)
        texts.append(" ".join([passages[i] for i in some] + [prose(rng, int(rng.integers(1, 14)), 9000)]))
    rows = list(enumerate(texts))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in jaccard.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_word_fingerprints_match_the_pattern():
    import pyarrow as pa

    texts = ["Ab  cD\x0b\x0c e\x1cf", None, "", "é É x", "z" * (3 << 20) + " y", " lead", "trail "]
    prints, first = K.words_of(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = prints[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words(t))
        for p, w in zip(own, words(t)):
            assert seen.setdefault(w, p) == p
    assert len(set(seen.values())) == len(seen)
