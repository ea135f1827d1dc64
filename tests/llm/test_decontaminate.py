import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate as D

from .helpers import edit_distance_within, prose

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def cases(seed):
    rng = np.random.default_rng(seed)
    items = [(i, prose(rng, 14, 500)) for i in range(6)] + [(90, None), (91, "short one"), (92, "")]
    docs = []
    for d in range(40):
        text = prose(rng, 60, 500)
        item = items[d % 6][1]
        chars = list(item)
        for _ in range(d % 9):
            at = int(rng.integers(0, len(chars)))
            chars[at] = rng.choice(list("xyz")) if d % 2 else ""
        where = int(rng.integers(0, 60))
        words = text.split()
        docs.append((d, " ".join(words[:where] + ["".join(chars).upper() + "!"] + words[where:])))
    return docs + [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dynamic_programming(spark, seed):
    docs, items = cases(seed)
    got = D.find_passages(spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(5)), spark.createDataFrame(items, ITEMS)).collect()
    want = []
    for d, text in docs:
        for i, item in items:
            folded = D.fold(item or "")
            if not folded or not text:
                continue
            if len(folded) < D.MIN_CHARS:
                if f" {folded} " in f" {D.fold(text)} ":
                    want.append((d, i, 0))
                continue
            distance = edit_distance_within(folded, D.fold(text))
            if distance <= int(len(folded) * D.ERROR_RATE):
                want.append((d, i, distance))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    texts = dict(docs)
    for r in got:
        span = D.fold(texts[r.doc_id])[r.start : r.end]
        assert edit_distance_within(D.fold(dict(items)[r.item_id]), span) == r.distance


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, items = cases(3)
    df = spark.createDataFrame(docs, DOCS).withColumns({"found": F.lit(1), "text2": F.array(F.lit("x"))})
    kept = D.remove_contaminated(df, spark.createDataFrame(items, ITEMS))
    hit = {r.doc_id for r in D.find_passages(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_short_items_match_as_whole_words(spark):
    items = [(1, "What is the capital of France?"), (2, "art"), (3, "法国的首都是哪里"), (4, "x" * 31), (5, "y" * 32), (6, "?!"), (7, None)]
    docs = [(1, "Q: what is THE capital, of France"), (2, "what is the capital of frances"), (3, "start of art."), (4, "party"), (5, "问题法国的首都是哪里吗"), (6, "x" * 31), (7, "x" * 32), (8, "y" * 31), (9, None), (10, "")]
    got = D.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (3, 2, 0), (5, 3, 0), (6, 4, 0), (8, 5, 1)]


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c")], DOCS)
    assert D.find_passages(docs, none).count() == 0 and D.remove_contaminated(docs, none).count() == 1
    assert D.find_passages(spark.createDataFrame([], DOCS), none).count() == 0
