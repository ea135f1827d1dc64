"""Texts much longer than any slice, chunk or window."""

import math

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import chat, decontaminate, hmm, jaccard, langid, mixing, wrapper

from .helpers import prose

DOCS = "doc_id long, text string"


def test_word_sets_and_components(spark):
    rng = np.random.default_rng(0)
    long = prose(rng, 150_000, 10**6)
    words = long.split()
    words[::40] = ["edit"] * len(words[::40])
    rows = [(5, long), (2, " ".join(words)), (9, " ".join(words[:1000])), (7, "x" * (2 << 20)), (8, "X" * (2 << 20))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5] == (149_996, 2) and got[2][1] == 2 and got[9] == (996, 9) and got[7] == (1, 7) and got[8] == (1, 7)


def test_passage_at_the_end(spark):
    rng = np.random.default_rng(1)
    item = prose(rng, 15, 500)
    rows = [(1, prose(rng, 100_000, 500) + " " + item[:30] + "#" + item[31:])]
    got = decontaminate.find_passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert [r.item_id for r in got] == [3] and got[0].distance <= 1


def test_models(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 60, 200)) for i in range(30)] + [(99, prose(rng, 120_000, 200))]
    got = {r.doc_id: r for r in hmm.score_texts(spark.createDataFrame(rows, DOCS), F.lit(False)).collect()}
    assert got[99].n_tokens == 120_001 and math.isfinite(got[99].score)
    net = langid.train(spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y")] * 20, DOCS + ", lang string"), F.lit(True))
    labelled = langid.identify(spark.createDataFrame([(1, "ccc ddd " * 200_000)], DOCS), net).first()
    assert labelled.lang_pred == "y"


def test_mix_page_and_chat(spark):
    long = "word " * 300_000
    taken = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame([(1, long, "a"), (2, "x y", "a"), (3, "z", "b")], DOCS + ", source string")).collect()}
    assert taken[1].size == 300_000 and sum(r.taken for r in taken.values()) in range(450_002, 450_006)
    pages = [(1, "http://a.example/1", f"<article><p>{long}</p></article>"), (2, "http://a.example/2", "<article><p>short</p></article>")]
    text = {r.page_id: r.n_chars for r in wrapper.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert text == {1: len(long) - 1, 2: 5}
    turns = [(1, 1, "user", long), (1, 2, "user", "b")]
    rendered = "".join(r.rendered for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("turn", "piece").collect())
    assert rendered == f"<|user|>\n{long}\n\nb<|end|>\n<|assistant|>\n<|end|>\n"
