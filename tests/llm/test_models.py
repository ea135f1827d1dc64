import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import hmm, langid, toxicity

from .helpers import words

SCHEMA = "doc_id long, text string, lang string, source string"
LANGS = {"aa": "the of and to in is that it for was".split(), "bb": "der die und das ist nicht ein zu mit für".split(), "cc": "el la que de los se las por un para".split()}


def corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        stem = LANGS[lang]
        rows.append((i, " ".join(stem[int(rng.integers(0, 10))] + ("" if rng.random() < 0.6 else stem[int(rng.integers(0, 10))]) for _ in range(int(rng.integers(5, 60)))), lang, "s"))
    return rows + [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 34 !", "cc", "s"), (None, "the of and", None, None), (5, rows[5][1], "cc", "s")]


def test_scores_of_the_language_model(spark):
    rows = corpus()
    got = hmm.score_texts(spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "codes": F.lit(2)}), langid.in_fold(F.col("doc_id"), 7, 2)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for i, t, *_ in rows:
        if not held(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted(((-1 if i is None else i), held(i), len(words(t)) + 1, sum(w in count for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t, *_ in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_are_plain_forward_probabilities(spark, monkeypatch):
    """The query's score, recomputed word by word from the learned model with counts made here."""
    import pyarrow as pa

    from paperloom.llm import textkernel as K

    seen, fit = [], hmm._fit
    monkeypatch.setattr(hmm, "_fit", lambda *a: seen.append((a[1], fit(*a))) or seen[-1][1])
    rows = corpus(60, seed=5) + [(2000, "zzz unseen qqq", None, None)]
    held = langid.in_fold(F.col("doc_id"), 7, 2)
    got = {}
    for r in hmm.score_texts(spark.createDataFrame(rows, SCHEMA), held, n_words=20, rounds=3).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    classes, (model, _) = seen[0]
    count = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update([*words(t), None])

    def class_of(word):
        if word is None:
            return int(classes.of(np.array([hmm.END]), np.array([0], np.uint16))[0])
        data, offsets = K.text_buffers(pa.array([word]))
        starts, ends = K.word_spans(data, offsets)
        return int(classes.of(K.fingerprints(data, starts, ends), hmm._shapes(data, starts, ends))[0])

    own = len(classes.own)
    assert own == 20
    tokens, kinds = Counter(), Counter()
    for word, n in count.items():
        tokens[class_of(word)] += n
        kinds[class_of(word)] += 1
    for i, t, *_ in rows:
        total, alpha = 0.0, None
        for word in [*words(t), None]:
            c = class_of(word)
            alpha = model.emit[c] * (model.start if alpha is None else alpha @ model.move)
            total += math.log10(alpha.sum()) + (0 if c < own else math.log10((count[word] + 1) / (tokens[c] + kinds[c] + 1)))
            alpha = alpha / alpha.sum()
        assert min(abs(total - s) for s in got[i]) < 1e-6


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    emit = rng.random((5, 3))
    move = rng.random((3, 3))
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sizes = np.array([4, 1, 3])
    symbols = rng.integers(0, 5, 8)
    got = hmm.log10_likelihood(symbols, sizes, model)
    at = 0
    for size, value in zip(sizes, got):
        total = 0.0
        seq = symbols[at : at + size]
        for path in np.ndindex(*[3] * size):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= model.move[a, b] * model.emit[s, b]
            total += p
        assert value == pytest.approx(math.log10(total))
        at += size


def test_rounds_do_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    symbols, sizes = rng.integers(0, 6, 600) // (1 + np.arange(600) // 300), np.full(20, 30)
    emit = rng.random((6, 2))
    model, background, last = hmm.Model(np.array([0.5, 0.5]), np.array([[0.8, 0.2], [0.2, 0.8]]), emit / emit.sum(axis=0)), np.full(6, 1e-9), -np.inf
    for _ in range(8):
        now = hmm.log10_likelihood(symbols, sizes, model).sum()
        assert now >= last - 0.5
        last, model = now, hmm.Model.from_counts(*hmm.expected_counts(symbols, sizes, np.ones(20, bool), model, 6), background)


def test_rounds_read_whole_sequences():
    """The end of a long text trains the model like its beginning, and as one sequence."""
    rng = np.random.default_rng(4)
    docs = [np.r_[rng.integers(0, 3, 3000), rng.integers(3, 6, 2000)], rng.integers(0, 6, 40), rng.integers(0, 6, 7)]
    sizes = np.array([len(d) for d in docs])
    row = {"sizes": sizes.tobytes(), "classes": hmm._press_classes(np.concatenate(docs)), "held": [False, True, False]}
    got = sorted((part.tolist() for symbols, n in hmm._sequences([row]) for part in np.split(symbols, np.cumsum(n)[:-1])), key=len)
    assert got == [docs[2].tolist(), docs[0].tolist()]


def test_rounds_go_on_until_the_likelihood_settles(spark, monkeypatch):
    seen, fit = [], hmm._fit
    monkeypatch.setattr(hmm, "_fit", lambda *a: seen.append(fit(*a)) or seen[-1])
    hmm.score_texts(spark.createDataFrame(corpus(60), SCHEMA), F.lit(False))
    gains = np.diff(seen[0][1])
    assert len(gains) >= 2 and (gains[-2:] < hmm.SETTLED).all() and seen[0][1][-1] > seen[0][1][0]


def test_model_on_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hmm.score_texts(empty, F.lit(False)).count() == 0
    only = hmm.score_texts(spark.createDataFrame([(1, "a b", "x", "s")], SCHEMA), F.lit(True)).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and only[0].base_score == 0


def test_language_gradients():
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b"], hidden=3, embed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(97, 103, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    grad, _ = net.gradients(x, y, w)
    for name in ("E", "Wf", "Ub", "Vf", "bb", "c"):
        for at in list(np.ndindex(net.p[name].shape))[:: max(1, net.p[name].size // 7)]:
            if name == "E" and at[0] not in x:
                continue
            keep, h = net.p[name][at], 1e-4
            losses = []
            for d in (h, -h):
                net.p[name][at] = keep + d
                losses.append(net.gradients(x, y, w)[1])
            net.p[name][at] = keep
            assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * h), abs=2e-5)


def test_languages_of_held_out_texts(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).withColumn("score", F.lit(2))
    held = langid.in_fold(F.col("doc_id"), 3, 1)
    net = langid.train(df, ~held)
    got = langid.identify(df, net, keep=["lang"]).withColumn("held", held).collect()
    assert len(got) == 245
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und"
    out = [r for r in got if r.held and r.doc_id not in (1000, 1001, 1002, 5) and r.lang]
    assert len(out) > 40 and sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_language_of_long_texts_and_nothing_learned(spark):
    net = langid.train(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert net.languages == []
    rows = langid.identify(spark.createDataFrame([(1, "abc", "x", "s")], SCHEMA), net).collect()
    assert (rows[0].lang_pred, rows[0].score) == ("und", 0.0)
    assert langid.identify(spark.createDataFrame([], SCHEMA), net).count() == 0
    long = langid.Network(["a", "b"])
    import pyarrow as pa

    p = langid.pooled(pa.array(["é" * 400_000, "x", None]), long)
    assert p.shape == (3, 2) and np.allclose(p.sum(axis=1), 1)


def plain_pass(net, text):
    """Document probabilities by one recurrence from the text's start to its end and one back, position by position."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, order):
        h, out, H = np.zeros(net.hidden), {}, net.hidden
        for t in order:
            a, g = net.p[f"W{d}"] @ net.p["E"][data[t]] + net.p[f"b{d}"][:, 0], net.p[f"U{d}"] @ h
            z, r = sigmoid(a[:H] + g[:H]), sigmoid(a[H : 2 * H] + g[H : 2 * H])
            h = out[t] = (1 - z) * np.tanh(a[2 * H :] + r * g[2 * H :]) + z * h
        return out

    f, b = states("f", range(len(data))), states("b", range(len(data) - 1, -1, -1))
    total, letters = np.zeros(len(net.languages)), 0
    for t, byte in enumerate(data):
        if byte >= 128 or chr(byte).isalpha():
            logits = net.p["Vf"] @ f[t] + net.p["Vb"] @ b[t] + net.p["c"][:, 0]
            total += logits - np.log(np.exp(logits).sum())
            letters += 1
    e = np.exp(total / max(letters, 1))
    return e / e.sum()


@pytest.mark.parametrize("memory", [0.0, 6.0])
def test_pooled_equals_a_plain_pass(memory):
    """Also for a network that forgets nothing within a segment (an update gate near one)."""
    import pyarrow as pa

    net = langid.Network(["a", "b", "c"], seed=3)
    for d in "fb":
        net.p[f"b{d}"][: net.hidden] += memory
    rng = np.random.default_rng(8)
    texts = ["", "x", None, "Größe 12 " * 9, "a" * langid.SEGMENT, "B" * (langid.SEGMENT + 1), "é" * (langid.SEGMENT + langid.WARM // 2)]
    texts += ["".join(rng.choice(list("aBcdé x1."), int(n))) for n in rng.integers(1, 3000, 12)]
    got = langid.pooled(pa.array(texts, pa.string()), net)
    for text, p in zip(texts, got):
        assert p == pytest.approx(plain_pass(net, text or ""), abs=2e-3)


def test_nothing_learned_drops_nothing_with_letters(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s"), (2, "12", None, "s"), (3, None, None, "s"), (1, "abc", None, "s")], SCHEMA)
    assert [r.doc_id for r in langid.drop_undetermined(docs, langid.Network([])).collect()] == [1, 1]


def toxic_corpus(seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(300):
        w = [f"word{int(k)}" for k in rng.integers(0, 400, int(rng.integers(20, 80)))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(2, len(w) // 12)):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["idiot", "grobian", "grobiane", "scum"])))
        elif i % 17 == 0:
            w.insert(3, "grobian")
        rows.append((i, " ".join(w), None, None))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = toxic_corpus()
    rows += [(900, "You 1D10T, you ϲcum! Ídiot", None, None), (901, None, None, None), (902, "", None, None), (903, "plain " * 50000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(5), "toxic": F.lit("x")}).drop("toxic")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, lab.where(~langid.in_fold(F.col("doc_id"), 3, 1)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(truth[i]) for i in held) >= 0.95 * len(held)
    assert got[900] >= 0.7 and max(got[901], got[902], got[903]) < 0.5


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T").strip() == toxicity.fold("idiot").strip()
    assert toxicity.fold("іdіоt").strip() == toxicity.fold("IDIOT").strip()
    lex = toxicity.Lexicon({toxicity.fold("loser").strip(): 2.0}, [toxicity.fold("sore loser").strip()], (-1, 2, 0))
    assert len(lex.matches("a loser and a sore loser, losers")) == 2
    assert lex.matches("closer") == [] and lex.matches("") == []


def brute_matches(lexicon, text):
    """Longest entry at every word's beginning, by trying all, outside of exception phrases; strong entries match bare letters too."""
    folded = toxicity.fold(text)
    bare = folded.translate(toxicity._bare_table())
    spared = [range(i, i + len(p) + 1) for p in lexicon.exceptions for shown in (folded, bare) for i in range(len(shown)) if shown.startswith(f" {p} ", i)]
    out = []
    for i, c in enumerate(folded):
        if c != " ":
            continue
        own = [(len(t), w) for t, w in lexicon.terms.items() if folded.startswith(t, i + 1) or w >= toxicity.STRONG and bare.startswith(t, i + 1)]
        if own and not any(i in s for s in spared):
            out.append((i + 1, i + 1 + max(own)[0], max(own)[1]))
    return out


def test_matches_equal_trying_every_place():
    rng = np.random.default_rng(9)
    lexicon = toxicity.Lexicon({"aba": 1.0, "abab": 6.0, "cab": 2.0, "bac": 5.5}, ["abab bac", "x cab", "cab"])
    for _ in range(300):
        text = "".join(rng.choice(list("aabbccx  á4"), int(rng.integers(0, 60))))
        assert lexicon.matches(text) == brute_matches(lexicon, text)


def test_many_matches_and_exceptions_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({"bad": 1.0}, [toxicity.fold("bad luck").strip()])
    start = time.perf_counter()
    assert len(lexicon.matches("bad luck bad " * 40_000)) == 40_000
    assert time.perf_counter() - start < 5


def test_rare_and_long_entries_and_letters_beyond_the_first_plane(spark):
    rng = np.random.default_rng(10)
    rare = [f"slur{w * 4}" for w in "qxzjkwv"]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 2
        words = [f"word{int(k)}" for k in rng.integers(0, 300, 30)]
        rows.append((i, " ".join(words + ([rare[i // 2 % 7]] * 2 + ["bonehead"] if toxic and i < 70 else ["bonehead"] * 2 if toxic else [])), None, None))
        labels.append((i, toxic))
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(lexicon.matches(w) for w in rare)  # each in under one percent of the toxic documents
    assert toxicity.fold("\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d") == toxicity.fold("idiot")


def test_equal_texts_with_both_labels_are_toxic(spark):
    docs = [(i, f"{'grobian grobian' if i % 2 else 'fine'} text {i // 4}", None, None) for i in range(400)]
    labels = [(i, int(i % 4 == 1)) for i in range(400)]  # of each pair of toxic copies one is labelled clean
    learned = [toxicity.learn(spark.createDataFrame(docs, SCHEMA).repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int")) for n in (1, 5)]
    assert learned[0].terms == learned[1].terms and learned[0].matches("grobian")


def test_drop_toxic_keeps_columns_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None, "a", "s"), (2, "", "a", "s"), (3, "you idiot moron scum", "a", "s"), (3, "plain", "a", "s"), (3, "plain", "a", "s")], SCHEMA).withColumns({"score": F.lit(1), "_text": F.lit("x")})
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3]
    assert toxicity.drop_toxic(docs.limit(0), lexicon).count() == 0


def test_lexicon_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(spark.createDataFrame([(1, "x", None, None)], SCHEMA), none)
    rows = toxicity.score(spark.createDataFrame([(1, "you idiot moron", None, None), (2, "fine day", None, None)], SCHEMA), lexicon).collect()
    assert rows[0].score > rows[1].score
    assert toxicity.score(spark.createDataFrame([], SCHEMA), lexicon).count() == 0
