"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: letters lose case, look-alike letters of other scripts
and digit substitutions become plain letters (i, l and 1 are one letter),
everything else ends a word.  Accents tell words apart in many languages, so
they stay; entries of weight STRONG or more match the bare letters as well.  Lexicon entries are word beginnings with
a weight, the log ratio of their rates in toxic and clean words; a match inside
an exception phrase does not count.  A document's summed weight is normalised
by its length in a logistic score.

Weights, exceptions and the normalisation are learned from labelled documents,
at most about `POSITIVES` toxic and `NEGATIVES` clean ones drawn by the hash of
their ids.  Of their word beginnings of `SHORTEST` to `LONGEST` letters all those
enter that are significantly more frequent in toxic text: a likelihood ratio of
`SIGNIFICANT` at least, a rate `RATIO` times that of clean text, in `SUPPORT`
documents at least; a document counts `PER_DOC` occurrences at most, so that one
text cannot make an entry.  `SEED_TERMS` enter with a prior weight.  Scoring is
one pass.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialise

POSITIVES, NEGATIVES = 4000, 8000
SHORTEST, LONGEST, PER_DOC = 3, 32, 6
SUPPORT, RATIO, SIGNIFICANT = 3, 6.0, 25.0
SEED_TERMS = ("idiot", "stupid", "moron", "loser", "scum", "imbecile", "worthless", "pathetic", "disgusting")
#: Phrases in which a seed term is harmless.
SEED_EXCEPTIONS = ("sore loser",)
_SEED_OCCURRENCES, STRONG = 2.0, 5.0

#: Look-alikes: each group of characters reads as the letter before it.
_LOOKALIKES = {
    "a": "4@аαɑ", "b": "8вβ", "c": "сϲ", "d": "ԁ", "e": "3еєε", "g": "ɡ", "h": "һн", "i": "1lіıιӏ", "j": "ј", "k": "кκ",
    "m": "м", "n": "п", "o": "0оοσօ", "p": "рρ", "r": "г", "s": "5$ѕ", "t": "7тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "2ᴢ",
}


@lru_cache(maxsize=1)
def _fold_table() -> dict:
    table: dict[int, str | None] = {}
    for code in (*range(0x20000), *range(0xE0000, 0xE0200)):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        base = "".join(c for c in plain if not unicodedata.combining(c))
        if not base and (unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf"):
            table[code] = None
        elif not any(c.isalnum() for c in base):
            table[code] = None if unicodedata.category(chr(code)) in ("Cf", "Mn") else " "
        elif len(base) == 1 and len(plain) > 1:
            table[code] = chr(code).lower()  # an accent tells words apart
        elif base != chr(code):
            table[code] = base
    for letter, group in _LOOKALIKES.items():
        for c in group + letter:
            for form in {c, c.upper()}:
                if len(form) == 1:
                    table[ord(form)] = letter
    for code, text in list(table.items()):  # what decomposes to a look-alike reads as its letter too
        if text and len(text) == 1 and ord(text) in table and table[ord(text)] not in (None, " "):
            table[code] = table[ord(text)]
    return {k: v for k, v in table.items() if v != chr(k)}


@lru_cache(maxsize=1)
def _bare_table() -> dict:
    """Accented letters to bare ones, character by character."""
    table = {}
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            table[code] = _fold_table().get(ord(base), base)
    return table


def fold(text: str) -> str:
    """Folded text with a space at both ends."""
    return f" {text.translate(_fold_table())} "


def _starts(folded: str):
    """Beginnings of all words, with repetition: SHORTEST to LONGEST letters."""
    for word in folded.split():
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            yield word[:n]


class Lexicon:
    """terms: word beginning to weight; exceptions: whole folded phrases; logistic coefficients."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], coefficients=(0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.coefficients = terms, exceptions, tuple(coefficients)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        a.make_automaton()
        return a

    def matches(self, text: str, automaton=None) -> list[tuple[int, int, float]]:
        """(start, end, weight) in folded text of the matches that count; one for each word."""
        a = automaton or self.automaton()
        if not len(a):
            return []
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        folded = fold(text)
        bare = folded if folded.isascii() else folded.translate(_bare_table())
        for shown, least in ((folded, -1.0), (bare, STRONG)):
            if least > 0 and shown == folded:
                break
            for last, (length, weight) in a.iter(shown):
                start = last - length + 1
                if weight is None:
                    spared.append((start, last))
                elif weight >= least and (start not in found or found[start][0] < length):
                    found[start] = (length, weight)
        out, at, until = [], 0, -1
        spared.sort()
        for start, (length, weight) in sorted(found.items()):
            while at < len(spared) and spared[at][0] <= start:
                until = max(until, spared[at][1])
                at += 1
            if start >= until:
                out.append((start + 1, start + length, weight))
        return out

    def features(self, text: str, automaton=None) -> tuple[float, int, int]:
        """(sum of weights, matches, words) of a text."""
        got = self.matches(text, automaton)
        return sum(w for _, _, w in got), len(got), len(text.split())

    def score(self, total: float, words: int) -> float:
        bias, slope, length = self.coefficients
        z = bias + slope * math.log1p(total) + length * math.log1p(words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _counted(sample: DataFrame) -> DataFrame:
    """(term, docs, occ, against): documents and occurrences in toxic texts, and occurrences in clean ones, of all word beginnings; PER_DOC at most of a document."""

    def run(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term, n in Counter(_starts(fold(text))).items():
                    own = sums.setdefault(term, [0, 0, 0])
                    if toxic:
                        own[0] += 1
                        own[1] += min(n, PER_DOC)
                    else:
                        own[2] += min(n, PER_DOC)
                if len(sums) > 200_000:
                    yield emit(sums)
                    sums.clear()
        yield emit(sums)

    def emit(sums):
        columns = zip(*sums.values()) if sums else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["term", "docs", "occ", "against"])

    counted = sample.select("text", "toxic").mapInArrow(lean(run), "term string, docs long, occ long, against long")
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("docs", "occ", "against")])


def _significant(counted: DataFrame, words_pos: float, words_neg: float) -> DataFrame:
    """(term, weight, ratio) of the terms that tell toxic text: log rate ratio, and likelihood ratio of two Poisson rates."""
    a, b = F.col("occ").cast("double"), F.col("against").cast("double")
    p = (a + b) / (words_pos + words_neg)
    term = lambda k, n: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    told = counted.select("term", "docs", F.log(((a + 0.5) / words_pos) / ((b + 0.5) / words_neg)).alias("weight"), (2 * (term(a, words_pos) + term(b, words_neg))).alias("ratio"))
    return told.where((F.col("docs") >= SUPPORT) & (F.col("weight") >= math.log(RATIO)) & (F.col("ratio") >= SIGNIFICANT))


def _choose(rows: list) -> dict[str, float]:
    """Of (term, weight, ratio) those that tell most; of a term and its beginnings one."""
    chosen: dict[str, float] = {}
    blocked: set[str] = set()
    for _, _, term, weight in sorted((-round(r["ratio"], 6), -len(r["term"]), r["term"], r["weight"]) for r in rows):
        if term in blocked or any(term[:n] in chosen for n in range(SHORTEST, len(term))):
            continue
        chosen[term] = weight
        blocked.update(term[:n] for n in range(SHORTEST, len(term) + 1))
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.05 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Lexicon:
    """A lexicon from `docs` (doc_id, text) and `labels` (doc_id, toxic 0/1; rows that may be learned from).

    Null ids, texts and labels are left out; a document labelled both ways
    counts as toxic, as does a text that documents of both labels have.
    Without labels of both kinds the seed terms remain.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    rates = {1: min(1.0, positives / max(n_pos, 1)), 0: min(1.0, negatives / max(n_neg, 1))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    drawn = known.where(draw < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]))
    # About positives + negatives rows of two numbers, whatever the size of the corpus.
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialise(sample.select("text", "toxic"))
    words = {r["toxic"]: (r["n"], r["w"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    seeds = {fold(t).strip(): 4.0 for t in SEED_TERMS}
    spared = [fold(p).strip() for p in SEED_EXCEPTIONS]
    if 0 not in words or 1 not in words:
        return Lexicon(seeds, spared, (-4.0, 6.0, -1.0))
    counted = materialise(_counted(sample))
    terms = _choose(_significant(counted, float(words[1][1]), float(words[0][1])).collect())
    known = {r["term"]: (r["occ"], r["against"]) for r in counted.where(F.col("term").isin(list(seeds))).collect()}
    for term in seeds:
        if not any(term.startswith(t) or t.startswith(term) for t in terms):
            occ, against = known.get(term, (0, 0))
            terms[term] = max(0.0, math.log(((occ + _SEED_OCCURRENCES) / words[1][1]) / ((against + 0.5) / words[0][1])))
    lexicon = Lexicon(terms, spared)
    lexicon.exceptions += _exceptions(sample, lexicon, words)
    told = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        lex = told.value
        a = lex.automaton()
        for batch in batches:
            got = [lex.features(t, a) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([float(g[0]) for g in got]), pa.array([g[2] for g in got], pa.int64())], names=["toxic", "total", "words"])

    table = np.array([[r["toxic"], r["total"], r["words"]] for r in sample.mapInArrow(lean(measure), "toxic int, total double, words long").collect()], dtype=float)
    y, x = table[:, 0], np.stack([np.ones(len(table)), np.log1p(table[:, 1]), np.log1p(table[:, 2])], axis=1)
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    lexicon.coefficients = tuple(_logistic(x, y, weight * len(weight) / weight.sum()).tolist())
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon, words: dict) -> list[str]:
    """Matched words, alone or with a neighbour, that are no more frequent in toxic than in clean text."""
    told = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = told.value
        sums: dict[str, list[int]] = {}
        longest = max(map(len, lex.terms), default=0)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                w = fold(text).split()
                for i, word in enumerate(w):
                    if any(word[:n] in lex.terms for n in range(SHORTEST, min(longest, len(word)) + 1)):
                        own.add(word)
                        if i:
                            own.add(f"{w[i - 1]} {word}")
                        if i + 1 < len(w):
                            own.add(f"{word} {w[i + 1]}")
                for phrase in own:
                    sums.setdefault(phrase, [0, 0])[toxic] += 1
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c[0] for _, c in rows], pa.int64()), pa.array([c[1] for _, c in rows], pa.int64())], names=["phrase", "clean", "toxic"])

    counted = sample.mapInArrow(lean(run), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = words[1][0] / max(1, words[0][0])
    harmless = counted.where((F.col("clean") >= 3) & (F.col("toxic") <= F.col("clean") * share)).collect()
    return sorted(r["phrase"] for r in harmless)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col="text") -> DataFrame:
    """The rows of `docs` (all columns, whatever their names) that score below the threshold.

    A null or empty text scores as one without matches and words; repeated
    rows are judged alike.  An empty table gives no rows.
    """
    told, place = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index(text_col)

    def run(batches):
        lex = told.value
        a = lex.automaton()
        for batch in batches:
            got = (lex.features(t or "", a) for t in batch.column(place).to_pylist())
            yield batch.filter(pa.array([lex.score(g[0], g[2]) < threshold for g in got], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def score(docs: DataFrame, lexicon: Lexicon, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (and `keep`), score, n_matches, n_words for every row of `docs`.

    A null or empty text scores as a text without matches and words.  Rows are
    scored one by one, repeated ones alike; an empty table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = keep or []
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *names)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *[f"`{c}` {kinds[c]}" for c in names], "score double, n_matches long, n_words long"])

    def run(batches):
        lex = told.value
        a = lex.automaton()
        for batch in batches:
            got = [lex.features(t or "", a) for t in batch.column(0).to_pylist()]
            scores = [lex.score(g[0], g[2]) for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["doc_id", *names, "score", "n_matches", "n_words"])

    return rows.mapInArrow(lean(run), schema)
