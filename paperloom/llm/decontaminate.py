"""Benchmark decontamination: approximate passages by the pigeonhole principle and Myers' distance.

An item that occurs with at most k errors keeps one of k + 1 pieces unchanged.
All pieces of all items go into one Aho-Corasick automaton; a hit names the
stretch of the document where the whole item would have to lie.  Stretches of
an item that overlap are joined; those that lack more of its q-grams than k
errors can spoil are passed over, and Myers' bit-parallel search decides in the
others.  Items under `MIN_CHARS` characters are matched without errors, as whole
words.
Documents are read once for each block of items; items travel in blocks of
`BLOCK_CHARS`, documents do not move.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

#: Errors allowed for each character of an item; items shorter than MIN_CHARS after folding allow none and must begin and end with words.
ERROR_RATE, MIN_CHARS = 0.09, 32
#: From here on scripts are written without spaces, and any place may begin a word.
_UNSPACED = 0x2E80
BLOCK_CHARS, GRAM = 1 << 21, 5

_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case, with every run of characters that are neither letters nor digits as one space."""
    return _GAP.sub(" ", text.lower()).strip()


def myers_ends(pattern_masks: dict[str, int], m: int, text: str, limit: int):
    """(distance, end) of the best approximate occurrence in `text` with `limit` errors at most; (None, -1) if none.

    Of equal distances the first end counts.  `pattern_masks`: bit i is set for
    the characters at place i of the pattern.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (None, -1) if end < 0 else (best, end)


def _whole_words(text: str, start: int, end: int) -> bool:
    """Whether words begin and end there in folded text."""
    return (start == 0 or text[start - 1] == " " or ord(text[start]) >= _UNSPACED) and (end == len(text) or text[end] == " " or ord(text[end - 1]) >= _UNSPACED)


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """Folded items (id, text) with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        folded = [(i, fold(t or "")) for i, t in items]
        self.items = [(i, t, int(len(t) * error_rate) if len(t) >= min_chars else 0) for i, t in folded if t]
        self.short = [len(t) < min_chars for _, t, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            cuts = [round(p * len(text) / (k + 1)) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((n, a))
        #: Distinct q-grams of each item and how many of them any occurrence keeps: an error spoils GRAM at most.
        grams = [{t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for _, t, _ in self.items]
        self.grams = [(g, len(g) - GRAM * k) for g, (_, _, k) in zip(grams, self.items)]
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()
        self.forward: dict[int, dict] = {}
        self.backward: dict[int, dict] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) in the folded text; the best occurrence of each item found."""
        if not self.items:
            return []
        text = fold(text)
        stretches: dict[int, list[list[int]]] = {}
        exact: dict[int, tuple[int, int, int, int]] = {}
        for last, (length, where) in self.pieces.iter(text):
            for n, offset in where:
                item_id, item, k = self.items[n]
                if self.short[n]:
                    if n not in exact and _whole_words(text, last - length + 1, last + 1):
                        exact[n] = (item_id, 0, last - length + 1, last + 1)
                    continue
                lo = last - length + 1 - offset - k
                hi = lo + len(item) + 2 * k
                own = stretches.setdefault(n, [])
                # hits come in order of their ends; a stretch may still begin before the last one
                if own and lo <= own[-1][1]:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        out = list(exact.values())
        for n, spans in stretches.items():
            item_id, item, k = self.items[n]
            best = None
            for lo, hi in spans:
                lo = max(lo, 0)
                part = text[lo:hi]
                if len(part) < len(item) - k:
                    continue
                grams, least = self.grams[n]
                if least > 0 and len(grams.intersection({part[i : i + GRAM] for i in range(len(part) - GRAM + 1)})) < least:
                    continue
                if n not in self.forward:
                    self.forward[n], self.backward[n] = masks(item), masks(item[::-1])
                distance, end = myers_ends(self.forward[n], len(item), part, k)
                if distance is not None and (best is None or distance < best[0]):
                    # read backwards from the end, the same distance is reached first at the shortest occurrence
                    _, back = myers_ends(self.backward[n], len(item), part[:end][::-1], distance)
                    best = (distance, lo + end - back, lo + end)
            if best:
                out.append((item_id, *best))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text), BLOCK_CHARS of text each in expectation."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each document row and item that occurs in it.

    Positions are in the folded text.  Null texts and items, and items without
    letters or digits, match nothing.  Items under `min_chars` match without
    errors, as whole words; however short, they count.  Equal items are all
    reported, a repeated document row is reported again, a null id is carried
    along.  Empty tables give no rows; other columns are ignored.
    """
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        told = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, told=told):
            found = Items(told.value, error_rate, min_chars)
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for hit in found.find(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "distance", "start", "end"])

        part = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, item_id long, distance int, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text_col="text") -> DataFrame:
    """The rows of `docs` (all columns, whatever their names) in which no item occurs, as of `find_passages`.

    Rows with a null or empty text stay, repeated rows are judged alike; an
    empty benchmark keeps every row.
    """
    place = docs.columns.index(text_col)
    for items in _blocks(benchmark, "item_id", "text"):
        told = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, told=told):
            found = Items(told.value, error_rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not (text and found.find(text)) for text in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
