"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text (A-Z folded) from its start to its
end and back, and labels every position; a document's probabilities pool the
log probabilities of the positions that are letters, over the whole text.
Segments of `SEGMENT` bytes run side by side: each starts from the state that
`WARM` bytes beside it lead to, and is run again from its neighbour's last
state until that differs by `TOLERANCE` at most from the one it started with.
So states pass through whole texts, while a network that forgets costs hardly
more than one pass.

It is trained in numpy by backpropagation through time on a bounded sample:
about `PER_LANGUAGE` labelled documents of each language, `WINDOWS` windows of
`SPAN` bytes of each, none starting within a character; half of the windows
change from one text to another, so that the network learns to forget.  Its
weights are a few kilobytes whatever the corpus; scoring is one pass without a shuffle, in memory
bounded by `GROUP` segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import lean

HIDDEN, EMBED = 8, 12
SEGMENT, WARM, GROUP, TOLERANCE = 512, 64, 2048, 1e-2
SPAN = 96
PER_LANGUAGE, WINDOWS, EPOCHS, BATCH = 600, 4, 14, 256
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights: byte embedding E; for each direction input W, b, recurrent U, output V; output bias c."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages, self.hidden = list(languages), hidden
        n = len(languages)
        self.p = {"E": normal(256, embed, scale=0.5), "c": np.zeros((n, 1), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": normal(3 * hidden, embed, scale=embed**-0.5), f"b{d}": np.zeros((3 * hidden, 1), np.float32), f"U{d}": normal(3 * hidden, hidden, scale=hidden**-0.5), f"V{d}": normal(n, hidden, scale=hidden**-0.5)}

    def table(self, d: str) -> np.ndarray:
        """Input part of the gates for each byte value, gates x 256."""
        return self.p[f"W{d}"] @ self.p["E"].T + self.p[f"b{d}"]

    def states(self, d: str, x: np.ndarray) -> list[tuple]:
        """Training pass over x (steps x rows) in direction d; what backpropagation needs of each step."""
        H, U, table = self.hidden, self.p[f"U{d}"], self.table(d)
        h, kept = np.zeros((H, x.shape[1]), np.float32), []
        for row in x if d == "f" else x[::-1]:
            a, g = table[:, row], U @ h
            zr = _sigmoid(a[: 2 * H] + g[: 2 * H])
            z, r = zr[:H], zr[H:]
            n = np.tanh(a[2 * H :] + r * g[2 * H :])
            kept.append((h, z, r, n, g[2 * H :]))
            h = n + z * (h - n)
            kept[-1] += (h,)
        return kept

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy of all positions; x, weight: steps x rows, y: class of each position, or of each row."""
        H, steps, y = self.hidden, len(x), np.broadcast_to(y, x.shape)
        kept = {d: self.states(d, x) for d in "fb"}
        hf, hb = [k[-1] for k in kept["f"]], [k[-1] for k in kept["b"]][::-1]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        total, loss, out = float(weight.sum()) or 1.0, 0.0, []
        cols = np.arange(x.shape[1])
        for t in range(steps):
            logits = self.p["Vf"] @ hf[t] + self.p["Vb"] @ hb[t] + self.p["c"]
            logits -= logits.max(axis=0)
            e = np.exp(logits)
            e /= e.sum(axis=0)
            loss -= float((np.log(e[y[t], cols] + 1e-12) * weight[t]).sum())
            e[y[t], cols] -= 1
            out.append(e * (weight[t] / total))
        for d, hs in (("f", hf), ("b", hb)):
            U, V = self.p[f"U{d}"], self.p[f"V{d}"]
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            back = np.zeros((H, x.shape[1]), np.float32)
            gates = np.empty((3 * H, steps, x.shape[1]), np.float32)
            for k, t in reversed(list(enumerate(order))):
                before, z, r, n, gn, _ = kept[d][k]
                grad[f"V{d}"] += out[t] @ hs[t].T
                dh = V.T @ out[t] + back
                an = dh * (1 - z) * (1 - n * n)
                ar = an * gn * r * (1 - r)
                az = dh * (before - n) * z * (1 - z)
                g = np.concatenate([az, ar, an * r])
                grad[f"U{d}"] += g @ before.T
                back = dh * z + U.T @ g
                gates[:H, t], gates[H : 2 * H, t], gates[2 * H :, t] = az, ar, an
            flat, byte = gates.reshape(3 * H, -1), x.ravel()
            table = np.stack([np.bincount(byte, weights=row, minlength=256) for row in flat]).astype(np.float32)
            grad[f"W{d}"] += table @ self.p["E"]
            grad[f"b{d}"] += table.sum(axis=1, keepdims=True)
            grad["E"] += table.T @ self.p[f"W{d}"]
        grad["c"] += sum(o.sum(axis=1, keepdims=True) for o in out)
        return grad, loss / total

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 12) -> Network:
        """Adam on windows x, classes y, weights of the positions (rows x steps each)."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        n_steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows, step = order[at : at + batch], step + 1
                grad, _ = self.gradients(np.ascontiguousarray(x[rows].T), y[rows].T, np.ascontiguousarray(weight[rows].T))
                norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
                now = rate * (1 - step / (n_steps + 1)) * min(1.0, 1.0 / (norm + 1e-9))
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def ready(self) -> list:
        """Scoring weights: sigmoids become hyperbolic tangents by halving their inputs."""
        H, out = self.hidden, []
        half = np.r_[np.full(2 * H, 0.5), np.ones(H)].astype(np.float32)[:, None]
        for d in "fb":
            out.append((np.ascontiguousarray(self.table(d) * half), self.p[f"U{d}"] * half, self.p[f"V{d}"]))
        return out

    def step(self, h: np.ndarray, row: np.ndarray, table: np.ndarray, U: np.ndarray) -> np.ndarray:
        """The next state of every row, in place of the last one; scoring weights."""
        H = self.hidden
        a, g = table.take(row, axis=1), U @ h
        zr = a[: 2 * H]
        zr += g[: 2 * H]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = g[2 * H :]
        n *= zr[H:]
        n += a[2 * H :]
        np.tanh(n, out=n)
        h -= n
        h *= zr[:H]
        h += n
        return h

    def label(self, x: np.ndarray, weight: np.ndarray, sizes: np.ndarray, forth: np.ndarray, back: np.ndarray, ready: list | None = None):
        """(weighted sums of log probabilities over positions, states at the end, states at the start).

        x: steps x rows of bytes, of which `sizes` are in the text; `forth`,
        `back`: hidden x rows, the states before the first byte and after the
        last.  Results: rows x languages, hidden x rows each.
        """
        forward, backward = ready or self.ready()
        shortest = int(sizes.min(initial=len(x)))
        seen, h = np.empty((len(x), len(self.languages), x.shape[1]), np.float32), forth.copy()
        for t, row in enumerate(x):
            h = self.step(h, row, forward[0], forward[1])
            np.matmul(forward[2], h, out=seen[t])
        ends, h = h, back.copy()
        total = np.zeros((len(self.languages), x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before = h.copy() if t >= shortest else None
            h = self.step(h, x[t], backward[0], backward[1])
            if before is not None:  # texts that have ended are not read
                h = np.where(t < sizes, h, before)
            logits = seen[t]
            logits += backward[2] @ h
            logits += self.p["c"]
            logits -= logits.max(axis=0)
            logits -= np.log(np.exp(logits).sum(axis=0))
            logits *= weight[t]
            total += logits
        return total.T, ends, h


def _segments(offsets: np.ndarray):
    """(starts, lengths, text number) of the segments of all texts."""
    size = np.diff(offsets)
    count = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), count)
    no = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][owner] + no * SEGMENT
    return starts, np.minimum(SEGMENT, offsets[1:][owner] - starts), owner


def pooled(column: pa.Array, network: Network) -> np.ndarray:
    """Document probabilities, texts x languages; texts without letters get equal ones."""
    if not network.languages:
        return np.zeros((len(column), 0))
    data, offsets = K.text_buffers(column)
    starts, sizes, owner = _segments(offsets)
    ready, inner, H = network.ready(), np.arange(SEGMENT), network.hidden
    shown = np.concatenate([np.zeros(WARM, np.uint8), K._LOWER[data], np.zeros(SEGMENT + WARM, np.uint8)])  # text from WARM on
    letter = np.concatenate([_LETTER[data], np.zeros(SEGMENT, bool)])
    n = len(starts)
    first, last = np.r_[True, owner[1:] != owner[:-1]][:n], np.r_[owner[1:] != owner[:-1], True][:n]
    sums, ends, heads = np.zeros((n, len(network.languages)), np.float32), np.zeros((H, n), np.float32), np.zeros((H, n), np.float32)
    forth, back = np.zeros((H, n), np.float32), np.zeros((H, n), np.float32)

    def warm(which: np.ndarray, start: np.ndarray, states: np.ndarray, d: int) -> None:
        """States after WARM bytes from `start` on in direction d; a text's end keeps the state zero."""
        stop = offsets[1:][owner[which]]
        h = np.zeros((H, len(which)), np.float32)
        for t in range(WARM) if d == 0 else range(WARM - 1, -1, -1):
            before = h.copy() if d else None
            h = network.step(h, shown[start + t + WARM], ready[d][0], ready[d][1])
            if d:
                h = np.where(start + t < stop, h, before)
        states[:, which] = h

    def run(which: np.ndarray) -> None:
        s, size = starts[which], sizes[which]
        at = s[None, :] + inner[:, None]
        inside = inner[:, None] < size[None, :]
        got = network.label(np.where(inside, shown[at + WARM], 0), (letter[at] & inside).astype(np.float32), size, forth[:, which], back[:, which], ready)
        sums[which], ends[:, which], heads[:, which] = got

    for at in range(0, n, GROUP):
        which = np.arange(at, min(at + GROUP, n))
        inner_starts, inner_ends = which[~first[which]], which[~last[which]]
        warm(inner_starts, starts[inner_starts] - WARM, forth, 0)
        warm(inner_ends, starts[inner_ends] + SEGMENT, back, 1)
        run(which)
    while n:
        # What a segment's neighbours ended with, against what it started with.
        was, will = np.where(first, 0.0, np.roll(ends, 1, axis=1)), np.where(last, 0.0, np.roll(heads, -1, axis=1))
        again = np.flatnonzero((np.abs(forth - was).max(axis=0) > TOLERANCE) | (np.abs(back - will).max(axis=0) > TOLERANCE))
        if not len(again):
            break
        forth[:, again], back[:, again] = was[:, again], will[:, again]
        for at in range(0, len(again), GROUP):
            run(again[at : at + GROUP])
    total, letters = np.zeros((len(column), len(network.languages))), np.zeros(len(column))
    np.add.at(total, owner, sums)
    counts = np.r_[0, np.cumsum(letter[: len(data)], dtype=np.int64)]
    letters = counts[offsets[1:]] - counts[offsets[:-1]]
    mean = total / np.maximum(letters, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, seed: int = 13) -> Network:
    """A network from columns doc_id, text, lang of the rows where `training` holds and lang is not null.

    A language with more than `per_language` rows is thinned by the hash of
    its text to about that many, so the sample is bounded by `per_language`
    and `windows` a language.
    """
    from pyspark.sql import Window

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Network([])
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))

    def cut(batches):
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            langs, xs = batch.column(1).to_pylist(), []
            for i, lang in enumerate(langs):
                text = data[offsets[i] : offsets[i + 1]]
                spread = np.linspace(0, max(0, len(text) - SPAN), windows).astype(np.int64).tolist()
                # A window starts with a character's first byte.
                spread = {next(b for b in range(a, -1, -1) if not b or text[b] & 0xC0 != 0x80) for a in spread}
                xs += [(lang, text[a : a + SPAN].tobytes()) for a in sorted(spread)]
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in xs]), pa.array([x[1] for x in xs], pa.binary())], names=["lang", "window"])

    drawn = rows.where(share < rate).select("text", "lang").mapInArrow(lean(cut), "lang string, window binary")
    # Copies may exceed the expected number: the bound per language is kept by hash order.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window"))
    sample = sorted((r["lang"], bytes(r["window"])) for r in drawn.withColumn("place", place).where(F.col("place") <= 2 * per_language * windows).select("lang", "window").collect())
    x = np.zeros((len(sample), SPAN), np.uint8)
    for i, (_, w) in enumerate(sample):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.repeat(np.array([languages.index(lang) for lang, _ in sample])[:, None], SPAN, axis=1)
    # Every other window goes on as another one does: positions are labelled by what is near them, and states forget.
    rng = np.random.default_rng(seed)
    other, cut = rng.permutation(len(x)), np.where(np.arange(len(x)) % 2 == 0, rng.integers(SPAN // 6, SPAN - SPAN // 6, len(x)), SPAN)
    after = np.arange(SPAN)[None, :] >= cut[:, None]
    x, y = np.where(after, x[other], x), np.where(after, y[other], y)
    weight = (_LETTER[x]).astype(np.float32)
    return Network(languages).fit(K._LOWER[x], y, weight, seed=seed)


def identify(docs: DataFrame, network: Network, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns in `keep`), lang_pred, score for every row of `docs`.

    A null text or one without a letter is `und` with score 0, as is every
    text where nothing was learned.  Ties go to the first language in order.
    Rows are labelled one by one, repeated ones alike; an empty table gives
    no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(network)
    names = keep or []
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(text_col).alias("_text"), letters.alias("_letters"), F.col(id_col).alias("doc_id"), *names)
    schema = ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *[f"`{c}` {dict(rows.dtypes)[c]}" for c in names], "lang_pred string", "score double"])

    def run(batches):
        net = told.value
        for big in batches:
            for batch in K.pieces(big):
                known = np.asarray(batch.column(1)) & bool(net.languages)
                p = pooled(batch.column(0), net)
                if net.languages:
                    best = p.argmax(axis=1)
                    label = np.where(known, np.array(net.languages, dtype=object)[best], UNDETERMINED)
                    score = np.where(known, p[np.arange(len(p)), best], 0.0)
                else:
                    label, score = np.full(len(known), UNDETERMINED, dtype=object), np.zeros(len(known))
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(label, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", *names, "lang_pred", "score"])

    return rows.mapInArrow(lean(run), schema)


def drop_undetermined(docs: DataFrame, network: Network, certain: float = 0.5, text_col="text") -> DataFrame:
    """The rows of `docs` (all columns, whatever their names) whose text has a letter and a language of probability `certain` at least.

    A null text or one without a letter goes; a network that has learned no
    language judges none, and all texts with letters stay.  Repeated rows are
    judged alike.
    """
    told, names = docs.sparkSession.sparkContext.broadcast(network), docs.columns
    place = names.index(text_col)
    letters = docs.where(F.col(text_col).rlike(r"\p{L}"))

    def run(batches):
        net = told.value
        for big in batches:
            for batch in K.pieces(big, place):
                best = pooled(batch.column(place), net).max(axis=1) if net.languages else np.ones(batch.num_rows)
                yield batch.filter(pa.array(best >= certain))

    return letters.mapInArrow(lean(run), docs.schema)


def in_fold(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text (null: empty) leaves this remainder."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
