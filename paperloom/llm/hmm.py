"""Hidden Markov language model over word classes, trained by Baum-Welch on all training documents.

A token is a word or the end of its document.  The `n_words` most frequent
tokens are classes of their own; every other word belongs to a class given by
its last bytes, so unseen words have one too.  The model is

    p(text) = sum over state paths of prod p(state | state) p(class | state) p(word | class)

where p(word | class) = (c + 1) / (N_class + V_class + 1) for classes of more
than one word.  The last factor does not depend on states, so the recursions
run on class sequences alone, and the tables that travel (classes x states)
have a fixed size while the vocabulary grows with the corpus.

Documents are coded once, chunk by chunk, against the chunk's own dictionary;
counts of the whole corpus come back by `shards.count_and_reply`.  Each
Baum-Welch round is one pass over the coded chunks whose expected counts are
summed by class in the cluster.  Rounds start from a random model and cover
every training document from its start to its end, until two rounds in turn
raise the log-likelihood by less than `SETTLED` a token.

Words are identified by 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shards import bounds, in_key_order, shard_count
from .shared import lean, written

STATES, WORDS, SHAPES = 8, 4096, 2048
#: Natural logarithm units a token.
SETTLED = 1e-3
#: Sequences are passed in groups; those beyond LONG tokens wait for each other, as each step in time costs the same for few.
CHUNK_BYTES, LONG, GROUP_TOKENS = 8 << 20, 2048, 1 << 20
END = np.uint64(0xFFFFFFFFFFFFFFFF)
_PRIOR, STAT_GROUPS = 20.0, 32


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class number of a rare word: a hash of its last three bytes (lower case) and of whether there are more."""
    h = np.minimum(ends - starts, 4).astype(np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        byte = np.where(at >= starts, K._LOWER[data[np.maximum(at, 0)]], 0).astype(np.uint64)
        h = h * np.uint64(257) + byte
    return (K._mix(h) % np.uint64(SHAPES)).astype(np.uint16)


def _press(codes: np.ndarray) -> bytes:
    """uint32 codes as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpress(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _code(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out) to chunks of about CHUNK_BYTES of text."""
    schema = "chunk long, ids array<long>, held array<boolean>, sizes binary, codes binary, keys binary, weights binary, shapes binary"

    def close(no, parts):
        ids, held = [i for p in parts for i in p[0]], [h for p in parts for h in p[1]]
        sizes = np.concatenate([p[2] for p in parts])
        keys, where, codes = np.unique(np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
        shapes = np.concatenate([p[4] for p in parts])[where]
        train = np.repeat(~np.array(held, dtype=bool), sizes)
        weights = np.bincount(codes[train], minlength=len(keys)).astype(np.int64)
        cells = [sizes.tobytes(), _press(codes), keys.tobytes(), weights.tobytes(), shapes.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), *[pa.array([c], pa.binary()) for c in cells]], names=["chunk", "ids", "held", "sizes", "codes", "keys", "weights", "shapes"])

    def run(batches):
        from pyspark import TaskContext

        no, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in K.pieces(whole, 1):
                piece, cut = K.text_buffers(batch.column(1))
                starts, ends = K.word_spans(piece, cut)
                first = np.searchsorted(starts, cut)
                sizes = np.diff(first) + 1
                n = int(sizes.sum())
                last = np.cumsum(sizes) - 1
                word = np.ones(n, dtype=bool)
                word[last] = False
                keys, shapes = np.full(n, END), np.zeros(n, np.uint16)
                keys[word] = K.fingerprints(piece, starts, ends)
                shapes[word] = _shapes(piece, starts, ends)
                parts.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), sizes.astype(np.int64), keys, shapes))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield close(no, parts)
                    no, parts, size = no + 1, [], 0
        if parts:
            yield close(no, parts)

    return docs.select("doc_id", "text", "held_out").mapInArrow(lean(run), schema)


def _totals(chunks: DataFrame, n_shards: int, heavy: int) -> DataFrame:
    """Replies with corpus counts as in `shards`, and on one row of each shard its statistics.

    `shape_keys`, `shape_weight`: distinct keys and tokens by shape;
    `top`: the shard's most frequent keys (key, weight, shape).
    """
    lower = bounds(n_shards)
    per_shard = 64 + 4 * heavy // n_shards

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, w, s = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["weights"], np.int64), np.frombuffer(row["shapes"], np.uint16)
                cut = np.r_[np.searchsorted(k, lower), len(k)]
                some = np.flatnonzero(np.diff(cut))
                blobs = [pa.array([a[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for a in (k, w, s)]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["chunk"], dtype=np.int64)), *blobs], names=["shard", "chunk", "keys", "weights", "shapes"])

    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("totals", pa.binary()), ("shape_keys", pa.list_(pa.int64())), ("shape_weight", pa.list_(pa.int64())), ("top", pa.list_(pa.struct([("key", pa.int64()), ("weight", pa.int64()), ("shape", pa.int32())])))])

    def count(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)]
        parts = read("keys", np.uint64)
        keys, weights, shapes = np.concatenate(parts), np.concatenate(read("weights", np.int64)), np.concatenate(read("shapes", np.uint16))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        sums, shape, key = np.add.reduceat(weights[order], np.flatnonzero(new)), shapes[order][new], ordered[new]
        totals = np.empty(len(keys), dtype=np.int64)
        totals[order] = sums[np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])
        seen = sums > 0
        top = np.lexsort((key, -sums))[:per_shard]
        top = [{"key": int(key[i].astype(np.int64)), "weight": int(sums[i]), "shape": int(shape[i])} for i in top if sums[i] > 0]
        blank = [None] * (len(parts) - 1)
        by_shape = np.bincount(shape[seen], minlength=SHAPES), np.bincount(shape[seen], weights=sums[seen], minlength=SHAPES).astype(np.int64)
        columns = [table.column("chunk"), table.column("shard"), pa.array([totals[e - len(p) : e].tobytes() for p, e in zip(parts, ends)], pa.binary())]
        stats = [pa.array([first, *blank], schema.field(i).type) for i, first in zip((3, 4, 5), (by_shape[0].tolist(), by_shape[1].tolist(), top))]
        return pa.table([*columns, *stats], schema=schema)

    pieces = chunks.select("chunk", "keys", "weights", "shapes").mapInArrow(lean(split), "shard int, chunk long, keys binary, weights binary, shapes binary")
    return pieces.groupBy("shard").applyInArrow(count, "chunk long, shard int, totals binary, shape_keys array<long>, shape_weight array<long>, top array<struct<key:long,weight:long,shape:int>>")


class Classes:
    """Corpus totals and the map from words to classes; its size is fixed by `n_words` and SHAPES."""

    def __init__(self, replies: DataFrame, n_words: int):
        def add(table: pa.Table) -> pa.Table:
            total = lambda name: np.sum([c.values.to_numpy() for c in table.column(name)], axis=0)
            return pa.table({"keys": pa.array([total("shape_keys").tobytes()], pa.binary()), "weight": pa.array([total("shape_weight").tobytes()], pa.binary())})

        # STAT_GROUPS rows of fixed size, whatever the number of shards.
        stats = replies.where("shape_keys is not null").select((F.col("shard") % STAT_GROUPS).alias("g"), "shape_keys", "shape_weight")
        parts = stats.groupBy("g").applyInArrow(add, "keys binary, weight binary").collect()
        total = lambda name: sum((np.frombuffer(r[name], np.int64) for r in parts), np.zeros(SHAPES, np.int64)).astype(float)
        self.keys_of, self.weight_of = total("keys"), total("weight")
        self.train_tokens, self.vocabulary = int(self.weight_of.sum()), int(self.keys_of.sum())
        # At most 16 * n_words words have this count, so what comes to the driver is bounded.
        least = max(1, self.train_tokens // (16 * n_words))
        top = replies.where("top is not null").select(F.explode(F.filter("top", lambda t: t["weight"] >= least)).alias("t")).select("t.*").collect()
        top = sorted(top, key=lambda r: (-r["weight"], r["key"]))[:n_words]
        own = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
        weight = np.array([r["weight"] for r in top], dtype=np.float64)
        for r in top:  # what has a class of its own leaves the class of its shape
            self.keys_of[r["shape"]] -= 1
            self.weight_of[r["shape"]] -= r["weight"]
        order = np.argsort(own)
        self.own, self.own_weight = own[order], weight[order]
        self.n = len(own) + SHAPES
        mass = np.r_[self.own_weight + 1, self.weight_of + self.keys_of + 1]
        self.background = mass / mass.sum()

    def of(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, keys), max(len(self.own) - 1, 0))
        hit = self.own[at] == keys if len(self.own) else np.zeros(len(keys), bool)
        return np.where(hit, at, len(self.own) + shapes.astype(np.int64)).astype(np.uint16)

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 p(word | class)."""
        shape = classes.astype(np.int64) - len(self.own)
        rare = np.maximum(shape, 0)
        return np.where(shape < 0, 0.0, np.log10((counts + 1) / (self.weight_of[rare] + self.keys_of[rare] + 1)))


def _classify(chunks: DataFrame, replies: DataFrame, classes: Classes) -> DataFrame:
    """Chunks of class sequences with every document's base score and within-class score."""
    told = chunks.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("classes", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("rest", pa.binary())])

    def run(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        out, c = [], told.value
        for row in chunk.to_pylist():
            totals = in_key_order(reply)
            keys, shapes, sizes = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["shapes"], np.uint16), np.frombuffer(row["sizes"], np.int64)
            codes = _unpress(row["codes"])
            of_key = c.of(keys, shapes)
            at = np.cumsum(sizes) - sizes
            per_doc = lambda values: np.add.reduceat(values[codes], at)  # noqa: E731, B023
            base = per_doc(np.log10((totals + 1.0) / (c.train_tokens + (c.vocabulary + 1.0))))
            known, rest = per_doc((totals > 0).astype(np.int64)), per_doc(c.within(of_key, totals))
            out.append({"ids": row["ids"], "held": row["held"], "sizes": row["sizes"], "classes": _press_classes(of_key[codes]), "known": known.tobytes(), "base": base.tobytes(), "rest": rest.tobytes()})
        return pa.Table.from_pylist(out, schema)

    slim = chunks.select("chunk", "ids", "held", "sizes", "codes", "keys", "shapes")
    return slim.groupBy("chunk").cogroup(replies.select("chunk", "shard", "totals").groupBy("chunk")).applyInArrow(run, "ids array<long>, held array<boolean>, sizes binary, classes binary, known binary, base binary, rest binary")


def _press_classes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def _unpress_classes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(2, -1).T).view("<u2").ravel()


class Model:
    """Start, transition and emission probabilities; emission has a row for each class."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit
        steady = np.full(len(start), 1 / len(start))
        for _ in range(50):
            steady = steady @ move
        self.steady = steady / steady.sum()

    @staticmethod
    def from_counts(start, move, emit, background: np.ndarray) -> Model:
        start, move = start + 1.0, move + 1.0
        emit = emit + _PRIOR * background[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_time(sizes: np.ndarray):
    """Sequences longest first; (order, rows at each step, place of each token in time order)."""
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    longest = int(sizes.max(initial=0))
    ending = np.bincount(sizes, minlength=longest + 1)
    rows = len(sizes) - np.cumsum(ending)[:longest]
    offset = np.cumsum(rows) - rows
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order, rows, offset, offset[step] + np.repeat(rank, sizes)


def log10_likelihood(symbols: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Exact log10 probability of every sequence by the scaled forward recursion."""
    order, rows, offset, place = _by_time(sizes)
    in_time = np.empty(len(symbols), np.int64)
    in_time[place] = symbols
    total = np.zeros(len(sizes))
    alpha = np.repeat(model.start[None, :], len(sizes), axis=0)
    for t, (n, at) in enumerate(zip(rows.tolist(), offset.tolist())):
        a = alpha[:n] @ model.move if t else alpha[:n]
        a = a * model.emit[in_time[at : at + n]]
        scale = a.sum(axis=1)
        alpha = a / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def expected_counts(symbols: np.ndarray, sizes: np.ndarray, begins: np.ndarray, model: Model, n_classes: int):
    """Baum-Welch counts (start, move, emit) of sequences; those not in `begins` go on from elsewhere."""
    return _expectations(symbols, sizes, begins, model, n_classes)[:3]


def _expectations(symbols: np.ndarray, sizes: np.ndarray, begins: np.ndarray, model: Model, n_classes: int):
    """The expected counts and the log-likelihood under `model`."""
    order, rows, offset, place = _by_time(sizes)
    in_time = np.empty(len(symbols), np.int64)
    in_time[place] = symbols
    k = len(model.start)
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    like = emit[in_time]
    alpha = np.empty((len(symbols), k), np.float32)
    scale = np.empty((len(symbols), 1), np.float32)
    begins = begins[order]
    before = np.where(begins[:, None], model.start[None, :], model.steady[None, :]).astype(np.float32)
    for t, (n, at) in enumerate(zip(rows.tolist(), offset.tolist())):
        a = (before[:n] @ move if t else before[:n]) * like[at : at + n]
        s = a.sum(axis=1, keepdims=True)
        np.maximum(s, 1e-30, out=s)
        before = alpha[at : at + n] = a / s
        scale[at : at + n] = s
    moved = np.zeros((k, k))
    beta = np.ones((len(sizes), k), np.float32)
    gamma = alpha
    for t in range(len(rows) - 1, -1, -1):
        n, at = int(rows[t]), int(offset[t])
        own = alpha[at : at + n].copy()
        e = like[at : at + n] * beta[:n] / scale[at : at + n]
        gamma[at : at + n] = own * beta[:n]
        if t:
            was = int(offset[t - 1])
            moved += alpha[was : was + n].T @ e
            beta[:n] = e @ move.T
    start = gamma[: len(sizes)][begins].sum(axis=0, dtype=np.float64) if len(sizes) else np.zeros(k)
    counts = np.stack([np.bincount(in_time, weights=gamma[:, j], minlength=n_classes) for j in range(k)], axis=1)
    return start, moved * model.move, counts, np.log(scale).sum(dtype=np.float64)


def _sequences(rows):
    """Whole training sequences of coded chunks, in groups of about GROUP_TOKENS: (symbols, sizes)."""
    pools: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    for row in rows:
        sizes, symbols = np.frombuffer(row["sizes"], np.int64), _unpress_classes(row["classes"])
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(~np.array(row["held"], dtype=bool)).tolist():
            docs, lengths = pool = pools[bool(sizes[i] > LONG)]
            docs.append(symbols[ends[i] - sizes[i] : ends[i]].copy())
            lengths.append(int(sizes[i]))
            if len(docs) % 64 == 0 or sizes[i] > LONG:
                if sum(lengths) >= GROUP_TOKENS:
                    yield np.concatenate(docs), np.array(lengths)
                    pool[0].clear(), pool[1].clear()
    for docs, lengths in pools.values():
        if docs:
            yield np.concatenate(docs), np.array(lengths)


def _first_model(classes: Classes, states: int, seed: int) -> Model:
    """A random model around the classes' frequencies."""
    rng = np.random.default_rng(seed)
    emit = classes.background[:, None] * rng.gamma(2.0, 0.5, size=(classes.n, states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _round(coded: DataFrame, classes: Classes, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all training documents: the next model, and the log-likelihood under `model`."""
    k, n = len(model.start), classes.n
    told = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k)), np.zeros(k)]
        for symbols, sizes in _sequences(row for batch in batches for row in batch.to_pylist()):
            *counts, likelihood = _expectations(symbols, sizes, np.ones(len(sizes), bool), told.value, n)
            for total, more in zip(sums, counts):
                total += more
            sums[3][0] += likelihood
        table = np.concatenate([sums[2], sums[1], sums[0][None, :], sums[3][None, :]])
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(table[some, j]) for j in range(k)]], names=["row", *[f"s{j}" for j in range(k)]])

    fields = [f"s{j}" for j in range(k)]
    counts = coded.select("held", "sizes", "classes").mapInArrow(lean(run), "row long, " + ", ".join(f"{f} double" for f in fields))
    table = np.zeros((n + k + 2, k))
    for r in counts.groupBy("row").agg(*[F.sum(f).alias(f) for f in fields]).collect():
        table[r["row"]] = [r[f] for f in fields]
    told.unpersist()
    return Model.from_counts(table[-2], table[n:-2], table[:n], classes.background), table[-1][0]


def _fit(coded: DataFrame, classes: Classes, states: int, rounds: int | None, seed: int) -> tuple[Model, list[float]]:
    """The model after `rounds` rounds (None: until the likelihood settles), and the log-likelihoods a token before each."""
    model, found = _first_model(classes, states, seed), []
    while len(found) != rounds and classes.train_tokens:
        model, likelihood = _round(coded, classes, model)
        found.append(likelihood / classes.train_tokens)
        if rounds is None and len(found) > 2 and found[-1] - found[-2] < SETTLED and found[-2] - found[-3] < SETTLED:
            break
    return model, found


def score_texts(docs: DataFrame, held_out, states: int = STATES, n_words: int = WORDS, rounds: int | None = None, seed: int = 7, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from the rows where `held_out` is false (null: false), in `rounds`
    rounds or until the likelihood settles.  A null text
    is empty: one token, the end.  Null and repeated ids are rows like others.
    Without training rows every count is 0 and the scores are those of the
    priors.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chunks = written(_code(docs), "chunks")
    key_bytes = 2 * (chunks.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0] or 0)  # keys and weights
    replies = written(_totals(chunks, shard_count(docs, key_bytes), n_words), "replies")
    classes = Classes(replies, n_words)
    coded = written(_classify(chunks, replies, classes), "coded")
    model, _ = _fit(coded, classes, states, rounds, seed)
    told = docs.sparkSession.sparkContext.broadcast((model, classes.train_tokens))

    def run(batches):
        model, train_tokens = told.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                path = log10_likelihood(_unpress_classes(row["classes"]), sizes, model)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(np.frombuffer(row["known"], np.int64)), pa.array(np.full(len(sizes), train_tokens, np.int64)), pa.array(np.frombuffer(row["base"], np.float64)), pa.array(path + np.frombuffer(row["rest"], np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
