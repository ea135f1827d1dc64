"""N-gram Jaccard join with adaptive multi-match prefixes, as connected components.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches the threshold.  If they link, then under any common order of shingles
their l-prefixes (the first |A| - ceil(t |A|) + l shingles) share l shingles at
least.  The join uses that twice:

1.  In hash order, every document sends its l-prefix with l = 1 + |A| // 5 to
    shards.  A document with fewer than l shingles that any other set has in
    its prefix links with nothing and leaves.  This moves under half of the
    shingles, four bytes each, and costs the same however often one occurs.
2.  Among the rest, shingles are counted, and prefixes are taken in order of
    frequency, rarest first.  Each document lengthens its prefix by the cost
    estimated from the frequencies in it and must then share more shingles
    before a pair is verified on the whole sets.

Equal sets are one class from the start.  Shingles of more than `SMALL` classes
never produce all pairs: each such bucket compares its members with a pivot,
and only pairs whose ends are still in different components go on.  A pair that
links is compared, or its ends are already joined by other links; so components
are exact.

Shingles and sets are identified by 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shards import count_and_reply, in_key_order, shard_count
from .shared import bit_map, called_for, lean, materialise, written

WIDTH, THRESHOLD = 5, 75
#: Buckets up to this size compare all members; larger ones go through pivots.
SMALL = 6
PIVOT_ROUNDS = 2
#: Members of a large bucket are dealt to joins in parts of about this many.
PART = 1000
LEVELS, VERIFY_COST = 8, 16
#: Shared shingles of a prefix up to this number travel with each of them, to meet a partner once.
CARRIED = 256
EDGES_A_PARTITION = 250_000
#: Shingles of one chunk, and those posted at once to the shards (12 MB).
CHUNK_SHINGLES, POST_SHINGLES = 1 << 18, 1 << 20


def _need(n, percent: int):
    """Smallest overlap of a set of n shingles with a set it links to."""
    return -(-percent * n // 100)


def _sets(column: pa.Array, width: int):
    """Sorted distinct shingles of every text, one array at a time."""
    words, first = K.words_of(column)
    for i in range(len(first) - 1):
        s = K.shingles(words[first[i] : first[i + 1]], width)
        s.sort()
        yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _class_of(s: np.ndarray) -> int:
    """64-bit fingerprint of a set, as a signed long; the empty set has 0."""
    if not len(s):
        return 0
    total = K._mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(K._mix(np.array([total + np.uint64(len(s))], dtype=np.uint64))[0].astype(np.int64)) or 1


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def describe_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) to doc_id, text_hash, n, cls: one narrow row per document."""

    def run(batches):
        for whole in batches:
            for batch in K.pieces(whole, 1):
                n, cls = [], []
                for s in _sets(batch.column(1), width):
                    n.append(len(s))
                    cls.append(_class_of(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "text_hash", "n", "cls"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(run), "doc_id long, text_hash long, n long, cls long")


def shared_counts(docs: DataFrame, width: int, percent: int, n_shards: int) -> DataFrame:
    """(cls, shared): how many shingles of a set's hash-order prefix another set has in its own."""

    def post(batches):
        tokens, classes, held = [], [], 0
        for whole in batches:
            for batch in K.pieces(whole):
                for s in _sets(batch.column(0), width):
                    if n := len(s):
                        tokens.append(s[: n - _need(n, percent) + _first_level(n)])
                        classes.append(_class_of(s))
                        held += len(tokens[-1])
                if held >= POST_SHINGLES:
                    yield deal(tokens, classes)
                    tokens, classes, held = [], [], 0
        if tokens:
            yield deal(tokens, classes)

    def deal(tokens: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        mixed = K._mix(np.concatenate(tokens))
        shard = (((mixed >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        shard, low, owner = shard[order], mixed[order].astype(np.uint32), owner[order]
        ids = np.array(classes, dtype=np.int64)
        cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            own = owner[a:b]
            runs = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows.append((int(shard[a]), low[a:b].tobytes(), ids[own[runs]].tobytes(), np.diff(np.r_[runs, b - a]).astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "tokens", "classes", "runs"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)])
        token = read("tokens", np.uint32)
        cls = np.repeat(read("classes", np.int64), read("runs", np.uint32))
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        new_token = np.r_[True, token[1:] != token[:-1]]
        fresh = new_token | np.r_[True, cls[1:] != cls[:-1]]
        token_no = np.cumsum(new_token) - 1
        several = np.bincount(token_no[fresh]) > 1
        found, count = np.unique(cls[fresh & several[token_no]], return_counts=True)
        return pa.table({"cls": pa.array(found), "shared": pa.array(count.astype(np.int64))})

    posted = docs.select("text").mapInArrow(lean(post), "shard int, tokens binary, classes binary, runs binary")
    return posted.groupBy("shard").applyInArrow(meet, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))


def _first_level(n: int) -> int:
    return 1 + n // 5


def live_sets(docs: DataFrame, live: DataFrame, width: int, n_shards: int) -> DataFrame:
    """(cls, shingles) of the representatives in `live` (cls, rep_id, rep_hash), dealt by cls."""
    h = lambda a, b: F.xxhash64(F.coalesce(a, F.lit(0)), b)
    words, bits = bit_map(live.select(h(F.col("rep_id"), F.col("rep_hash")).alias("h")))
    told = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for whole in batches:
            place = np.asarray(whole.column(3)) % bits
            whole = whole.filter(pa.array((told.value[place >> 6] >> (place & 63)) & 1 == 1))
            for batch in K.pieces(whole, 1):
                sets = list(_sets(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "text_hash", "cls", "shingles"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), h(F.col("doc_id"), F.xxhash64("text")).alias("h"))
    found = rows.mapInArrow(lean(run), "doc_id long, text_hash long, cls long, shingles binary").repartition(n_shards, "cls")
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    return found.join(live, "cls").where(same).select("cls", "shingles").dropDuplicates(["cls"])


def _chunk_sets(sets: DataFrame) -> DataFrame:
    """(cls, shingles) rows to chunks: chunk, classes, sizes, values; the same ones each time, as `sets` is written."""

    def run(batches):
        from pyspark import TaskContext

        no, held, classes, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            cells = [np.array(classes, np.int64).tobytes(), np.array([len(s) for s in held], np.int64).tobytes(), np.concatenate(held).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["chunk", "classes", "sizes", "values"])

        for batch in batches:
            for cls, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.frombuffer(shingles.as_buffer(), np.uint64))
                classes.append(cls)
                size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    yield close()
                    no, held, classes, size = no + 1, [], [], 0
        if held:
            yield close()

    return sets.select("cls", "shingles").mapInArrow(lean(run), "chunk long, classes binary, sizes binary, values binary")


def _level(df: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(level, prefix length) of least estimated cost; df: ascending frequencies of the set's shingles."""
    base = n - _need(n, percent)
    most = max(1, min(LEVELS, n - base))
    partners = np.cumsum(df[: base + most] - 1)[base : base + most]
    levels = np.arange(1, most + 1)
    level = int(np.argmin(partners * (1 + VERIFY_COST / levels))) + 1
    return level, base + level


def _postings(chunks: DataFrame, replies: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n, level, large, rare, df, many): shared shingles of each class's prefix in frequency order.

    `df`: how many classes have the shingle; `many`: more than SMALL; `large`:
    how many such shingles the class's prefix has; `rare`: how many others it
    has, those of this class alone included.
    """
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("large", pa.int32()), ("rare", pa.int64()), ("df", pa.int64()), ("many", pa.bool_())])

    def run(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            read = lambda name, kind: np.frombuffer(row[name], dtype=kind)  # noqa: E731, B023
            totals = in_key_order(reply)
            flat = read("values", np.uint64)
            df = totals[np.unique(flat, return_inverse=True)[1]]
            at = 0
            for cls, n in zip(read("classes", np.int64).tolist(), read("sizes", np.int64).tolist()):
                order = np.lexsort((flat[at : at + n], df[at : at + n]))
                token, count = flat[at : at + n][order], df[at : at + n][order]
                at += n
                level, length = _level(count, n, percent)
                shared = count[:length] > 1
                if shared.any():
                    token, own = token[:length][shared], count[:length][shared]
                    many, k = own > SMALL, len(token)
                    out.append((_signed(token), np.full(k, cls), np.full(k, n), np.full(k, level, np.int32), np.full(k, many.sum(), np.int32), np.full(k, length - many.sum()), own, many))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 8
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, "token long, cls long, n long, level int, large int, rare long, df long, many boolean")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(u) + len(v) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _laid(df: DataFrame, rows: int) -> DataFrame:
    """Few rows in few partitions: one partition needs no shuffle at all, many rows stay spread."""
    return df.coalesce(max(1, -(-rows // EDGES_A_PARTITION)))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b); root: the smallest node of its component.

    Alternating large-star and small-star steps: O(log^2 n) rounds whatever the
    shape, joins and sums by node; edges stay in the cluster, in partitions of
    EDGES_A_PARTITION.
    """
    edge = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = materialise(links.where("a <> b").select(edge("a", "b").alias("e")).select("e.*").distinct())
    rows, known = edges.count(), None
    while True:
        edges = _laid(edges, rows)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(edge("v", "m"), edge("u", "m"))).alias("e")).select("e.*")
        edges = materialise(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        rows = state[0]
        if state == known:
            break
        known = state
    star = _laid(edges, rows).select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e"))
    return materialise(star.select("e.*").distinct())


def _sized(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _possible(x: str, y: str, percent: int):
    """Whether two members of a large bucket can link if no small bucket holds both.

    A linking pair shares a shingle of both prefixes.  If that is in a large
    bucket, both prefixes reach large buckets, so all of their rare shingles
    (which come first) are in the prefixes; a rare shingle in common would be a
    small bucket of both.  So the overlap is what neither has as rare.
    """
    overlap = F.least(F.col(f"{x}n") - F.col(f"{x}rare"), F.col(f"{y}n") - F.col(f"{y}rare"))
    return overlap * 100 >= (F.col(f"{x}n") + F.col(f"{y}n") - overlap) * percent


def _part(cls: str = "cls", df: str = "df"):
    """The part of its bucket that a member belongs to."""
    return F.pmod(F.col(cls), 1 + F.floor(F.col(df) / PART))


def _every_part(df: str = "df"):
    """All parts of a bucket, for what meets all of its members."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(df) / PART)))


def class_components(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that link with another."""
    x, y = posts.alias("x"), posts.alias("y")
    few = x.where("not many").join(y.where("not many"), F.col("x.token") == F.col("y.token")).where((F.col("x.cls") < F.col("y.cls")) & _sized("x.n", "y.n", percent))
    # A linking pair shares min(level) shingles of its prefixes; those in large buckets are not counted here.
    met = few.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("x.level", "y.level")).alias("l"), F.first(F.least("x.large", "y.large")).alias("large"))
    pairs = met.where("c + large >= l").select("a", "b")
    members = posts.where("many").where(f"(n - rare) * 100 >= n * {percent}").select("token", "cls", "n", "rare", "df", _part().alias("part")).withColumn("comp", F.col("cls"))
    members = materialise(members)
    tried = comps = None

    def joined(found: DataFrame) -> DataFrame:
        """Components with new links: what is known enters as stars, so few rounds are left."""
        if comps is None:
            return connected(found)
        return comps if found.isEmpty() else connected(found.unionByName(comps.toDF("a", "b")))

    for _ in range(PIVOT_ROUNDS):
        # The pivot has the least share of rare shingles: of copies with edits, the one nearest to what they have in common.
        pivot = members.groupBy("token", "df").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), "cls", "n", "rare", "comp")).alias("p"))
        pivot = pivot.select("token", "p", _every_part().alias("part"))
        star = members.join(pivot, ["token", "part"]).where((F.col("cls") != F.col("p.cls")) & (F.col("comp") != F.col("p.comp")) & _possible("", "p.", percent))
        new = star.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()
        new = new if tried is not None else new.unionByName(pairs).distinct()
        new = new.join(tried, ["a", "b"], "left_anti") if tried is not None else new
        new = materialise(new)
        tried = new if tried is None else tried.unionByName(new)
        comps = joined(materialise(_verify(new, sets, percent)))
        left = members.join(pivot, ["token", "part"]).where(F.col("cls") != F.col("p.cls")).select("token", "cls", "n", "rare", "df", "part")
        left = left.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "n", "rare", "df", "part", F.coalesce("root", "cls").alias("comp"))
        # Buckets all of whose members are joined are done.
        open_ = left.groupBy("token", "df").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", _every_part().alias("part"))
        members = materialise(left.join(open_, ["token", "part"]))
    # What pivots left open is compared pair by pair, each pair at the first shingle that both share, if they share enough.
    own = posts.where("many").groupBy("cls").agg(F.collect_list("token").alias("own"), F.first("level").alias("level")).where(F.size("own") <= CARRIED)
    members = members.join(own, "cls", "left")
    # With f the part of a set that is not rare, an overlap of t of the union needs 1 / f + 1 / f' <= (1 + t) / t:
    # of two sets that link, one at least is nearly all in large buckets, and only such sets look for partners.
    pure = F.expr(f"(n - rare) * {100 + percent} >= 2 * n * {percent}")
    x, y = members.where(pure).drop("part").select("*", _every_part().alias("part")).alias("x"), members.withColumn("pure", pure).alias("y")
    shared = F.array_intersect("x.own", "y.own")
    once = (F.array_min(shared) == F.col("x.token")) & (F.size(shared) >= F.least("x.level", "y.level"))
    once = F.when(F.col("x.own").isNull() | F.col("y.own").isNull(), F.lit(True)).otherwise(once)
    open_pair = (~F.col("y.pure") | (F.col("x.cls") < F.col("y.cls"))) & (F.col("x.comp") != F.col("y.comp")) & _possible("x.", "y.", percent)
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part"))).where(open_pair & once)
    rest = rest.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return joined(materialise(_verify(rest, sets, percent)))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text) to doc_id, text_hash, n, root, component_id; root: a class of the component, null for empty sets."""
    narrow = written(describe_sets(docs, width), "sets")
    n_shards = shard_count(docs, 8 * (narrow.agg(F.sum("n")).first()[0] or 0))
    full = narrow.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("min_id"), F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    shared = shared_counts(docs, width, percent, n_shards)
    # The least level of any set that this one can link to.
    level = 1 + F.expr(f"((n * {percent} + 99) div 100) div 5")
    live = materialise(classes.join(shared, "cls").where(F.col("shared") >= level).select(F.col("cls"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")))
    sets = materialise(live_sets(docs, live, width, n_shards))
    chunks = _chunk_sets(sets)
    posts = materialise(_postings(chunks, count_and_reply(chunks, n_shards), percent))
    comps = class_components(posts, sets, percent)
    rooted = classes.select("cls", "min_id").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = rooted.groupBy("root").agg(F.min("min_id").alias("component_id"))
    by_class = rooted.join(component, "root").select("cls", "root", "component_id")
    return narrow.join(by_class, "cls", "left")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    component_id: the smallest id reachable by links.  A document without
    words or with a null text has an empty set, links with nothing and is its
    own component, as is every component whose ids are all null (component_id
    null).  Repeated rows and equal texts have equal sets and share a
    component.  An empty table gives no rows; other columns are ignored.
    """
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return _labelled(_plain(docs, id_col, text_col), width, percent).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = THRESHOLD, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` (all columns, whatever their names) with one row of each component: of the smallest id, null last, then of the smallest text hash.

    Rows without words, null texts among them, all stay.  Of rows equal in id
    and text one stays.  An empty table gives no rows.

    Only rows that a bit map of what goes calls for are shuffled with their
    texts; all others stay where they are.
    """
    labelled = _labelled(_plain(docs, id_col, text_col), width, percent).where("n > 0")
    keyed = materialise(labelled.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies")))
    first = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("s"))
    stays = first.select(F.col("s.doc_id").alias("i"), F.col("s.text_hash").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    goes = materialise(keyed.join(stays, same, "left_anti").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")))
    repeated = materialise(keyed.where("copies > 1").join(stays, same, "left_semi").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")))
    key = lambda i, h: F.xxhash64(F.coalesce(i, F.lit(0)), h)
    called = called_for(goes.unionByName(repeated).select(key(F.col("i"), F.col("h")).alias("h")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"))
    rows = rows.withColumn("called", called(key(F.col("doc_id"), F.col("text_hash"))))
    asked = rows.where("called").join(goes, same, "left_anti")
    out = rows.where("not called").select("row")
    if repeated.isEmpty():
        out = out.unionByName(asked.select("row"))
    else:
        once = asked.join(repeated, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
        out = out.unionByName(asked.join(repeated, same, "left_anti").select("row")).unionByName(once.select("row"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
