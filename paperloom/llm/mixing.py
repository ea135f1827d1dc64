"""Mixing sources to target weights by hash-threshold histograms (native expressions only).

Every row has a 60-bit hash of its id and text.  Sizes are summed by source and hash
bucket; the bucket in which a source's budget ends is the only one refined by
the next 12 bits, and so on.  A row is then taken or not by comparing its hash
with its source's threshold: no sort of rows, no row leaves its partition, and
a hot source is pre-aggregated to at most `2**bits` rows per task.

Rows whose hash equals the threshold cell (36 bits: one row, or repeated rows)
share what is left of the budget in proportion to their sizes, each rounded
down to words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Per-source tables up to this many rows are broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: Column, text: Column) -> Column:
    """60 bits of MD5 of the id as text, a bar and the text (null: empty), as a long."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """`df`, written, with `number`: the place of each row in order, from 0; no task sees more than its range of rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes, before, offsets = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}, 0, []
    for i in range(n):  # a number for each range
        offsets.append(before)
        before += sizes.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), (part + 1).cast("int"))
    return placed.withColumn("number", offset + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, get `weights` in turn.  A common
    level L solves sum(min(cap * size, weight * L)) = share * total: the fixed
    point of resharing every excess by weight.  It is found by rounds of sums:
    sources that the level so far would fill leave, and the rest share what is
    left, until none leaves; there are hardly ever more than ten rounds.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.col("number") % len(weights)
    rows = numbered(by_source, F.col("source").isNull(), F.col("source")).select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("weight"),
        (F.col("source_size") * cap).cast("double").alias("cap"),
    )
    level, known = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") / F.col("weight") <= level
        sums = rows.agg(F.sum("source_size").cast("double").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if sums["n"] == known or not sums["open"]:
            break
        known, level = sums["n"], (sums["all"] * share - (sums["filled"] or 0.0)) / sums["open"]
    open_ = F.lit(None).cast("double") if level is None or not sums["open"] else F.lit(level)
    return rows.select("source", "source_size", F.when(open_.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * open_)).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def mix_plan(sized: DataFrame, weights=(3, 1, 2), share=1.5, cap=2, bits=12, levels=3) -> DataFrame:
    """One row per source: source, source_size, target, base, edge, rest, edge_size.

    `sized`: source, size, hash.  A row whose hash prefix is below `edge` is
    taken `base + 1` times, at `edge` `base` times and its part of `rest`,
    above it `base` times.
    """
    budget = F.floor("target").cast("long")
    plan = source_targets(sized, tuple(weights), share, cap).withColumn("base", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialise(plan.withColumn("rest", budget - F.col("base") * F.col("source_size")).withColumn("edge", F.lit(0).cast("long")))
    n = plan.count()
    for level in range(1, levels + 1):
        prefix = F.shiftright("hash", 60 - bits * level)
        edges = _small(plan.select(F.col("source").alias("of"), F.col("edge").alias("parent"), "rest"), n)
        inside = sized.join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright(prefix, bits) == F.col("parent")))
        cells = inside.groupBy("source", "rest", prefix.alias("cell")).agg(F.sum("size").alias("cell_size"))
        before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
        edge = cells.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("cell_size")))
        edge = edge.select(F.col("source").alias("of"), F.col("cell").alias("edge"), (F.col("rest") - F.col("before")).alias("rest"), F.col("cell_size").alias("edge_size"))
        kept = plan.select("source", "source_size", "target", "base")
        plan = materialise(kept.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumns({"edge": F.coalesce("edge", F.lit(-1)), "rest": F.coalesce("rest", F.lit(0))}))
    return plan


def apply_plan(rows: DataFrame, plan: DataFrame, bits=12, levels=3) -> DataFrame:
    """`rows` (any columns besides source, size, hash) with source_size, target, taken."""
    plan = plan.select(F.col("source").alias("_of"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "base", "edge", "rest", "edge_size")])
    cell = F.shiftright("hash", 60 - bits * levels)
    part = F.expr("size * _rest div _edge_size")
    extra = F.when(cell < F.col("_edge"), F.col("size")).when(cell == F.col("_edge"), part).otherwise(0)
    joined = rows.join(_small(plan, plan.count()), F.col("source").eqNullSafe(F.col("_of")), "left")
    taken = (F.col("_base") * F.col("size") + extra).cast("long")
    return joined.withColumns({"source_size": F.col("_source_size"), "target": F.col("_target"), "taken": taken}).drop("_of", "_source_size", "_target", "_base", "_edge", "_rest", "_edge_size")


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `docs`.

    Null text: size 0, taken 0.  A null source is a source of its own, the
    last.  Rows equal in id and text have one hash and are taken alike.  An empty table gives no rows.  Extra columns are ignored.
    """
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")))
    return apply_plan(sized, mix_plan(sized, weights, share, cap)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of `docs` that the mix takes words of, with all their columns and size, source_size, target, taken.

    `docs` must have doc_id, text and source.  Its own columns named like the
    four results are replaced; all others stay, whatever their names.  Nulls,
    repeated rows and empty tables are as of `mix_sources`; rows of which
    nothing is taken, those without words among them, go.
    """
    results = ("size", "source_size", "target", "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))
    plan = mix_plan(materialise(keyed.select("source", "size", "hash")), weights, share, cap)
    return apply_plan(keyed, plan).where(F.col("taken") > 0).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in results], *results)
