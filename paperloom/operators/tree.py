"""Navigation of element trees: equality joins and filters on the flat table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "file_id"


def children_of(elements: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of the elements in `parents` (file_id, element_id), in order within each."""
    wanted = parents.select(KEY, F.col("element_id").alias("parent_id")).distinct()
    return elements.join(wanted, [KEY, "parent_id"], "left_semi")


def parent_of(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    wanted = nodes.where("parent_id is not null").select(KEY, F.col("parent_id").alias("element_id")).distinct()
    return elements.join(wanted, [KEY, "element_id"], "left_semi")


def with_siblings(elements: DataFrame) -> DataFrame:
    """`elements` with previous_sibling, next_sibling, first_child: ids, null on absence.

    A join on (parent, ordinal +- 1), so that a node with very many children
    is not sorted in one task.
    """
    node = elements.select(KEY, "parent_id", "ordinal", "element_id")
    before = node.select(KEY, "parent_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("element_id").alias("previous_sibling"))
    after = node.select(KEY, "parent_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("element_id").alias("next_sibling"))
    first = node.where("ordinal = 0").select(KEY, F.col("parent_id").alias("element_id"), F.col("element_id").alias("first_child"))
    return elements.join(before, [KEY, "parent_id", "ordinal"], "left").join(after, [KEY, "parent_id", "ordinal"], "left").join(first, [KEY, "element_id"], "left")


def descendants(elements: DataFrame, path: str) -> DataFrame:
    """All elements below a path, in reading order: a prefix filter, as paths carry their ancestors."""
    return elements.where(F.col("path").startswith(normal(path) + "/"))


def at_path(elements: DataFrame, path: str) -> DataFrame:
    return elements.where(F.col("path") == normal(path))


_COMPONENT = re.compile(r"child:(0|[1-9]\d*)|cell:[A-Z]+[1-9]\d*")


def parse_path(path: str) -> list[str]:
    """Components of a path; the empty path is the root."""
    if not path:
        return []
    if not path.startswith("/"):
        raise ValueError("a path begins with a slash")
    parts = path[1:].split("/")
    for part in parts:
        if not _COMPONENT.fullmatch(part):
            raise ValueError(f"no path component: {part}")
    return parts


def normal(path: str) -> str:
    return "".join("/" + p for p in parse_path(path))


def parent_path(path: Column) -> Column:
    """Path of the parent; null for the root."""
    return F.when(path != "", F.regexp_replace(path, "/[^/]*$", ""))


def path_components(path: Column) -> Column:
    """Array of struct(kind, value)."""
    return F.when(path == "", F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.transform(F.slice(F.split(path, "/"), 2, 1 << 20), lambda p: F.struct(F.substring_index(p, ":", 1).alias("kind"), F.substring_index(p, ":", -1).alias("value"))))


def text_of(elements: DataFrame) -> DataFrame:
    """Text of each file in reading order: file_id, text. Paragraphs are lines."""
    block = F.when(F.col("element_type") == "text", F.col("text")).when(F.col("element_type") == "line_break", F.lit("\n")).when(F.col("element_type").isin("paragraph", "list_item", "table_row"), F.lit("\n"))
    parts = elements.withColumn("_t", block).where("_t is not null").groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("element_id", "_t"))).alias("_p"))
    return parts.select(KEY, F.regexp_replace(F.array_join(F.transform("_p", lambda p: p["_t"]), ""), "^\n+", "").alias("text"))


def visible(elements: DataFrame) -> DataFrame:
    """file_id, element_id of elements with visible content: text that is not empty, or anything but text, span, link, bookmark.

    Every such element marks its ancestors, which its path names.
    """
    own = elements.where(~F.col("element_type").isin("span", "link", "bookmark", "text") | ((F.col("element_type") == "text") & (F.col("text") != "")))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    marked = own.select(KEY, F.explode(prefixes).alias("path")).distinct()
    return elements.join(marked, [KEY, "path"], "left_semi").select(KEY, "element_id")


def master_pages(elements: DataFrame) -> DataFrame:
    """file_id, element_id, master: of pages and slides the master they name, else the document's first."""
    first = elements.where("element_type = 'master_page'").groupBy(KEY).agg(F.min_by("name", "element_id").alias("_first"))
    pages = elements.where(F.col("element_type").isin("page", "slide"))
    return pages.join(first, KEY, "left").select(KEY, "element_id", F.coalesce(F.try_element_at("attrs", F.lit("master_page")), F.col("_first")).alias("master"))
