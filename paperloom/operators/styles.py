"""Styles: field-wise override and parent chains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override(base: Column, top: Column, fields: list[str]) -> Column:
    """Struct of `fields`: what the top sets wins."""
    return F.struct(*[F.coalesce(top[f], base[f]).alias(f) for f in fields])


def _sources(parents: list[int | None], filled: list[bool]) -> list[int | None]:
    """For each place the nearest one up its chain, itself included, that is filled. A chain is walked once; a cycle ends where it closes."""
    unknown, walked = -1, -2
    found: list[int | None] = [i if full else unknown for i, full in enumerate(filled)]
    for i in range(len(parents)):
        path, at = [], i
        while at is not None and found[at] == unknown:
            found[at] = walked
            path.append(at)
            at = parents[at]
        end = None if at is None or found[at] == walked else found[at]
        for p in path:
            found[p] = end
    return found


def resolve(styles: DataFrame, fields: list[str], keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """`styles` (keys, style_name, parent_name, fields) with every field resolved through the parents.

    One shuffle: a document's styles, whose names differ, are followed in one
    task in time linear in their number, however long their chains; a cycle
    ends where it closes.
    """

    def run(table: pa.Table) -> pa.Table:
        place = {name: i for i, name in enumerate(table.column("style_name").to_pylist()) if name is not None}
        parents = [place.get(name) for name in table.column("parent_name").to_pylist()]
        for field in fields:
            held = table.column(field)
            held = held.take(pa.array(_sources(parents, held.is_valid().to_pylist()), pa.int64()))
            table = table.set_column(table.schema.get_field_index(field), table.schema.field(field), held)
        return table

    return styles.groupBy(*keys).applyInArrow(run, styles.schema)
