"""`spark.read.format("docs")`: a folder of files as one of the decoded tables."""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import decode, tree

_TABLES = {"elements": tree.ELEMENTS, "cells": decode.CELLS}


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocsDataSource(DataSource):
    """Options: path (a folder every executor sees), table (elements or cells), bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "docs"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "elements")] + ", file_path string"

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.types = options, None

    def pushFilters(self, filters):
        """Filters on the path are applied to the listing; the others are left to Spark."""
        for f in filters:
            if type(f).__name__ == "EqualTo" and tuple(f.attribute) == ("file_path",):
                self.options.setdefault("only", []).append(f.value)
            else:
                yield f

    def partitions(self):
        root = self.options["path"].removeprefix("file://")
        found = sorted(p for p in glob.glob(os.path.join(root, "**"), recursive=True) if os.path.isfile(p) and all(p == o for o in self.options.get("only", ())))
        limit, tasks, size = int(self.options.get("bytespertask", 64 << 20)), [[]], 0
        for path in found:
            size += os.path.getsize(path)
            if size > limit and tasks[-1]:
                tasks.append([])
                size = os.path.getsize(path)
            tasks[-1].append(path)
        return [_Paths(t) for t in tasks]

    def read(self, partition):
        import xxhash

        table = self.options.get("table", "elements")
        names = [f.split()[0] for f in _TABLES[table].split(", ")]
        for path in partition.paths:
            with open(path, "rb") as file:
                data = file.read()
            # As the files table has it: xxhash64 of the path with the seed of the built-in function.
            file_id = (xxhash.xxh64_intdigest(path.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
            try:
                _, document = decode.open_document(data)
            except Exception:
                continue
            if table == "cells":
                for s, r, c, *rest in document.cells:
                    yield (file_id, s, r, c, tree.ref(c, r), *rest, path)
            else:
                for row in document.tree.rows:
                    yield (file_id, *[row.get(n) for n in names[1:]], path)


def register(spark) -> None:
    """Make the format known; filters on file_path reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocsDataSource)


__all__ = ["DocsDataSource", "register"]
