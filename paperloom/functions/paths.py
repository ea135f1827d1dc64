"""Path algebra as column functions, in Arrow batches; null in, null out, and null for what has no answer."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..sources import containers


def _each(function: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    def one(*values):
        if None in values:
            return None
        try:
            return function(*values)
        except ValueError:
            return None

    return pa.array([one(*values) for values in zip(*(c.to_pylist() for c in columns))], kind)


@F.arrow_udf(StringType())
def _normal(path: pa.Array) -> pa.Array:
    return _each(containers.normal_path, pa.string(), path)


@F.arrow_udf(StringType())
def _parent(path: pa.Array) -> pa.Array:
    return _each(containers.parent_path, pa.string(), path)


@F.arrow_udf(StringType())
def _join(base: pa.Array, path: pa.Array) -> pa.Array:
    return _each(containers.join_path, pa.string(), base, path)


@F.arrow_udf(StringType())
def _root(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each(containers.common_root, pa.string(), a, b)


@F.arrow_udf(StringType())
def _rebase(path: pa.Array, base: pa.Array) -> pa.Array:
    return _each(containers.rebase_path, pa.string(), path, base)


@F.arrow_udf(BooleanType())
def _escaping(path: pa.Array) -> pa.Array:
    return _each(containers.is_escaping, pa.bool_(), path)


def normal_path(path: Column) -> Column:
    return _normal(path)


def parent_path(path: Column) -> Column:
    """Null for the root."""
    return _parent(path)


def join_path(base: Column, path: Column) -> Column:
    return _join(base, path)


def common_root(a: Column, b: Column) -> Column:
    return _root(a, b)


def rebase_path(path: Column, base: Column) -> Column:
    return _rebase(path, base)


def is_escaping(path: Column) -> Column:
    return _escaping(path)


def basename(path: Column) -> Column:
    """The last part of a normal path, a native expression."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last point of the name, if it is not the first character."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
