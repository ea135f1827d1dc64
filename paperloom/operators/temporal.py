"""As-of lookups: the latest earlier row of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, strict: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """`left` with `value` of the right row of the key that is latest at (or before, if strict) its time.

    Both sides are laid in one sequence and the last value is carried forward:
    one shuffle and one sort by (key, time), no pairs.  Of right rows at one
    time the largest value counts; null values are no rows.

    `bucket` maps times to buckets that keep their order, such as days.  Then a
    key's sequence is split by bucket, so that one key with a great share of
    the rows is many tasks; the value in force at the start of a bucket comes
    from one row for each key and bucket.
    """
    part = bucket or (lambda t: F.lit(0))
    kind = dict(right.dtypes)[value]
    steps = left.drop(value).withColumns({"_value": F.lit(None).cast(kind), "_side": F.lit(0 if strict else 1)})
    marks = right.where(F.col(value).isNotNull()).select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(1 if strict else 0))
    both = steps.unionByName(marks, allowMissingColumns=True).withColumn("_part", part(F.col(at)))
    w = Window.partitionBy(key, "_part").orderBy(at, "_side", F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_now", F.last("_value", ignorenulls=True).over(w)).where(F.col("_side") == (0 if strict else 1))
    shared = [c for c in left.columns if c != value]
    if bucket is None:
        return carried.select(*shared, F.col("_now").alias(value))
    ends = marks.groupBy(key, part(F.col(at)).alias("_part")).agg(F.max(F.struct(F.col(at), F.col("_value")))["_value"].alias("_end"))
    places = steps.select(key, part(F.col(at)).alias("_part")).distinct().join(ends, [key, "_part"], "full")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = places.select(key, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    return carried.join(before, [key, "_part"], "left").select(*shared, F.coalesce("_now", "_before").alias(value))
