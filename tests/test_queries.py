"""Every registered query against its SQL at the smallest scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    if name not in plans.QUERIES and name not in entry.oracle_sql():
        pytest.skip("tested with its operator")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got
    if name in entry.oracle_sql():
        cursor = duck.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_as_of_takes_the_latest_earlier(spark):
    from paperloom.operators.temporal import as_of

    left = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 6, 60), (2, 3, 30)], "k int, t int, v int")
    get = lambda strict: [r.v for r in as_of(left, right, "k", "t", "v", strict).orderBy("x").collect()]
    assert get(False) == [50, 60, None] and get(True) == [None, 60, None]


def test_as_of_in_buckets_is_the_same(spark):
    import random

    from paperloom.operators.temporal import as_of

    rng = random.Random(3)
    left = spark.createDataFrame([(rng.randrange(3), rng.randrange(100), i) for i in range(200)], "k int, t int, i int")
    right = spark.createDataFrame([(rng.randrange(3), rng.randrange(100), rng.choice([None, *range(50)])) for _ in range(60)], "k int, t int, v int")
    for strict in (False, True):
        get = lambda **how: sorted((r.i, r.v) for r in as_of(left, right, "k", "t", "v", strict, **how).collect())  # noqa: B023, E731
        assert get() == get(bucket=lambda t: F.floor(t / 7))


def test_streamed_windows_equal_the_table(spark, tmp_path):
    from paperloom.streaming.windows import first_seen, run_to_table, windowed

    rows = spark.createDataFrame([(i % 7, f"2024-01-0{1 + i % 5} 0{i % 9}:30:00", i) for i in range(60)], "k int, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make = lambda df: windowed(df, "t", "12 hours", ["k"], [F.count("*").alias("n"), F.max("i").alias("top")], slide="6 hours")
    assert sorted(run_to_table(make(read()), str(tmp_path / "a")).collect()) == sorted(make(rows).collect())
    once = run_to_table(first_seen(read(), ["k"], "t", "30 days"), str(tmp_path / "b"), "append")
    assert sorted(r.k for r in once.collect()) == list(range(7))
