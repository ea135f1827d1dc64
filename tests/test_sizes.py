"""What must hold as tables grow: units, lengths of chains, sizes of entries, even tasks."""

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import styles
from paperloom.plans import builders, formats, queries
from paperloom.sources import containers, crypto, csvdoc, decode, pdf


def test_human_size_stops_at_the_largest_unit_asked_for(spark):
    row = spark.range(1).select(F.lit(5 << 40).alias("n")).select(text.human_size(F.col("n")).alias("a"), text.human_size(F.col("n"), largest="GiB").alias("b")).first()
    assert (row.a, row.b) == ("5.0 TiB", "5120.0 GiB")


def test_style_chains_of_any_length_need_one_shuffle(spark):
    n = 3000
    rows = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").cast("string").alias("style_name"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_name"), F.when(F.col("id") == 0, 7).alias("size"))
    out = styles.resolve(rows, ["size"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert out.where("size = 7").count() == n


def test_style_cycles_end_where_they_close(spark):
    rows = spark.createDataFrame([(1, "a", "b", None), (1, "b", "c", 5), (1, "c", "a", None), (1, "d", "e", None), (1, "e", "d", None), (1, "f", "gone", None)], "file_id int, style_name string, parent_name string, size int")
    assert {r.style_name: r["size"] for r in styles.resolve(rows, ["size"]).collect()} == {"a": 5, "b": 5, "c": 5, "d": None, "e": None, "f": None}


@pytest.mark.parametrize("n", [0, 1, 65_535, 65_536, 200_001])
def test_archives_of_long_runs_are_whole_and_small(n):
    made = builders.zip_with_run("/top.txt", b"top", "/d/leaf.png", n)
    archive = zipfile.ZipFile(io.BytesIO(made))
    assert archive.testzip() is None and archive.namelist() == ["top.txt", "d/leaf.png"]
    assert archive.read("top.txt") == b"top" and archive.read("d/leaf.png") == b"x" * n and len(made) < 400 + n / 200


def test_archives_of_a_large_key_are_small():
    assert len(formats._tree_zip(5_000_000, "Customer")) < 50_000


def test_digests_read_whole_bodies_in_pieces(spark):
    broken = bytearray(containers.write_zip([("a.txt", b"abc" * 50, None), ("b.png", b"b", None)]))
    broken[broken.index(b"abc")] ^= 1
    files = [(1, bytearray(builders.zip_with_run("/t.txt", b"top", "/l.png", 700_000))), (2, broken), (3, bytearray(builders.compound({"A": b"a"}))), (4, bytearray(b"PK\3\4x"))]
    df = spark.createDataFrame(files, "file_id long, content binary")
    rows = {(r.file_id, r.entry_path): r for r in containers.digests(df).collect()}
    assert rows[1, "/t.txt"].sha256 == hashlib.sha256(b"top").hexdigest()
    assert (rows[1, "/l.png"].length, rows[1, "/l.png"].sha256) == (700_000, hashlib.sha256(b"x" * 700_000).hexdigest())
    assert "CRC" in rows[2, "/a.txt"].error and rows[2, "/a.txt"].length is None and rows[2, "/b.png"].length == 1
    assert rows[3, "/A"].length == 4096 and rows[4, None].error
    texts = {(r.file_id, r.entry_path): r for r in containers.digests(df, ("text/plain",)).collect()}
    assert texts[1, "/l.png"].sha256 is None and texts[1, "/l.png"].length == 700_000 and texts[1, "/t.txt"].sha256


def test_files_made_from_rows_are_dealt_evenly(spark, tmp_path):
    """A table in one row group, whatever its splits, decodes in tasks of equal size."""
    spark.range(4000).select("id", F.lit("n").alias("name")).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        made = queries.per_row(spark.read.parquet(str(tmp_path / "t")), lambda name: name.encode(), "name", key="id")
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / spark.sparkContext.defaultParallelism / queries.TASKS_A_CORE


class _Task:
    """Stands for a table: keeps what a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def _batches(table, contents):
    task = _Task()
    table(task)
    return list(task.run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(contents)), pa.int64()), pa.array(contents, pa.binary())], names=["file_id", "content"])])))


@pytest.mark.parametrize("table", [decode.elements, decode.cells, decode.sheets])
def test_small_files_share_a_batch(table):
    made = _batches(table, [builders.xlsx([[str(i), i]]) for i in range(100)])
    assert len(made) <= 2 and set(pa.Table.from_batches(made).column("file_id").to_pylist()) == set(range(100))


def test_small_pdf_files_share_a_batch_and_large_ones_do_not():
    small = _batches(decode.pdf_pages, [builders.pdf(f"text {i}") for i in range(100)])
    assert len(small) == 1 and small[0].column(5).to_pylist() == [f"text {i}" for i in range(100)]
    noise = b"%" + b"y" * decode.BATCH_BYTES + b"\n"
    assert len(_batches(decode.pdf_pages, [builders.pdf("a") + noise, builders.pdf("b") + noise])) == 2


def test_widths_are_read_at_once(monkeypatch):
    calls, read = [], pdf.Lexer.object
    monkeypatch.setattr(pdf.Lexer, "object", lambda self: (calls.append(1), read(self))[1])
    page = builders.pdf_page(b"BT /F1 10 Tf 40 700 Td (a) Tj ET").replace(b"startxref", b"startxrex")
    assert pdf.Page(pdf.File(page), pdf.File(page).pages()[0]).text() == "a" and len(calls) < 300


def test_arrays_of_numbers_and_others():
    read = lambda b: pdf.Lexer(b).object()
    assert read(b"[1 -2\n+3]") == [1, -2, 3] and read(b"[ 1\0 2 ]") == [1, 2] and read(b"[]") == [] and read(b"[1 % 2 3\n4]") == [1, 4]
    assert read(b"[1 0 R 2]") == [pdf.Ref((1, 0)), 2] and read(b"[1 .5 2.]") == [1, 0.5, 2.0] and read(b"[1/A(b)]") == [1, "A", b"b"]


def test_cipher_works_on_words():
    key, block = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")
    sealed = crypto.Aes(key).encrypt(block)
    assert sealed.hex() == "8ea2b7ca516745bfeafc49904b496089" and crypto.Aes(key).decrypt(sealed) == block
    assert all(isinstance(w, int) and len(k) == 4 for k in crypto.Aes(key).keys for w in k)


def test_sketch_and_count_share_no_group(spark):
    """No sketch for each customer: the distinct rows come first."""
    plan = formats.customers_approximately(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower().replace("approx_count_distinct", "") and plan.count("Aggregate") == 2


def test_shown_elements_are_decoded_once(spark):
    plan = formats.visible_elements(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_elements_of_given_types(spark):
    df = spark.createDataFrame([(1, bytearray(b"a,b\n1,2\n")), (2, None)], "file_id long, content binary")
    assert [(r.file_id, r.element_type) for r in decode.elements(df, types=("root",)).collect()] == [(1, "root")]
    assert sorted((r.file_id, r.element_type) for r in decode.elements(df, types=("root", "error")).collect()) == [(1, "root"), (2, "error")]


def test_separators_that_are_absent_are_not_tried(monkeypatch):
    tried, read = [], csvdoc.records
    monkeypatch.setattr(csvdoc, "records", lambda text, separator, quote: (tried.append(separator), read(text, separator, quote))[1])
    assert csvdoc.probe("name;key\nabc;1\n").separator == ";" and tried == [";"]
    assert csvdoc.probe("one\ntwo\n") is None
