"""Functions and table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources import containers, csvdoc, detect, encoding
from .numbering import plain_number


@udtf(returnType="record int, field int, text string")
class CsvRecords:
    """csv_records(text, separator): one row per field."""

    def eval(self, text: str, separator: str):
        for r, fields in enumerate(csvdoc.records(text or "", separator)[0]):
            for c, value in enumerate(fields):
                yield r, c, value


@udtf(returnType="entry_path string, is_file boolean, size long, method string")
class ArchiveEntries:
    """archive_entries(content): one row per entry of a zip or compound file."""

    def eval(self, content: bytes):
        data = bytes(content or b"")
        if data[:4] == b"PK\x03\x04":
            for path, is_file, size, method, *_ in containers.zip_entries(data, bodies=False):
                yield path, is_file, size, method
        elif data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
            for path, is_file, size in containers.cfb_entries(data):
                yield path, is_file, size, "stored"


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL: detect_file_types, detect_encoding, json_valid, csv_probe, list_number, csv_records, archive_entries."""
    spark.udf.register("detect_file_types", detect.detect_file_types)
    spark.udf.register("detect_encoding", encoding.detect_encoding)
    spark.udf.register("json_valid", detect.json_valid)
    spark.udf.register("csv_probe", csvdoc.csv_probe)
    spark.udf.register("list_number", plain_number, "string")
    spark.udtf.register("csv_records", CsvRecords)
    spark.udtf.register("archive_entries", ArchiveEntries)
