import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import warc
from paperloom.llm.shared import written

SCHEMA = "page_id long, url string, html string"


def run(spark, rows, **options):
    records = warc.plan_records(spark.createDataFrame(rows, SCHEMA).withColumns({"payload": F.lit(1), "refers_to": F.lit(2), "called": F.lit(3)}), **options)
    archives = written(warc.write_archives(records, archive_bytes=4000), "archives")
    return archives, warc.read_archives(archives).collect()


@pytest.mark.parametrize("broadcast_bytes", [warc.BROADCAST_BYTES, 0])
def test_round_trip(spark, broadcast_bytes):
    long = "<p>same text é</p>" * 40
    rows = [(i, f"http://h/{i}?a=%25", f"<html>{i} " + "lorem ipsum dolor " * (i % 30) + "</html>") for i in range(60)]
    rows += [(103, "u", long), (101, None, long), (105, "x\r\ny", long), (101, None, long), (200, "e", None), (201, "s", "short"), (202, "s", "short"), (None, "n", long), (300, "big", "z" * 2_000_000)]
    archives, got = run(spark, rows, broadcast_bytes=broadcast_bytes)
    assert archives.count() > 3 and all(bytes(r.content[:4]) == b"\x5d\x2a\x4d\x18" for r in archives.collect())
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page_id, url, html in rows:
        for r in by[page_id]:
            raw = (html or "").encode()
            assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
            repeated = html == long and page_id in (103, 105)
            assert (r.record_type, r.refers_to) == (("revisit", 101) if repeated else ("response", None))
            assert r.payload is None if repeated else bytes(r.payload) == raw


def test_empty_table_and_export(spark, tmp_path):
    archives, got = run(spark, [])
    assert got == []
    archives, _ = run(spark, [(1, "u", "a" * 500), (2, "u", "b" * 500)])
    names = warc.export_archives(archives, f"file://{tmp_path}").collect()
    for r in names:
        content = (tmp_path / r.archive).read_bytes()
        assert len(content) == r.size
        assert all(warc.parse(record)["intact"] for record in warc.unpack(content))
