"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive (``.warc.zst``) starts with one skippable frame (magic 0x184D2A5D)
holding a dictionary built from the archive's records; every record follows as
a frame of its own, so a record can be read alone once the dictionary is known.
Payloads that occur again are written as `revisit` records without payload.

`write_archives` yields one row per archive; an archive closes at
`archive_bytes` of raw records, so a task holds one archive and no more.
Archives travel as rows of a Parquet table in the shared folder, whose commit
protocol survives lost tasks; `export_archives` writes them out as files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import called_for, materialise

SKIPPABLE = 0x184D2A5D
#: Raw bytes of an archive, bytes of its dictionary, and raw bytes that the dictionary is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 16 << 10, 2 << 20
#: Bytes of repeated digests up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
ARCHIVE_SCHEMA = "archive string, n_records long, raw_bytes long, content binary"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"
_DATE = "1970-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 100, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of rows whose payloads are equal and have `min_bytes` bytes or more, the
    one with the smallest id is the response; rows repeating that very id are
    responses too, as are rows with a null id.  A null payload is empty.  An
    empty table gives no rows; other columns are ignored.

    Digests that occur more than once are found first, from narrow rows.  Up
    to `broadcast_bytes` they go to the pages, and no payload moves.  Beyond,
    a bit map of them does, and only the payloads that it calls for are
    shuffled to be joined; adaptive execution splits a hot digest's side.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    narrow = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    firsts = materialise(narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.unhex("payload_digest").alias("repeated"), "first_id"))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    refers = F.when((F.col("payload_bytes") >= min_bytes) & (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to")
    same = F.unhex("payload_digest") == F.col("repeated")
    if firsts.count() * 64 <= broadcast_bytes:  # 40 bytes a digest and id, and what a hash table adds
        return rows.join(F.broadcast(firsts), same, "left").select(*columns, refers)
    called = called_for(firsts.select(F.xxhash64(F.lower(F.hex("repeated"))).alias("h")))(F.xxhash64("payload_digest"))
    rows = rows.withColumn("called", called)
    asked = rows.where("called").join(firsts, same, "left").select(*columns, refers)
    return rows.where("not called").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(asked)


def _record(page_id, url, payload: bytes | None, n_bytes: int, digest: str, refers) -> bytes:
    """One WARC/1.1 record; the payload follows an HTTP header, a revisit ends after it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """A dictionary from records spread evenly over the archive; raw content where too few to train."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    samples = [r[:65536] for r in records[::step]]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, k=200, d=8, steps=1).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def pack(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES, level: int = 3) -> bytes:
    """One archive: the dictionary in a leading skippable frame, then a frame for each record."""
    words = _dictionary(records, dictionary_bytes, sample_bytes)
    kept = zstandard.ZstdCompressor(level=level).compress(words)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(kept)), kept, *map(compressor.compress, records)])


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive must start with its dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    decompressor, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), memoryview(content)[8 + size :]
    while len(rest):
        one = decompressor.decompressobj()
        yield one.decompress(rest)
        rest = memoryview(one.unused_data)


def parse(record: bytes) -> dict:
    """Fields of one record; `intact` tells whether the payload has the digest in the header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s[10:-1]) if len(s) > 11 else None
    told = dict(line.split(": ", 1) for line in http.decode("ascii").split("\r\n")[1:])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"][7:]
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if not response else None,
        "payload_bytes": len(payload) if response else int(told["Content-Length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else digest,
        "payload": payload if response else None,
        "intact": not response or hashlib.sha256(payload).hexdigest() == digest,
    }


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES, level: int = 3) -> DataFrame:
    """Rows of `plan_records` to archives: archive (a content name), n_records, raw_bytes, content."""

    def close(held: list[bytes], raw: int) -> pa.RecordBatch:
        content = pack(held, dictionary_bytes, sample_bytes, level)
        name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([raw], pa.int64()), pa.array([content], pa.binary())], names=["archive", "n_records", "raw_bytes", "content"])

    def write(batches):
        held, raw = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(_record(*row))
                raw += len(held[-1])
                if raw >= archive_bytes:
                    yield close(held, raw)
                    held, raw = [], 0
        if held:
            yield close(held, raw)

    slim = records.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")
    return slim.mapInArrow(write, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in column `content`; payload is null for revisits, and everywhere without `payloads`."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in unpack(content.as_py()):
                    row = parse(record)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("content").mapInArrow(read, RECORD_SCHEMA)


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as a file below `uri` (any store that pyarrow opens); names and sizes of the files.

    A name is the digest of the content, so a task that runs again overwrites
    its own file with the same bytes.
    """

    def save(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_py()) for c in batch.column(1)], pa.int64())], names=["archive", "size"])

    return archives.select("archive", "content").mapInArrow(save, "archive string, size long")
