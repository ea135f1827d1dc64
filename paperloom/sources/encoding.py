"""Text encodings: detection and transcoding to UTF-8 strings."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..dims import encoding_by_name, is_decodable

PROBE_BYTES = 64 << 10
#: Byte order marks; the four-byte ones come before the two-byte ones they begin with.
_MARKS = ((b"\xff\xfe\x00\x00", "UTF-32LE"), (b"\x00\x00\xfe\xff", "UTF-32BE"), (b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
#: Names of Python's codecs where they differ from ours.
_CODECS = {"windows-874": "cp874", "x-mac-cyrillic": "mac_cyrillic", "macintosh": "mac_roman", "IBM866": "cp866"}
_OWN_MARK = {"UTF-8": b"\xef\xbb\xbf", "UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff", "UTF-32LE": b"\xff\xfe\x00\x00", "UTF-32BE": b"\x00\x00\xfe\xff"}
_DECLARED = re.compile(rb"""^(?:\xef\xbb\xbf)?<\?xml[^>]*?\sencoding\s*=\s*["']([^"']+)["']""", re.S)


class Undecodable(ValueError):
    """An encoding that is known by name only, or not at all."""


def bom(data: bytes) -> str | None:
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    return None


def guess(data: bytes) -> str | None:
    """A mark decides; else valid UTF-8; else windows-1252, which reads any bytes.

    Only the first 64 KiB count.  A null byte without a mark is no text: null.
    """
    head = data[:PROBE_BYTES]
    named = bom(head)
    if named or not head:
        return named or "UTF-8"
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(head, final=len(data) <= PROBE_BYTES)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    if b"\x00" in head:
        return None
    return "windows-1252"


def declared(data: bytes) -> str | None:
    """Encoding named by an XML declaration in the first 1024 bytes, if it is a known one."""
    m = _DECLARED.match(data[:1024])
    return encoding_by_name(m.group(1).decode("latin-1")) if m else None


def transcode(data: bytes, encoding: str | None) -> str:
    """Text of bytes: the encoding's own mark is stripped, what is invalid becomes U+FFFD."""
    name = encoding_by_name(encoding)
    if name is None or not is_decodable(name):
        raise Undecodable(f"cannot decode {encoding}")
    mark = _OWN_MARK.get(name)
    if mark and data.startswith(mark):
        data = data[len(mark) :]
    return data.decode(_CODECS.get(name, name), errors="replace")


@F.pandas_udf(StringType())
def detect_encoding(content: pd.Series) -> pd.Series:
    """Column function: encoding of a binary column's bytes (pass the first 64 KiB)."""
    return content.map(lambda b: None if b is None else guess(bytes(b)))


def to_utf8(content: Column, encoding: Column | str) -> Column:
    """Column function: text of bytes in an encoding; null where it cannot be decoded."""
    encoding = F.lit(encoding) if isinstance(encoding, str) else encoding
    return _transcoded(content, encoding)


@F.pandas_udf(StringType())
def _transcoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(b, e):
        if b is None or e is None:
            return None
        try:
            return transcode(bytes(b), e)
        except Undecodable:
            return None

    return pd.Series([one(b, e) for b, e in zip(content, encoding)], dtype=object)
