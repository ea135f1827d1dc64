"""Delimited text: dialect probe, record reader, cells."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.sheets import value_types
from . import encoding as enc

#: Separators tried, in the order that breaks ties; agreement that makes a table; the punctuation test.
CANDIDATES = (",", ";", "\t", "|")
MIN_AGREEMENT, PUNCTUATION_SHARE, PUNCTUATION_LENGTH = 0.9, 0.9, 12


@dataclass(frozen=True)
class Options:
    """What is not given is detected."""

    encoding: str | None = None
    separator: str | None = None
    quote: str | None = None

    def __post_init__(self):
        for c in (self.separator, self.quote):
            if c is not None and len(c) != 1:
                raise ValueError("separator and quote are single characters")
        if self.separator in ("\r", "\n"):
            raise ValueError("a line break cannot separate fields")
        if self.separator is not None and self.separator == (self.quote or '"'):
            raise ValueError("separator and quote must differ")


@dataclass(frozen=True)
class Probe:
    """Verdict on a sample: its separator, modal field count, share of records that have it."""

    separator: str
    columns: int
    records: int
    agreement: float
    directive: bool

    @property
    def is_csv(self) -> bool:
        return self.columns >= 1 if self.directive else self.columns >= 2 and self.agreement >= MIN_AGREEMENT


def records(text: str, separator: str, quote: str = '"') -> tuple[list[list[str]], bool]:
    """(records, unterminated): a quote toggles anywhere in a field, a doubled one inside quotes is a quote.

    Returns are dropped outside quotes, an empty line is no record, one of an
    empty quoted field is; the end of text within quotes still ends a record.
    """
    out: list[list[str]] = []
    fields: list[str] = []
    field: list[str] = []
    quoted = seen = False
    at, n = 0, len(text)
    stops = re.compile("[" + re.escape(separator + quote) + "\r\n]")
    while at < n:
        c = text[at]
        if quoted:
            end = text.find(quote, at)
            if end < 0:
                field.append(text[at:])
                break
            field.append(text[at:end])
            if text.startswith(quote, end + 1):
                field.append(quote)
                at = end + 2
            else:
                quoted = False
                at = end + 1
            continue
        if c == quote:
            quoted = seen = True
        elif c == separator:
            fields.append("".join(field))
            field.clear()
            seen = True
        elif c == "\n":
            if seen or field:
                fields.append("".join(field))
                out.append(fields)
            fields, seen = [], False
            field.clear()
        elif c != "\r":
            stop = stops.search(text, at)
            end = stop.start() if stop else n
            field.append(text[at:end])
            at = end
            continue
        at += 1
    if seen or field or fields or quoted:
        fields.append("".join(field))
        out.append(fields)
    return out, quoted


def directive(text: str) -> str | None:
    """Separator named by a leading `sep=X` line."""
    return text[4] if text.startswith("sep=") and len(text) > 5 and text[5] in "\r\n" else None


def _punctuation(rows: list[list[str]]) -> bool:
    """Separators that are punctuation of prose: fields after the first begin with a space and are long."""
    rest = [f for r in rows for f in r[1:]]
    if not rest:
        return False
    spaced = sum(f.startswith(" ") for f in rest)
    return spaced >= PUNCTUATION_SHARE * len(rest) and sum(len(f.strip(" \t")) for f in rest) // len(rest) >= PUNCTUATION_LENGTH


@lru_cache(maxsize=2)  # a file is probed when its type is found and again when it is read
def probe(text: str, complete: bool = True, quote: str = '"') -> Probe | None:
    """Dialect of a sample; null if no candidate makes a table."""
    named = directive(text)
    if named is not None:
        rows, _ = records(text[5:].lstrip("\r\n"), named, quote)
        counts = Counter(map(len, rows))
        top = min((k for k, c in counts.items() if c == max(counts.values())), default=0)
        return Probe(named, top, len(rows), counts[top] / len(rows) if rows else 0.0, True)
    best = None
    for separator in CANDIDATES:
        if separator not in text:  # every record would be one field
            continue
        rows, open_ = records(text, separator, quote)
        if complete and open_:
            continue
        if not complete:
            rows = rows[:-1]
        if len(rows) < 2:
            continue
        counts = Counter(map(len, rows))
        most = max(counts.values())
        columns = min(k for k, c in counts.items() if c == most)
        if columns < 2 or _punctuation(rows):
            continue
        found = Probe(separator, columns, len(rows), most / len(rows), False)
        if best is None or (found.agreement, found.columns) > (best.agreement, best.columns):
            best = found
    return best


def sniff(data: bytes, guessed: str | None = None) -> Probe | None:
    """The probe of a file's first 64 KiB if it says csv."""
    try:
        text = enc.transcode(data[: enc.PROBE_BYTES], guessed or enc.guess(data))
    except enc.Undecodable:
        return None
    found = probe(text, complete=len(data) <= enc.PROBE_BYTES)
    return found if found and found.is_csv else None


def resolve(data: bytes, options: Options = Options()) -> Options:
    """All options, given or detected."""
    encoding = options.encoding or enc.guess(data)
    quote = options.quote or '"'
    separator = options.separator
    if separator is None:
        try:
            found = probe(enc.transcode(data[: enc.PROBE_BYTES], encoding), len(data) <= enc.PROBE_BYTES, quote)
        except enc.Undecodable:
            found = None
        separator = found.separator if found else ","
    return Options(encoding, separator, quote)


def read(data: bytes, options: Options = Options()) -> list[list[str]]:
    """All records of a file. A directive is skipped unless the separator was given."""
    full = resolve(data, options)
    text = enc.transcode(data, full.encoding)
    if options.separator is None and directive(text) is not None:
        text = text[5:].lstrip("\r\n")
    return records(text, full.separator, full.quote)[0]


CELLS = "file_id long, sheet_ix int, row_ix int, col_ix int, text string"


def csv_cells(files: DataFrame, options: Options = Options(), typed: bool = True) -> DataFrame:
    """Present cells of delimited files: file_id, sheet_ix, row_ix, col_ix, text, then value_type and num.

    Cells stream out of the decoder in batches; types are aggregated per
    column in Spark.  An undecodable file has no cells.
    """

    def run(batches):
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content is None:
                    continue
                try:
                    rows = read(content, options)
                except (enc.Undecodable, ValueError):
                    continue
                held: list[tuple] = []
                for r, fields in enumerate(rows):
                    held += [(file_id, 0, r, c, f) for c, f in enumerate(fields)]
                    if len(held) >= 20_000:
                        yield _cells(held)
                        held = []
                if held:
                    yield _cells(held)

    cells = files.select("file_id", "content").mapInArrow(run, CELLS)
    return value_types(cells) if typed else cells


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file_id", "sheet_ix", "row_ix", "col_ix", "text"])


def sheets(cells: DataFrame) -> DataFrame:
    """The one sheet of each file: name csv, records and widest record."""
    return cells.groupBy("file_id", "sheet_ix").agg(F.lit("csv").alias("name"), (F.max("row_ix") + 1).alias("n_rows"), (F.max("col_ix") + 1).alias("n_cols"))


_PROBE = StructType([StructField("separator", StringType()), StructField("columns", IntegerType()), StructField("records", IntegerType()), StructField("agreement", DoubleType()), StructField("directive", BooleanType()), StructField("is_csv", BooleanType())])


@F.pandas_udf(_PROBE)
def csv_probe(text: pd.Series) -> pd.DataFrame:
    """Column function: the probe's verdict on complete text."""
    found = [None if t is None else probe(t) for t in text]
    return pd.DataFrame([(None,) * 5 + (False,) if p is None else (p.separator, p.columns, p.records, p.agreement, p.directive, p.is_csv) for p in found], columns=["separator", "columns", "records", "agreement", "directive", "is_csv"])


def write(rows, separator: str = ",", quote: str = '"') -> str:
    """Records as text: fields with separators, quotes or line breaks are quoted."""

    def cell(value) -> str:
        text = "" if value is None else str(value)
        return quote + text.replace(quote, quote * 2) + quote if any(c in text for c in (separator, quote, "\n", "\r")) else text

    return "".join(separator.join(map(cell, row)) + "\n" for row in rows)
