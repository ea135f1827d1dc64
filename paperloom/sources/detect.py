"""File type detection: signatures, containers, text kinds."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .. import dims
from . import containers, csvdoc, encoding

HEAD_BYTES = 64
#: Signatures in order, `??` any byte; the first that matches names the type.
SIGNATURES = (
    ("zip", "504B0304"),
    ("cfb", "D0CF11E0A1B11AE1"),
    ("pdf", "255044462D"),
    ("png", "89504E470D0A1A0A"),
    ("jpg", "FFD8FFDB"),
    ("jpg", "FFD8FFE000104A4649460001"),
    ("jpg", "FFD8FFEE"),
    ("jpg", "FFD8FFE1????457869660000"),
    ("bmp", "424D"),
    ("gif", "474946383761"),
    ("gif", "474946383961"),
    ("svm", "56434C4D5446"),
    ("rtf", "7B5C72746631"),
    ("wpd", "FF575043"),
    ("otf", "4F54544F"),
    ("ttf", "00010000"),
    ("ttf", "74727565"),
    ("ttf", "74746366"),
    ("webp", "52494646????????57454250"),
    ("wav", "52494646????????57415645"),
    ("avi", "52494646????????41564920"),
    ("ftyp", "????????66747970"),
    ("tiff", "49492A00"),
    ("tiff", "4D4D002A"),
    ("mkv", "1A45DFA3"),
    ("ogg", "4F676753"),
    ("flac", "664C6143"),
    ("mp3", "494433"),
    ("mp3", "FFFB"),
    ("mp3", "FFF3"),
    ("mp3", "FFF2"),
    ("mp3", "FFFA"),
    ("ico", "00000100"),
    ("ico", "00000200"),
    ("jp2", "0000000C6A5020200D0A870A"),
    ("jp2", "FF4FFF51"),
    ("jxl", "0000000C4A584C200D0A870A"),
    ("psd", "38425053"),
    ("wmf", "D7CDC69A"),
    ("wmf", "010009000003"),
    ("wmf", "020009000003"),
    ("emf", "01000000" + "??" * 36 + "20454D46"),
    ("jxl", "FF0A"),
)
#: Brands of the ISO base media format; others are mp4.
BRANDS = (("mov", ("qt  ",)), ("3gp", ("3g",)), ("avif", ("avif", "avis")), ("heif", ("hei", "hev", "mif1", "msf1")), ("m4a", ("M4A", "M4B")))


#: The signatures as one expression, a group for each; the first that matches counts, as in their order.
_SIGNATURE = re.compile(b"|".join(b"(" + b"".join(b"." if pattern[i : i + 2] == "??" else re.escape(bytes([int(pattern[i : i + 2], 16)])) for i in range(0, len(pattern), 2)) + b")" for _, pattern in SIGNATURES), re.DOTALL)


def magic(head: bytes) -> str:
    """Type of the first bytes; `unknown` if no signature matches."""
    m = _SIGNATURE.match(head)
    if m is None:
        return "unknown"
    name = SIGNATURES[m.lastindex - 1][0]
    if name != "ftyp":
        return name
    brand = head[8:12].decode("latin-1")
    return next((kind for kind, starts in BRANDS if brand.startswith(starts)), "mp4") if len(brand) == 4 else "mp4"


def magic_type(content: Column) -> Column:
    """The same as a native expression over the first 64 bytes of a binary column."""
    head = F.substring(F.hex(F.substring(content, 1, HEAD_BYTES)), 1, 2 * HEAD_BYTES)
    out = F.lit("unknown")
    for name, pattern in reversed(SIGNATURES):
        if "?" not in pattern:
            hit = head.startswith(pattern)
        else:
            hit = head.rlike("^" + pattern.replace("?", "."))
        if name == "ftyp":
            brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
            kind = F.lit("mp4")
            for label, starts in reversed(BRANDS):
                for s in starts:
                    kind = F.when(brand.startswith(s) & (F.length(brand) == 4), label).otherwise(kind)
            out = F.when(hit, kind).otherwise(out)
        else:
            out = F.when(hit, name).otherwise(out)
    return out


def is_json(data: bytes) -> bool:
    """The whole of the bytes is one strict JSON value."""

    def refuse(text):
        raise ValueError(text)

    try:
        json.loads(data.decode("utf-8"), parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


def xml_root(data: bytes, guessed: str | None = None) -> str | None:
    """Name of the root element (with namespace) if the bytes are XML once transcoded; null if not."""
    try:
        text = encoding.transcode(data, encoding.declared(data) or guessed or encoding.guess(data))
    except encoding.Undecodable:
        return None
    names: list[str] = []

    def refuse(*_):
        raise ValueError("entity declarations")

    parser = expat.ParserCreate("utf-8", namespace_separator="}")
    parser.StartElementHandler = lambda name, _: names or names.append(name)
    parser.EntityDeclHandler = refuse
    body = text.lstrip("\ufeff")
    if body.startswith("<?xml"):
        body = body[body.find("?>") + 2 :]
    try:
        parser.Parse(body.encode("utf-8"), True)
    except (expat.ExpatError, ValueError):
        return None
    return names[0] if names else None


ODF_KINDS = {"text": "odt", "presentation": "odp", "spreadsheet": "ods", "graphics": "odg"}
_STAROFFICE = {"application/vnd.sun.xml.writer": "odt", "application/vnd.sun.xml.impress": "odp", "application/vnd.sun.xml.calc": "ods", "application/vnd.sun.xml.draw": "odg"}


def odf_type_of_mimetype(mimetype: str) -> str | None:
    """Templates and StarOffice types fold into the four."""
    mimetype = mimetype.strip()
    if mimetype in _STAROFFICE:
        return _STAROFFICE[mimetype]
    prefix = "application/vnd.oasis.opendocument."
    if mimetype.startswith(prefix):
        return ODF_KINDS.get(mimetype[len(prefix) :].split("-")[0])
    return None


def odf_type(archive: zipfile.ZipFile) -> str | None:
    """Type of an OpenDocument archive: the `mimetype` entry, overridden by the manifest's root."""
    names = set(archive.namelist())
    if not names & {"content.xml", "META-INF/manifest.xml", "mimetype"}:
        return None
    kind = odf_type_of_mimetype(archive.read("mimetype").decode("latin-1")) if "mimetype" in names else None
    if "META-INF/manifest.xml" in names:
        try:
            root = ElementTree.fromstring(archive.read("META-INF/manifest.xml"))
            for entry in root.iter():
                own = {k.rpartition("}")[2]: v for k, v in entry.attrib.items()}
                if own.get("full-path") == "/":
                    kind = odf_type_of_mimetype(own.get("media-type", "")) or kind
        except ElementTree.ParseError:
            pass
    return kind


def odf_encrypted(archive: zipfile.ZipFile) -> bool:
    return "META-INF/manifest.xml" in archive.namelist() and b"encryption-data" in archive.read("META-INF/manifest.xml")


def ooxml_type(names: set[str]) -> str | None:
    """Type of an Office Open XML package by its main part."""
    for name, part in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")):
        if part in names:
            return name
    return None


def legacy_type(streams: set[str]) -> str | None:
    for name, stream in (("doc", "/WordDocument"), ("ppt", "/PowerPoint Document"), ("xls", "/Workbook"), ("xls", "/Book")):
        if stream in streams:
            return name
    return None


def candidates(data: bytes) -> list[str]:
    """All types the bytes can be opened as, from general to specific; none for a container that does not open."""
    kind = magic(data[:HEAD_BYTES])
    if kind == "zip":
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError):
            return []
        found = ["zip", odf_type(archive), ooxml_type(set(archive.namelist()))]
        return [f for f in found if f]
    if kind == "cfb":
        try:
            streams = {path for path, is_file, _ in containers.cfb_entries(data) if is_file}
        except containers.BadContainer:
            return []
        found = ["cfb", legacy_type(streams), "ooxml_encrypted" if {"/EncryptionInfo", "/EncryptedPackage"} <= streams else None]
        return [f for f in found if f]
    if kind != "unknown":
        return [kind]
    found = ["txt"]
    guessed = encoding.guess(data)
    if csvdoc.sniff(data, guessed) is not None:
        found.append("csv")
    if is_json(data):
        found.append("json")
    root = xml_root(data, guessed)
    if root is not None:
        found.append("xml")
        if root.rpartition("}")[2] == "svg":
            found.append("svg")
    return found


def preferred(types: list[str], as_type: str | None = None, priority: tuple[str, ...] = ()) -> list[str]:
    """Order in which decoders are tried: an explicit type alone; else specific first, listed ones before others."""
    if as_type:
        return [as_type]
    rank = {t: i for i, t in enumerate(priority)}
    return sorted(reversed(types), key=lambda t: rank.get(t, len(rank)))


def encryption_state(data: bytes, types: list[str]) -> str:
    if "ooxml_encrypted" in types:
        return "encrypted"
    if any(t in types for t in ODF_KINDS.values()):
        return "encrypted" if odf_encrypted(zipfile.ZipFile(io.BytesIO(data))) else "not_encrypted"
    if "pdf" in types:
        from . import pdf

        return "encrypted" if b"/Encrypt" in data and "Encrypt" in pdf.File(data).trailer else "not_encrypted"
    return "not_encrypted" if types else "unknown"


DETECTED = "file_id long, file_types array<string>, file_type string, mimetype string, category string, document_type string, encoding string, encryption_state string, error string"


def detect(files: DataFrame) -> DataFrame:
    """One row per file: candidates, the most specific type and its facts. A file that cannot be read gets an error, not a failure."""
    schema = pa.schema([("file_id", pa.int64()), ("file_types", pa.list_(pa.string())), *[(c, pa.string()) for c in ("file_type", "mimetype", "category", "document_type", "encoding", "encryption_state", "error")]])

    def run(batches):
        types = dims.file_type_rows()
        for batch in batches:
            rows = []
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = {"file_id": file_id, "file_types": [], "error": None}
                data = content.as_py()
                if data is None:
                    rows.append(row | {"file_type": "unknown", "encryption_state": "unknown", "error": "no content"})
                    continue
                try:
                    found = candidates(data)
                    last = types[found[-1]] if found else types["unknown"]
                    row |= {"file_types": found, "file_type": last["name"], "mimetype": last["mimetype"], "category": last["category"], "document_type": last["document_type"], "encryption_state": encryption_state(data, found)}
                    if found and found[0] == "txt":
                        row["encoding"] = encoding.declared(data) or encoding.guess(data) if "xml" in found else encoding.guess(data)
                    if not found:
                        row["error"] = "container does not open"
                except Exception as error:  # one bad file must not fail the job
                    row |= {"file_type": "unknown", "encryption_state": "unknown", "error": f"{type(error).__name__}: {error}"}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").mapInArrow(run, DETECTED)


@F.pandas_udf(ArrayType(StringType()))
def detect_file_types(content: pd.Series) -> pd.Series:
    """Column function: candidate types of a binary column."""
    return content.map(lambda b: [] if b is None else candidates(bytes(b)))


@F.pandas_udf(BooleanType())
def json_valid(content: pd.Series) -> pd.Series:
    """Column function: the bytes are one strict JSON value."""
    return content.map(lambda b: None if b is None else is_json(bytes(b)))


def detect_mimetype(content: Column) -> Column:
    """Column function: media type of the most specific candidate; null if there is none."""
    names = dims.file_type_rows()
    known = F.create_map(*[F.lit(x) for r in names.values() if r["mimetype"] for x in (r["name"], r["mimetype"])])
    return F.try_element_at(known, F.try_element_at(detect_file_types(content), F.lit(-1)))


def file_capabilities(detected: DataFrame) -> DataFrame:
    """Capabilities of each file: its type's, opened, to decrypt only if encrypted, to html only if not."""
    types = dims.file_types(detected.sparkSession).select(F.col("name").alias("file_type"), "capabilities")
    locked = F.col("encryption_state") == "encrypted"
    c = lambda n: F.coalesce(F.col(f"capabilities.{n}"), F.lit(False))
    return detected.join(F.broadcast(types), "file_type", "left").select(
        "file_id",
        "file_type",
        F.struct(
            c("detect_by_content").alias("detect_by_content"),
            F.lit(True).alias("open"),
            (c("decrypt") & locked).alias("decrypt"),
            (c("translate_html") & ~locked).alias("translate_html"),
            (c("color_scheme") & c("translate_html") & ~locked).alias("color_scheme"),
            (c("edit") & ~locked).alias("edit"),
            (c("save") & ~locked).alias("save"),
            F.lit(False).alias("encrypt"),
        ).alias("capabilities"),
    )
