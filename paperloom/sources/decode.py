"""Files to tables: elements, cells, sheets, styles, metadata, pages, segments. One pass each, no shuffle.

A file that cannot be decoded yields a row with `error`, or no rows; it never fails the job.  `errors` names every
such file and the reason, whatever table was asked for.
"""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from . import crypto, csvdoc, detect, encoding, legacy, odf, ooxml, pdf
from .memory import lean
from .tree import ELEMENTS, Tree, element_batch, ref


@dataclass(frozen=True)
class Options:
    """How files are opened: a type, or priorities among candidates; limits of size, pages and sheets."""

    as_type: str | None = None
    priority: tuple[str, ...] = ()
    csv: csvdoc.Options = csvdoc.Options()
    max_file_bytes: int = 1 << 30
    pages: tuple[int, int] | None = None
    sheets: tuple[int, int] | None = None
    password: str | None = None


class Unsupported(ValueError):
    """A type that is named but not decoded."""


class _Delimited:
    def __init__(self, data: bytes, options: csvdoc.Options):
        rows = csvdoc.read(data, options)
        width = max(map(len, rows), default=0)
        numeric = [False] * width
        import re

        from ..functions.sheets import NUMBER

        number = re.compile(NUMBER)
        for c in range(width):
            body = [r[c] for r in rows[1:] if c < len(r) and r[c]]
            numeric[c] = bool(body) and all(number.match(v) for v in body)
        self.kind, self.tree, self.cells = "spreadsheet", Tree(), []
        at = self.tree.add(self.tree.add(None, "root", attrs={"document": "spreadsheet"}), "sheet", name="csv")
        for r, fields in enumerate(rows):
            for c, text in enumerate(fields):
                is_float = numeric[c] and bool(number.match(text))
                box = self.tree.add(at, "sheet_cell", ref=ref(c, r), name=ref(c, r), value_type="float" if is_float else "string", row_span=1, col_span=1, is_covered=False, is_editable=False)
                self.tree.text(box, text)
                self.cells.append((0, r, c, text, "float" if is_float else "string", float(text) if is_float else None, 1, 1, False))
        self.sheets = [(0, "csv", len(rows), width, len(rows), width)]


class _Plain:
    def __init__(self, data: bytes):
        self.kind, self.tree, self.cells, self.sheets = "text", Tree(), [], []
        try:
            text = encoding.transcode(data, encoding.guess(data))
        except encoding.Undecodable:
            text = data.decode("utf-8", "replace")
        top = self.tree.add(None, "root", attrs={"document": "text"})
        for line in text.split("\n"):
            self.tree.text(self.tree.add(top, "paragraph"), line.removesuffix("\r"))


class _Xml:
    """All nodes of an XML file in document order."""

    def __init__(self, data: bytes):
        from xml.parsers import expat

        self.kind, self.tree, self.cells, self.sheets = "xml", Tree(), [], []
        text = encoding.transcode(data, encoding.declared(data) or encoding.guess(data))
        stack = [self.tree.add(None, "root", attrs={"document": "xml"})]
        held: list[str] = []
        parser = expat.ParserCreate("utf-8")

        def flush(kind: str = "pcdata") -> None:
            content = "".join(held)
            held.clear()
            if content.strip() or kind == "cdata":
                self.tree.add(stack[-1], kind, text=content)

        def refuse(*_) -> None:
            raise Unsupported("entity declarations")

        def start(name, attrs) -> None:
            flush()
            stack.append(self.tree.add(stack[-1], "element", name=name, attrs=attrs or None))

        def end(name) -> None:
            content = "".join(held)
            if content and not content.strip() and self.tree._children[stack[-1]] == 0:  # white space alone in a leaf is text
                self.tree.add(stack[-1], "pcdata", text=content)
                held.clear()
            flush()
            stack.pop()

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
        parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = flush, lambda: flush("cdata")
        parser.EntityDeclHandler = refuse
        parser.CommentHandler = lambda c: (flush(), self.tree.add(stack[-1], "comment", text=c))
        parser.ProcessingInstructionHandler = lambda t, d: (flush(), self.tree.add(stack[-1], "processing_instruction", name=t, text=d))
        parser.XmlDeclHandler = lambda v, e, s: self.tree.add(stack[-1], "declaration", attrs={"version": v, **({"encoding": e} if e else {})})
        parser.StartDoctypeDeclHandler = lambda n, s, p, h: self.tree.add(stack[-1], "doctype", name=n)
        parser.Parse(text.encode("utf-8"), True)


class _Pdf:
    """A paragraph for each line of each page."""

    def __init__(self, data: bytes, pages: tuple[int, int] | None, password: str | None = None):
        file = pdf.File(data, (password or "").encode("latin-1", "replace"))
        if file.encrypted:
            raise Unsupported("encrypted pdf")
        self.kind, self.tree, self.cells, self.sheets = "text", Tree(), [], []
        top = self.tree.add(None, "root", attrs={"document": "text"})
        for n, page in enumerate(file.pages()):
            if pages is None or pages[0] <= n < pages[1]:
                width, height = file.box(page)
                at = self.tree.add(top, "page", name=str(n + 1), attrs={"width": f"{width:g}pt", "height": f"{height:g}pt"})
                for line in pdf.Page(file, page).text().split("\n"):
                    if line:
                        self.tree.text(self.tree.add(at, "paragraph"), line)


def open_document(data: bytes, options: Options = Options()):
    """The first decoder that succeeds in order of preference: an object with kind, tree, cells, sheets."""
    found = detect.preferred([] if options.as_type else detect.candidates(data), options.as_type, options.priority)
    errors = []
    for kind in found:
        try:
            return kind, _open_as(kind, data, options)
        except (Unsupported, legacy.Encrypted):
            raise
        except Exception as error:
            errors.append(f"{kind}: {type(error).__name__}: {error}")
    raise Unsupported("; ".join(errors) or "no decoder")


def _open_as(kind: str, data: bytes, options: Options):
    if kind in ("odt", "odp", "ods", "odg"):
        import io

        if detect.odf_encrypted(zipfile.ZipFile(io.BytesIO(data))):
            if options.password is None:
                raise Unsupported("encrypted document")
            data = crypto.decrypt_odf(data, options.password)
        return odf.Reader(data)
    if kind in ("docx", "pptx", "xlsx"):
        return ooxml.reader(kind)(data)
    if kind in ("doc", "ppt", "xls"):
        return {"doc": legacy.TextDocument, "ppt": legacy.Presentation, "xls": legacy.Workbook}[kind](data)
    if kind == "ooxml_encrypted":
        if options.password is None:
            raise Unsupported("encrypted document")
        return open_document(crypto.decrypt_ooxml(data, options.password), options)[1]
    if kind == "csv":
        return _Delimited(data, options.csv)
    if kind in ("xml", "svg"):
        return _Xml(data)
    if kind == "pdf":
        return _Pdf(data, options.pages, options.password)
    if kind in ("txt", "json"):
        return _Plain(data)
    raise Unsupported(f"{kind} is named, not decoded")


#: Rows, and bytes of the files they come from, of one Arrow batch of results: small files share a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def _each(files: DataFrame, options: Options, schema: str, rows, pack, on_error=None) -> DataFrame:
    """mapInArrow over files: `rows(file_id, document)` yields rows, `pack` makes a record batch of many."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                try:
                    if data is None:
                        raise Unsupported("no content")
                    if len(data) > options.max_file_bytes:
                        raise Unsupported("file too large")
                    document = open_document(data, options)[1]
                except Exception as error:
                    if on_error is not None:
                        held.append(on_error(file_id, error))
                    continue
                for row in rows(file_id, document):
                    held.append(row)
                    if len(held) >= BATCH_ROWS:
                        yield pack(held)
                        held, size = [], 0
                del document
                size += len(data)
                if size >= BATCH_BYTES and held:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    return files.select("file_id", "content").mapInArrow(lean(run), schema)


def _packed(schema: pa.Schema):
    """Record batches of rows that are tuples."""
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def elements(files: DataFrame, options: Options = Options(), types: tuple[str, ...] | None = None) -> DataFrame:
    """The element trees of all documents; of `types` only, if given (`error` is one), so that the others need not leave their worker."""

    def failed(file_id, error):
        return file_id, {"element_type": "error", "text": f"{type(error).__name__}: {error}"}

    rows = lambda i, d: ((i, r) for r in d.tree.rows if types is None or r["element_type"] in types)
    return _each(files, options, ELEMENTS, rows, element_batch, failed if types is None or "error" in types else None)


def errors(files: DataFrame, options: Options = Options()) -> DataFrame:
    """file_id, error of the files that no decoder reads: those without rows in `cells`, `sheets` and `styles`, and broken or locked PDF files.

    A file beyond `max_file_bytes` is among them.
    """

    schema = pa.schema([("file_id", pa.int64()), ("error", pa.string())])
    return _each(files, options, "file_id long, error string", lambda i, d: (), _packed(schema), lambda i, error: (i, f"{type(error).__name__}: {error}"))


CELLS = "file_id long, sheet_ix int, row_ix int, col_ix int, ref string, text string, value_type string, num double, row_span int, col_span int, is_covered boolean"


def cells(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Present cells of all sheets of all documents."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
    schema = pa.schema([(f.split()[0], t) for f, t in zip(CELLS.split(", "), types)])

    def rows(file_id, document):
        return ((file_id, s, r, c, ref(c, r), *rest) for s, r, c, *rest in document.cells if options.sheets is None or options.sheets[0] <= s < options.sheets[1])

    return _each(files, options, CELLS, rows, _packed(schema))


def sheets(files: DataFrame, options: Options = Options()) -> DataFrame:
    schema = pa.schema([("file_id", pa.int64()), ("sheet_ix", pa.int32()), ("name", pa.string()), *[(c, pa.int32()) for c in ("n_rows", "n_cols", "used_rows", "used_cols")]])

    return _each(files, options, "file_id long, sheet_ix int, name string, n_rows int, n_cols int, used_rows int, used_cols int", lambda i, d: ((i, *s) for s in d.sheets), _packed(schema))


def styles(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Named styles with their resolved properties."""
    schema = pa.schema([("file_id", pa.int64()), ("style_name", pa.string()), ("family", pa.string()), ("parent_name", pa.string()), ("resolved", pa.map_(pa.string(), pa.string()))])

    def rows_of(file_id, document):
        if isinstance(document, odf.Reader):
            rows = document.style_rows()
        elif isinstance(document, ooxml.Text):
            rows = [(n, r["family"], r["parent"], document.styles.resolve(n)) for n, r in document.styles.named.items()]
        elif isinstance(document, ooxml.Workbook):
            rows = [(str(i), "cell", None, look) for i, look in enumerate(document.formats)]
        else:
            rows = []
        return ((file_id, n, f, p, list(r.items())) for n, f, p, r in rows)

    return _each(files, options, "file_id long, style_name string, family string, parent_name string, resolved map<string,string>", rows_of, _packed(schema))


META = ("title", "subject", "author", "creator", "keywords", "producer", "creation_date", "modification_date")


def meta(files: DataFrame) -> DataFrame:
    """Facts of each file: type, media type, encryption, entries, and up to eight strings (dates stay text)."""
    schema = pa.schema([("file_id", pa.int64()), *[(c, pa.string()) for c in ("file_type", "mimetype", "category", "document_type")], ("is_encrypted", pa.bool_()), ("entry_count", pa.int32()), *[(c, pa.string()) for c in META], ("error", pa.string())])

    def one(file_id, data):
        found = detect.candidates(data)
        kind = found[-1] if found else "unknown"
        fact = dims.file_type_rows()[kind]
        row = {"file_id": file_id, "file_type": kind, "mimetype": fact["mimetype"], "category": fact["category"], "document_type": fact["document_type"], "is_encrypted": detect.encryption_state(data, found) == "encrypted"}
        if kind in ("odt", "odp", "ods", "odg"):
            row |= odf.meta(data)
        elif kind in ("docx", "pptx", "xlsx"):
            row |= ooxml.meta(data)
        elif kind == "pdf":
            file = pdf.File(data)
            row["is_encrypted"] = file.encrypted
            if not file.encrypted:
                row |= file.meta() | {"entry_count": len(file.pages())}
        if kind not in ("pdf",) and fact["document_type"] in ("presentation", "spreadsheet", "drawing") and not row["is_encrypted"]:
            document = open_document(data)[1]
            row["entry_count"] = len(document.sheets) or sum(r["element_type"] in ("slide", "page") for r in document.tree.rows)
        return row

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows.append(one(file_id, content.as_py() or b""))
                except Exception as error:
                    rows.append({"file_id": file_id, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return files.select("file_id", "content").mapInArrow(run, ", ".join(f"{f.name} {kinds.get(f.type, 'string')}" for f in schema))


def meta_json(meta_rows: DataFrame) -> DataFrame:
    """file_id, json: what is null is left out."""
    document = F.when(F.col("document_type").isNotNull(), F.struct(F.col("document_type").alias("documentType"), F.col("entry_count").alias("entryCount"), *[F.col(c) for c in META]))
    return meta_rows.select("file_id", F.to_json(F.struct(F.col("file_type").alias("fileType"), F.col("category").alias("fileCategory"), F.col("is_encrypted").alias("isEncrypted"), document.alias("document"))).alias("json"))


def pdf_pages(files: DataFrame, pages: tuple[int, int] | None = None, password: str = "") -> DataFrame:
    """Pages of PDF files: page_ix, width, height, rotate, text; `pages` limits the range before text is read."""
    schema = pa.schema([("file_id", pa.int64()), ("page_ix", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rotate", pa.int32()), ("text", pa.string())])

    def rows(file_id, data):
        file = pdf.File(data, password.encode("latin-1", "replace"))
        for n, page in enumerate([] if file.encrypted else file.pages()):
            if pages is None or pages[0] <= n < pages[1]:
                width, height = file.box(page)
                yield {"file_id": file_id, "page_ix": n, "width": float(width), "height": float(height), "rotate": int(file.get(page.get("Rotate")) or 0), "text": pdf.Page(file, page).text()}

    return _pdf_rows(files, schema, "file_id long, page_ix int, width double, height double, rotate int, text string", rows)


def pdf_segments(files: DataFrame, pages: tuple[int, int] | None = None, password: str = "") -> DataFrame:
    """Text segments in paint order with their geometry and colour."""
    schema = pa.schema([("file_id", pa.int64()), ("page_ix", pa.int32()), ("seg_ix", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "end_x", "end_y", "size")], ("color", pa.string())])

    def rows(file_id, data):
        file = pdf.File(data, password.encode("latin-1", "replace"))
        for n, page in enumerate([] if file.encrypted else file.pages()):
            if pages is None or pages[0] <= n < pages[1]:
                for s, segment in enumerate(pdf.Page(file, page).segments):
                    yield dict(zip(schema.names, (file_id, n, s, segment[0], *map(float, segment[1:6]), segment[6])))

    return _pdf_rows(files, schema, "file_id long, page_ix int, seg_ix int, text string, x double, y double, end_x double, end_y double, size double, color string", rows)


def pdf_images(files: DataFrame, password: str = "") -> DataFrame:
    """Images named by the pages of PDF files; the bytes of those that pass through."""
    schema = pa.schema([("file_id", pa.int64()), ("page_ix", pa.int32()), ("name", pa.string()), *[(c, pa.int32()) for c in ("width", "height", "bits")], *[(c, pa.string()) for c in ("color_space", "filter", "mimetype")], ("content", pa.binary())])

    def rows(file_id, data):
        file = pdf.File(data, password.encode("latin-1", "replace"))
        for n, page in enumerate([] if file.encrypted else file.pages()):
            for image in pdf.images(file, page):
                yield {"file_id": file_id, "page_ix": n, **image}

    return _pdf_rows(files, schema, "file_id long, page_ix int, name string, width int, height int, bits int, color_space string, filter string, mimetype string, content binary", rows)


def pdf_links(files: DataFrame, password: str = "") -> DataFrame:
    schema = pa.schema([("file_id", pa.int64()), ("page_ix", pa.int32()), ("kind", pa.string()), ("target", pa.string())])

    def rows(file_id, data):
        file = pdf.File(data, password.encode("latin-1", "replace"))
        for n, page in enumerate([] if file.encrypted else file.pages()):
            for kind, target in pdf.links(file, page):
                yield {"file_id": file_id, "page_ix": n, "kind": kind, "target": target}

    return _pdf_rows(files, schema, "file_id long, page_ix int, kind string, target string", rows)


def _pdf_rows(files: DataFrame, schema: pa.Schema, ddl: str, rows) -> DataFrame:
    def run(batches):
        for batch in batches:
            held, size = [], 0
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    data = content.as_py()
                    if data and data.startswith(b"%PDF-"):
                        size += len(data)
                        for row in rows(file_id, data):
                            held.append(row)
                            if len(held) >= BATCH_ROWS:
                                yield pa.RecordBatch.from_pylist(held, schema)
                                held, size = [], 0
                except Exception:  # a broken file ends with the rows read so far
                    pass
                if held and size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("file_id", "content").mapInArrow(lean(run), ddl)


def infer_spaces(segments: DataFrame) -> DataFrame:
    """`segments` with space_before: a jump across of half an em or a gap along of a fifth, unless a space stands there."""
    w = Window.partitionBy("file_id", "page_ix").orderBy("seg_ix")
    em = F.greatest(F.lag("size").over(w), F.lit(1e-9))
    jump = F.abs(F.col("y") - F.lag("end_y").over(w)) > 0.5 * em
    gap = (F.col("x") - F.lag("end_x").over(w)) > 0.2 * em
    spaced = F.coalesce(F.lag("text").over(w).endswith(" "), F.lit(True)) | F.col("text").startswith(" ")
    return segments.withColumn("space_before", F.coalesce((jump | gap) & ~spaced, F.lit(False)))


def group_lines(segments: DataFrame) -> DataFrame:
    """`segments` with line_ix: a new line where the baseline moves by 0.6 of the size or the start falls back by half."""
    w = Window.partitionBy("file_id", "page_ix").orderBy("seg_ix")
    moved = F.abs(F.col("y") - F.lag("y").over(w)) > 0.6 * F.col("size")
    back = F.col("x") < F.lag("end_x").over(w) - 0.5 * F.col("size")
    return segments.withColumn("_new", F.coalesce(moved | back, F.lit(False)).cast("int")).withColumn("line_ix", F.sum("_new").over(w)).drop("_new")
