"""Editing by diff, and saving documents back."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import detect, odf, ooxml
from ..sources.tree import local, prefixed


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """(file_id, diff JSON) to file_id, path, new_text."""
    changed = F.from_json(F.get_json_object("diff", "$.modifiedText"), "map<string,string>")
    return diffs.select("file_id", F.explode(changed).alias("path", "new_text"))


def generate_diff(changes: DataFrame) -> DataFrame:
    """(file_id, path, new_text) to file_id, diff JSON."""
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "new_text"))))
    return changes.groupBy("file_id").agg(F.to_json(F.struct(packed.alias("modifiedText"))).alias("diff"))


def apply_diff(elements: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited elements, errors): text elements take their new text; a missing path or another element is an error."""
    edited = elements.join(changes.select("file_id", "path", "new_text"), ["file_id", "path"], "left")
    is_text = (F.col("element_type") == "text") & F.col("new_text").isNotNull()
    out = edited.withColumn("text", F.when(is_text, F.col("new_text")).otherwise(F.col("text"))).select(*elements.columns)
    there = elements.select("file_id", "path", "element_type")
    wrong = changes.join(there, ["file_id", "path"], "left").where("element_type is null or element_type <> 'text'")
    errors = wrong.select("file_id", "path", F.when(F.col("element_type").isNull(), "no such element").otherwise("not a text element").alias("error"))
    return out, errors


_TOKENS = re.compile(r"\t+|[ ]{2,}|(?:[^ \t]|(?<! )[ ](?! ))+")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, run): tabs, two or more spaces, and everything else."""
    return [("tabs" if t[0] == "\t" else "spaces" if t.startswith("  ") else "string", t) for t in _TOKENS.findall(text)]


class _OdfEditor:
    """Finds the runs of nodes that make one text element, in the reader's own order."""

    def __init__(self, data: bytes):
        self.reader = odf.Reader.__new__(odf.Reader)
        self.places: dict[str, tuple] = {}
        editor = self

        class Tracking(odf.Tree):
            def text(self, parent, text):
                odf.Tree.text(self, parent, text)
                if text and editor.at is not None:
                    row = self.rows[-1]
                    editor.places.setdefault(row["path"], []).append(editor.at)

        self.at = None
        reader = self.reader
        archive = zipfile.ZipFile(io.BytesIO(data))
        for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(archive.read("content.xml")), events=("start-ns",)):
            ElementTree.register_namespace(prefix, uri)
        reader.content = ElementTree.fromstring(archive.read("content.xml"))
        reader.styles_root = ElementTree.fromstring(archive.read("styles.xml")) if "styles.xml" in archive.namelist() else None
        reader.styles, reader.tree, reader.cells, reader.sheets, reader.counters, reader.kind = odf.Styles(reader.styles_root, reader.content), Tracking(), [], [], {}, None

        def children(node, parent, lists=()):
            if node.text:
                editor.at = (node, "text")
                reader._text(node, parent, node.text)
            for child in node:
                editor.at = (child, "node")
                reader.element(child, parent, lists)
                if child.tail:
                    editor.at = (child, "tail")
                    reader._text(node, parent, child.tail)

        reader.children = children
        body = next(n for n in reader.content.iter() if prefixed(n.tag, odf.SPACES) == "office:body")
        root = next(iter(body))
        reader.kind = prefixed(root.tag, odf.SPACES).removeprefix("office:")
        children(root, reader.tree.add(None, "root"))
        self.parents = {c: p for p in reader.content.iter() for c in p}

    def set(self, path: str, text: str) -> None:
        places = self.places.get(path)
        if not places:
            raise KeyError(path)
        namespace = "{" + next(u for u, p in odf.SPACES.items() if p == "text") + "}"
        first, kind = places[0]
        for node, how in places[1:]:
            if how == "tail":
                node.tail = None
            elif how == "node":
                self.parents[node].remove(node)
        if kind == "text":
            parent, at = first, 0
            first.text = ""
        elif kind == "tail":
            parent = self.parents[first]
            at = list(parent).index(first) + 1
            first.tail = ""
        else:
            parent = self.parents[first]
            at = list(parent).index(first)
            parent.remove(first)

        def append(string: str) -> None:
            if at == 0:
                parent.text = (parent.text or "") + string
            else:
                parent[at - 1].tail = (parent[at - 1].tail or "") + string

        for what, run in tokens(text):
            if what == "string":
                append(run)
                continue
            for piece in run if what == "tabs" else [run]:
                if what == "tabs":
                    node = ElementTree.Element(namespace + "tab")
                else:
                    node = ElementTree.Element(namespace + "s", {namespace + "c": str(len(piece))})
                parent.insert(at, node)
                at += 1


def save_odf(data: bytes, changes: dict[str, str]) -> bytes:
    """The archive with edited text: `mimetype` first and stored, other entries copied."""
    editor = _OdfEditor(data)
    for path, text in changes.items():
        editor.set(path, text)
    content = ElementTree.tostring(editor.reader.content, encoding="UTF-8", xml_declaration=True)
    source, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        if "mimetype" in source.namelist():
            target.writestr(zipfile.ZipInfo("mimetype"), source.read("mimetype"))
        for info in source.infolist():
            if info.filename != "mimetype":
                target.writestr(zipfile.ZipInfo(info.filename), content if info.filename == "content.xml" else source.read(info), compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def save_docx(data: bytes, changes: dict[str, str]) -> bytes:
    """The package with edited text in its document part."""
    source = zipfile.ZipFile(io.BytesIO(data))
    raw = source.read("word/document.xml")
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), events=("start-ns",)):
        ElementTree.register_namespace(prefix, uri)
    places: dict[str, list] = {}

    class Tracking(ooxml.Tree):
        now = None

        def text(self, parent, text):
            ooxml.Tree.text(self, parent, text)
            if text:
                places.setdefault(self.rows[-1]["path"], []).append(self.now)

    reader = ooxml.Text.__new__(ooxml.Text)
    package = ooxml.Package(data)
    reader.relations, reader.numbering, reader.counters, reader.tree = package.relations("word/document.xml"), ooxml.Numbering(package.xml("word/numbering.xml")), {}, Tracking()
    plain = ooxml.Text.element

    def element(node, parent):
        reader.tree.now = node
        plain(reader, node, parent)

    reader.element = element
    root = ElementTree.fromstring(raw)
    reader.blocks(next(n for n in root if local(n.tag) == "body"), reader.tree.add(None, "root"))
    parents = {c: p for p in root.iter() for c in p}
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for path, text in changes.items():
        nodes = places[path]
        parent = parents[nodes[0]]
        at = list(parent).index(nodes[0])
        for node in nodes:
            parents[node].remove(node)
        for kind, run in tokens(text):
            for piece in run if kind == "tabs" else [run]:
                node = ElementTree.Element(space + ("tab" if kind == "tabs" else "t"))
                if kind != "tabs":
                    node.text = piece
                    node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                parent.insert(at, node)
                at += 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            target.writestr(zipfile.ZipInfo(info.filename), ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if info.filename == "word/document.xml" else source.read(info), compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()


def save_documents(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """file_id, content, error: files with their diff (file_id, diff) applied. Types that cannot be saved are errors."""
    schema = pa.schema([("file_id", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, content, diff in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    changes = json.loads(diff or "{}").get("modifiedText", {})
                    kind = detect.candidates(content)[-1]
                    if kind in ("odt", "odp", "odg", "ods"):
                        saved = save_odf(content, changes)
                    elif kind == "docx":
                        saved = save_docx(content, changes)
                    else:
                        raise ValueError(f"{kind} cannot be saved")
                    rows.append({"file_id": file_id, "content": saved})
                except Exception as error:
                    rows.append({"file_id": file_id, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").join(diffs.select("file_id", "diff"), "file_id", "left").select("file_id", "content", "diff").mapInArrow(run, "file_id long, content binary, error string")
