"""Documents as HTML: views of decoded files, and the resources they name."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import dims
from ..sources import decode, detect
from ..sources.tree import label

VIEWS = "file_id long, view_ix int, name string, path string, html string, error string"
RESOURCES = "file_id long, path string, mimetype string, content binary"


@dataclass(frozen=True)
class HtmlConfig:
    """Options of the projection."""

    document_output: str = "document.html"
    slide_output: str = "slide{index}.html"
    sheet_output: str = "sheet{index}.html"
    page_output: str = "page{index}.html"
    text_document_margin: bool = False
    sheet_limit: tuple[int, int] | None = (10_000, 500)
    sheet_limit_by_content: bool = True
    page_range: tuple[int, int] | None = None
    editable: bool = False
    embed_images: bool = True
    viewport: str = "automatic"
    viewport_content: str | None = None
    color_scheme: str = "light"
    title: str = ""


def escape_text(text: str) -> str:
    """As `functions.text.escape_text`, for decoders."""
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if text.startswith(" "):
        text = "&nbsp;" + text[1:]
    if text.endswith(" "):
        text = text[:-1] + "&nbsp;"
    return text.replace("  ", " &nbsp;").replace("\t", "&emsp;")


def escape_attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


#: CSS property of each style field.
_CSS = {
    "fo:font-size": "font-size", "fo:font-weight": "font-weight", "fo:font-style": "font-style", "fo:color": "color", "fo:background-color": "background-color",
    "style:font-name": "font-family", "fo:font-family": "font-family", "fo:text-align": "text-align", "fo:margin-top": "margin-top", "fo:margin-bottom": "margin-bottom",
    "fo:margin-left": "margin-left", "fo:margin-right": "margin-right", "fo:padding": "padding", "fo:border": "border", "fo:line-height": "line-height",
    "style:column-width": "width", "style:row-height": "height", "style:vertical-align": "vertical-align", "font_size": "font-size", "font_weight": "font-weight",
    "font_style": "font-style", "font_color": "color", "font_name": "font-family", "fo:border-left": "border-left", "fo:border-right": "border-right", "fo:border-top": "border-top", "fo:border-bottom": "border-bottom", "width": "width", "height": "height", "x": "left", "y": "top",
}


def css(properties: dict[str, str] | None) -> str:
    """Inline style of resolved properties; alignments of writing direction become sides."""
    out = []
    for name, value in (properties or {}).items():
        target = _CSS.get(name)
        if target and value and not re.search(r"[;{}<>]", value):
            value = {"start": "left", "end": "right"}.get(value, value) if target == "text-align" else value
            out.append(f"{target}:{value}")
    lines = [w for k, w in (("style:text-underline-style", "underline"), ("style:text-line-through-style", "line-through")) if (properties or {}).get(k, "none") != "none"]
    lines += [w for k, w in (("underline", "underline"), ("line_through", "line-through")) if (properties or {}).get(k) == "true"]
    if lines:
        out.append("text-decoration:" + " ".join(lines))
    return ";".join(out)


_TAGS = {"paragraph": "x-p", "span": "x-s", "group": "div", "frame": "div", "rect": "div", "line": "div", "circle": "div", "custom_shape": "div", "list_item": "div"}


class Renderer:
    """Writes an element and what is below it."""

    def __init__(self, document, config: HtmlConfig):
        self.rows, self.config = document.tree.rows, config
        self.below: dict[int | None, list[dict]] = {}
        for row in self.rows:
            self.below.setdefault(row["parent_id"], []).append(row)
        self.styles = getattr(document, "styles", None)
        self.cells = document.cells
        self.sheets = {s[0]: s for s in document.sheets}

    def inner(self, at: int) -> str:
        return "".join(map(self.element, self.below.get(at, ())))

    def _style(self, row: dict) -> str:
        found = self.styles.resolve(row.get("style_name")) if self.styles is not None and row.get("style_name") else {}
        style = css({**found, **(row.get("attrs") or {})})
        return f' style="{escape_attribute(style)}"' if style else ""

    def visible(self, row: dict) -> bool:
        kind = row["element_type"]
        if kind == "text":
            return bool(row.get("text"))
        if kind == "bookmark":
            return False
        if kind in ("span", "link"):
            return any(map(self.visible, self.below.get(row["element_id"], ())))
        return True

    def element(self, row: dict) -> str:
        kind, at = row["element_type"], row["element_id"]
        style = self._style(row)
        if kind == "text":
            path = f' data-path="{row["path"]}" contenteditable="true"' if self.config.editable and row.get("is_editable") else ""
            return f"<x-s{path}>{escape_text(row['text'])}</x-s>"
        if kind == "line_break":
            return "<br>"
        if kind == "page_break":
            return ""
        if kind == "bookmark":
            return f'<a id="{escape_attribute(row.get("name") or "")}"></a>'
        if kind == "link":
            return f'<a href="{escape_attribute(row.get("href") or "")}"{style}>{self.inner(at)}</a>'
        if kind == "paragraph":
            body = self.inner(at)
            if not any(map(self.visible, self.below.get(at, ()))):
                body += "<br>"
            return f"<x-p{style}>{body}</x-p>"
        if kind == "list":
            return f'<div role="list"{style}>{self.inner(at)}</div>'
        if kind == "list_item":
            marker = f'<span class="marker">{escape_text(row["list_marker"])}</span>' if row.get("list_marker") else ""
            return f'<div role="listitem">{marker}{self.inner(at)}</div>'
        if kind == "table":
            parts = self.below.get(at, ())
            columns = "".join(f"<col{self._style(c)}>" for c in parts if c["element_type"] == "table_column")
            return f"<table{style}>{columns}{''.join(self.element(r) for r in parts if r['element_type'] == 'table_row')}</table>"
        if kind == "table_row":
            return f"<tr{style}>{self.inner(at)}</tr>"
        if kind in ("table_cell",):
            return "" if row.get("is_covered") else f"<td{_spans(row)}{style}>{self.inner(at)}</td>"
        if kind == "image":
            return f'<img src="{escape_attribute(row.get("href") or "")}"{style}>'
        if kind in ("master_page",):
            return ""
        return f"<{_TAGS.get(kind, 'div')}{style}>{self.inner(at)}</{_TAGS.get(kind, 'div')}>"

    def sheet(self, row: dict, ix: int) -> str:
        """A grid with rulers: columns by letter, rows by number, within the limit and at least one cell."""
        told = self.sheets.get(ix, (ix, None, 0, 0, 0, 0))
        rows, cols = (told[4], told[5]) if self.config.sheet_limit_by_content else (told[2], told[3])
        if self.config.sheet_limit:
            rows, cols = min(rows, self.config.sheet_limit[0]), min(cols, self.config.sheet_limit[1])
        rows, cols = max(rows, 1), max(cols, 1)
        boxes = {r["name"]: r for r in self.below.get(row["element_id"], ()) if r["element_type"] == "sheet_cell"}
        head = "<tr><td></td>" + "".join(f"<td>{label(c)}</td>" for c in range(cols)) + "</tr>"
        taken: set[tuple[int, int]] = set()
        body = []
        for r in range(rows):
            line = [f"<td>{r + 1}</td>"]
            for c in range(cols):
                box = boxes.get(f"{label(c)}{r + 1}")
                if (r, c) in taken or box and box.get("is_covered"):
                    continue
                if not box:
                    line.append("<td></td>")
                    continue
                taken |= {(r + i, c + j) for i in range(box.get("row_span") or 1) for j in range(box.get("col_span") or 1)}
                kind = ' class="value-type-float"' if box.get("value_type") == "float" else ""
                line.append(f"<td{kind}{_spans(box)}{self._style(box)}>{self.inner(box['element_id'])}</td>")
            body.append(f"<tr>{''.join(line)}</tr>")
        return f"<table class=\"sheet\"><thead>{head}</thead><tbody>{''.join(body)}</tbody></table>"


def _spans(row: dict) -> str:
    out = f' rowspan="{row["row_span"]}"' if (row.get("row_span") or 1) > 1 else ""
    return out + (f' colspan="{row["col_span"]}"' if (row.get("col_span") or 1) > 1 else "")


def page(body: str, config: HtmlConfig, paged: bool, title: str = "") -> str:
    from ..functions.text import viewport

    scheme = "" if config.color_scheme == "light" else f'<meta name="color-scheme" content="{config.color_scheme}"/>'
    return f'<!DOCTYPE html><html><head><meta charset="UTF-8"/><title>{escape_text(title or config.title)}</title>{viewport(config.viewport, paged, config.viewport_content)}{scheme}</head><body>{body}</body></html>'


def xml_view(document) -> str:
    """All nodes, a line each, two spaces per depth; an element with text, or none below, on one line."""
    rows = document.tree.rows
    below: dict[int | None, list[dict]] = {}
    for row in rows:
        below.setdefault(row["parent_id"], []).append(row)
    plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def quoted(value: str) -> str:
        return f"'{value}'" if '"' in value and "'" not in value else '"' + value.replace('"', "&quot;") + '"'

    def head(row: dict) -> str:
        return row["name"] + "".join(f" {k}={quoted(v)}" for k, v in (row.get("attrs") or {}).items())

    def flat(row: dict) -> str:
        kind = row["element_type"]
        if kind == "pcdata":
            return row["text"]
        if kind == "cdata":
            return f"<![CDATA[{row['text']}]]>"
        if kind == "comment":
            return f"<!--{row['text']}-->"
        if kind == "processing_instruction":
            return f"<?{row['name']} {row['text']}?>"
        if kind == "declaration":
            return "<?xml" + "".join(f' {k}="{v}"' for k, v in row["attrs"].items()) + "?>"
        if kind == "doctype":
            return f"<!DOCTYPE {row['name']}>"
        kids = below.get(row["element_id"], ())
        return f"<{head(row)}>{''.join(map(flat, kids))}</{row['name']}>" if kids else f"<{head(row)}/>"

    def lines(row: dict, depth: int):
        kids = below.get(row["element_id"], ())
        if row["element_type"] == "element" and kids and not any(k["element_type"] in ("pcdata", "cdata") for k in kids):
            yield "  " * depth + f"<{head(row)}>"
            for kid in kids:
                yield from lines(kid, depth + 1)
            yield "  " * depth + f"</{row['name']}>"
        else:
            yield "  " * depth + flat(row)

    return "<pre>" + plain("\n".join(line for top in below.get(0, ()) for line in lines(top, 0))) + "</pre>"


def views_of(data: bytes, config: HtmlConfig = HtmlConfig()) -> list[tuple[str, str, str]]:
    """(name, path, html) of all views of a file."""
    kinds = detect.candidates(data)
    kind = kinds[-1] if kinds else "unknown"
    fact = dims.file_type_rows()[kind]
    if fact["category"] in ("image", "font", "audio", "video") and kind != "svg":
        if kind == "svm":
            from ..sources.svm import to_svg

            return [("document", config.document_output, page(to_svg(data), config, False))]
        url = f"data:{fact['mimetype']};base64,{base64.b64encode(data).decode()}"
        body = f'<img src="{url}">' if fact["category"] == "image" else f"<p>{escape_text(kind)}</p>"
        return [("document", config.document_output, page(body, config, False))]
    if fact["category"] == "archive":
        from ..sources.containers import zip_entries

        listed = [(p, n) for p, is_file, n, *_ in zip_entries(data, False) if is_file] if kind == "zip" else []
        body = "<ul>" + "".join(f"<li>{escape_text(p)} {n}</li>" for p, n in sorted(listed, key=lambda e: e[0].split("/"))) + "</ul>"
        return [("document", config.document_output, page(body, config, False))]
    _, document = decode.open_document(data, decode.Options(pages=config.page_range))
    if document.kind == "xml":
        return [("document", config.document_output, page(xml_view(document), config, False))]
    if kind in ("txt", "json"):
        text = [(r["text"] if (r := next((c for c in document.tree.rows if c["parent_id"] == p["element_id"]), None)) else "") for p in document.tree.rows if p["element_type"] == "paragraph"]
        body = '<div class="text">' + "".join(f'<div class="line" data-line="{i + 1}">{escape_text(t)}</div>' for i, t in enumerate(text)) + "</div>"
        return [("document", config.document_output, page(body, config, False))]
    renderer = Renderer(document, config)
    if document.kind == "text":
        return [("document", config.document_output, page(renderer.inner(0), config, kind == "pdf"))]
    parts, whole = [], []
    template = {"presentation": config.slide_output, "spreadsheet": config.sheet_output, "drawing": config.page_output}[document.kind]
    for row in renderer.below.get(0, ()):
        if row["element_type"] in ("slide", "sheet", "page"):
            ix = len(parts)
            body = renderer.sheet(row, ix) if row["element_type"] == "sheet" else f'<div class="{row["element_type"]}">{renderer.inner(row["element_id"])}</div>'
            whole.append(body)
            parts.append((row.get("name") or f"{row['element_type']}{ix + 1}", template.replace("{index}", str(ix)), page(body, config, True)))
    return [("document", config.document_output, page("".join(whole), config, True)), *parts]


def html_views(files: DataFrame, config: HtmlConfig = HtmlConfig()) -> DataFrame:
    """Views of all files: one `document`, and one for each slide, sheet or page."""
    schema = pa.schema([("file_id", pa.int64()), ("view_ix", pa.int32()), ("name", pa.string()), ("path", pa.string()), ("html", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [{"file_id": file_id, "view_ix": i, "name": n, "path": p, "html": h} for i, (n, p, h) in enumerate(views_of(content.as_py(), config))]
                except Exception as error:
                    rows = [{"file_id": file_id, "view_ix": 0, "error": f"{type(error).__name__}: {error}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").mapInArrow(run, VIEWS)


def html_resources(entries: DataFrame) -> DataFrame:
    """Images within archives as resources of their views, once per path."""
    images = entries.where("is_file and content is not null and mimetype like 'image/%'")
    from pyspark.sql import functions as F

    return images.select("file_id", F.substring("entry_path", 2, 1 << 20).alias("path"), "mimetype", "content").dropDuplicates(["file_id", "path"])


def locate(resources: DataFrame, config: HtmlConfig = HtmlConfig()) -> DataFrame:
    """`resources` with href: embedded ones as data URLs, others by their path."""
    from pyspark.sql import functions as F

    from ..functions.text import data_url

    return resources.withColumn("href", data_url(F.col("content"), F.col("mimetype")) if config.embed_images else F.col("path"))


def bring_offline(views: DataFrame, uri: str) -> DataFrame:
    """Write every view below `uri`/<file_id>/<path>; what was written. A repeated task writes the same bytes again."""

    def save(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            paths, sizes = [], []
            for file_id, path, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if html is None:
                    continue
                full = f"{base}/{file_id}/{path}"
                store.create_dir(full.rpartition("/")[0], recursive=True)
                raw = html.encode("utf-8", "replace")
                with store.open_output_stream(full, compression=None) as out:
                    out.write(raw)
                paths.append(full)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return views.select("file_id", "path", "html").mapInArrow(save, "path string, size long")
