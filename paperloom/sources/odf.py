"""OpenDocument: text, presentations, spreadsheets, drawings."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from ..functions.numbering import Counter
from .tree import Cursor, Tree, attributes, prefixed, ref

_NS = "urn:oasis:names:tc:opendocument:xmlns:"
SPACES = {f"{_NS}{n}:1.0": p for n, p in (("office", "office"), ("text", "text"), ("table", "table"), ("drawing", "draw"), ("style", "style"), ("xsl-fo-compatible", "fo"), ("svg-compatible", "svg"), ("presentation", "presentation"), ("meta", "meta"))} | {"http://www.w3.org/1999/xlink": "xlink", "http://purl.org/dc/elements/1.1/": "dc"}

#: Elements that stand for themselves.
_PLAIN = {
    "text:p": "paragraph", "text:h": "paragraph", "text:span": "span", "text:line-break": "line_break", "text:a": "link", "draw:a": "link",
    "text:bookmark": "bookmark", "text:bookmark-start": "bookmark", "text:index-title": "group", "text:table-of-content": "group",
    "text:illustration-index": "group", "text:index-body": "group", "text:date": "group", "text:time": "group", "text:section": "group",
    "draw:text-box": "group", "text:soft-page-break": "page_break", "draw:frame": "frame", "draw:g": "frame", "draw:image": "image",
    "draw:rect": "rect", "draw:line": "line", "draw:circle": "circle", "draw:custom-shape": "custom_shape", "style:master-page": "master_page",
    "draw:page": "page",
}
_NUM_FORMATS = {"1": "decimal", "a": "letter_lower", "A": "letter_upper", "i": "roman_lower", "I": "roman_upper", "": "none"}
_STYLE_NAMES = ("text:style-name", "draw:style-name", "table:style-name", "presentation:style-name")
_ROW_GROUPS = {"table:table-header-rows", "table:table-rows", "table:table-row-group"}
_COLUMN_GROUPS = {"table:table-header-columns", "table:table-columns", "table:table-column-group"}


class Styles:
    """Named styles of both parts, later ones first; properties resolve through parents, else the family's default."""

    def __init__(self, *roots):
        self.named: dict[str, dict] = {}
        self.default: dict[str, dict] = {}
        self.lists: dict[str, dict[int, dict]] = {}
        self.masters: list[str] = []
        for root in roots:
            if root is None:
                continue
            for node in root.iter():
                tag = prefixed(node.tag, SPACES)
                own = attributes(node, SPACES)
                if tag in ("style:style", "style:default-style"):
                    properties: dict[str, str] = {}
                    for child in node:
                        properties |= attributes(child, SPACES)
                    row = {"family": own.get("style:family"), "parent": own.get("style:parent-style-name"), "properties": properties, "master": own.get("style:master-page-name")}
                    if tag == "style:style":
                        self.named[own.get("style:name", "")] = row
                    else:
                        self.default[own.get("style:family", "")] = row
                elif tag == "text:list-style":
                    self.lists[own.get("style:name", "")] = self._levels(node)
                elif tag == "style:master-page":
                    self.masters.append(own.get("style:name", ""))

    @staticmethod
    def _levels(node) -> dict[int, dict]:
        out: dict[int, dict] = {}
        for child in node:
            own = attributes(child, SPACES)
            tag = prefixed(child.tag, SPACES)
            level = int(own.get("text:level", "1") or 1) - 1
            if tag == "text:list-level-style-number":
                shown = max(1, int(own.get("text:display-levels", "1") or 1))
                numbers = ".".join(f"%{n + 1}" for n in range(max(0, level + 1 - shown), level + 1))
                fmt = _NUM_FORMATS.get(own.get("style:num-format", ""), "decimal")
                out[level] = {"fmt": fmt, "label": (own.get("style:num-prefix", "") + numbers + own.get("style:num-suffix", "")) if fmt != "none" else "", "start": int(own.get("text:start-value", "1") or 1)}
            elif tag in ("text:list-level-style-bullet", "text:list-level-style-image"):
                out[level] = {"fmt": "bullet", "label": own.get("text:bullet-char", "•"), "start": 1}
        return out

    def resolve(self, name: str | None) -> dict[str, str]:
        """Properties of a style: parents first, its own last; a cycle ends where it closes."""
        chain, seen = [], set()
        while name and name in self.named and name not in seen:
            seen.add(name)
            chain.append(self.named[name])
            name = self.named[name]["parent"]
        out: dict[str, str] = {}
        if chain:
            base = self.default.get(chain[-1]["family"] or "")
            if base and not chain[-1]["parent"]:
                out |= base["properties"]
        for row in reversed(chain):
            out |= row["properties"]
        return out

    def level(self, name: str | None, level: int) -> dict:
        levels = self.lists.get(name or "", {})
        if not levels:
            return {"fmt": "bullet", "label": "•", "start": 1}
        return levels.get(level) or levels[max(levels)]


class Reader:
    """One document: its tree, its sheets' cells."""

    def __init__(self, data: bytes):
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        part = lambda n: ElementTree.fromstring(archive.read(n)) if n in names else None
        self.content, self.styles_root = part("content.xml"), part("styles.xml")
        self.styles = Styles(self.styles_root, self.content)
        self.tree, self.cells, self.sheets = Tree(), [], []
        self.counters: dict[str, Counter] = {}
        body = next((n for n in self.content.iter() if prefixed(n.tag, SPACES) == "office:body"), None)
        self.kind = None
        for root in body if body is not None else ():
            kind = prefixed(root.tag, SPACES).removeprefix("office:")
            if kind in ("text", "presentation", "spreadsheet", "drawing"):
                self.kind = kind
                top = self.tree.add(None, "root", attrs={"document": kind})
                self.children(root, top)
                break

    def children(self, node, parent: int, lists: tuple = ()) -> None:
        if node.text:
            self._text(node, parent, node.text)
        for child in node:
            self.element(child, parent, lists)
            if child.tail:
                self._text(node, parent, child.tail)

    def _text(self, node, parent: int, text: str) -> None:
        # Text counts where text may stand; layout white space between other elements does not.
        if prefixed(node.tag, SPACES) in ("text:p", "text:h", "text:span", "text:a", "text:date", "text:time", "draw:a"):
            self.tree.text(parent, text)

    def element(self, node, parent: int, lists: tuple = ()) -> None:
        tag, own = prefixed(node.tag, SPACES), attributes(node, SPACES)
        style = next((own[s] for s in _STYLE_NAMES if s in own), None)
        if tag == "text:s":
            self.tree.text(parent, " " * int(own.get("text:c", "1") or 1))
        elif tag == "text:tab":
            self.tree.text(parent, "\t")
        elif tag == "text:list":
            self.list(node, own, parent, lists)
        elif tag == "table:table":
            (self.sheet if self.kind == "spreadsheet" else self.table)(node, own, parent)
        elif tag in _PLAIN:
            kind = _PLAIN[tag]
            if tag == "draw:page":
                kind = "slide" if self.kind == "presentation" else "page"
            attrs = {k.partition(":")[2]: v for k, v in own.items() if k.startswith("svg:")}
            master = own.get("draw:master-page-name") or (self.styles.masters[0] if self.styles.masters and kind in ("slide", "page") else None)
            if master:
                attrs["master_page"] = master
            at = self.tree.add(parent, kind, href=own.get("xlink:href"), name=own.get("draw:name") or own.get("text:name") or own.get("style:name"), style_name=style, attrs=attrs or None)
            self.children(node, at, lists)

    def list(self, node, own, parent: int, lists: tuple) -> None:
        """Counters belong to a list style; an outermost list starts them anew unless it continues."""
        name = own.get("text:style-name") or (lists[-1] if lists else None)
        if not lists and own.get("text:continue-numbering") != "true":
            self.counters.pop(name or "", None)
        level = len(lists)
        spec = self.styles.level(name, level)
        at = self.tree.add(parent, "list", style_name=name, list_type="unordered" if spec["fmt"] in ("bullet", "none") else "ordered")
        counter = self.counters.setdefault(name or "", Counter())
        for child in node:
            tag, item = prefixed(child.tag, SPACES), attributes(child, SPACES)
            if tag == "text:list-item":
                if item.get("text:start-value"):
                    counter.restart(level, int(item["text:start-value"]))
                marker = counter.advance(level, spec["label"], spec["fmt"], spec["start"])
                number = None if spec["fmt"] in ("bullet", "none") else counter.numbers[level]
                self.children(child, self.tree.add(at, "list_item", list_marker=marker, list_number=number), (*lists, name))
            elif tag == "text:list-header":
                self.children(child, self.tree.add(at, "list_item"), (*lists, name))

    def _parts(self, node, tag: str, groups: set[str]):
        """Rows or columns, through groups that are displayed."""
        for child in node:
            own = prefixed(child.tag, SPACES)
            if own == tag:
                yield child
            elif own in groups and attributes(child, SPACES).get("table:display") != "false":
                yield from self._parts(child, tag, groups)

    def table(self, node, own, parent: int) -> None:
        at = self.tree.add(parent, "table", name=own.get("table:name"), style_name=own.get("table:style-name"))
        for column in self._parts(node, "table:table-column", _COLUMN_GROUPS):
            spec = attributes(column, SPACES)
            for _ in range(min(int(spec.get("table:number-columns-repeated", "1")), 1024)):
                self.tree.add(at, "table_column", style_name=spec.get("table:style-name"))
        for row in self._parts(node, "table:table-row", _ROW_GROUPS):
            line = self.tree.add(at, "table_row", style_name=attributes(row, SPACES).get("table:style-name"))
            for cell in row:
                if prefixed(cell.tag, SPACES) in ("table:table-cell", "table:covered-table-cell"):
                    spec = attributes(cell, SPACES)
                    box = self.tree.add(line, "table_cell", style_name=spec.get("table:style-name"), row_span=int(spec.get("table:number-rows-spanned", "1")), col_span=int(spec.get("table:number-columns-spanned", "1")), is_covered=prefixed(cell.tag, SPACES) == "table:covered-table-cell")
                    self.children(cell, box)

    def sheet(self, node, own, parent: int) -> None:
        """Cells that hold something; repeated empty rows and cells only move the cursor."""
        ix = len(self.sheets)
        at = self.tree.add(parent, "sheet", name=own.get("table:name"))
        cursor, width, columns = Cursor(), 0, 0
        for column in self._parts(node, "table:table-column", _COLUMN_GROUPS):
            columns += int(attributes(column, SPACES).get("table:number-columns-repeated", "1"))
        used_rows = used_cols = 0
        for row in self._parts(node, "table:table-row", _ROW_GROUPS):
            repeat = int(attributes(row, SPACES).get("table:number-rows-repeated", "1"))
            cells = [c for c in row if prefixed(c.tag, SPACES) in ("table:table-cell", "table:covered-table-cell")]
            full = any(self._full(c) for c in cells)
            for _ in range(repeat if full else 1):
                for cell in cells:
                    spec = attributes(cell, SPACES)
                    across, down, times = (int(spec.get(f"table:number-{n}", "1")) for n in ("columns-spanned", "rows-spanned", "columns-repeated"))
                    if self._full(cell):
                        covered = prefixed(cell.tag, SPACES) == "table:covered-table-cell"
                        for n in range(times):
                            col = cursor.col + n * across
                            value = "float" if spec.get("office:value-type") == "float" else "string"
                            box = self.tree.add(at, "sheet_cell", ref=ref(col, cursor.row), row_span=down, col_span=across, is_covered=covered, value_type=value, style_name=spec.get("table:style-name"), is_editable=repeat * times == 1, name=ref(col, cursor.row))
                            first = len(self.tree.rows)
                            self.children(cell, box)
                            text = "\n".join(_paragraphs(self.tree.rows[first:], box))
                            self.cells.append((ix, cursor.row, col, text, value, float(spec["office:value"]) if value == "float" and "office:value" in spec else None, down, across, covered))
                            used_rows, used_cols = max(used_rows, cursor.row + 1), max(used_cols, col + 1)
                    cursor.add_cell(across, down, times)
                    width = max(width, cursor.col)
                cursor.add_row(1 if full else repeat)
        self.sheets.append((ix, own.get("table:name"), cursor.row, max(width, columns), used_rows, used_cols))

    @staticmethod
    def _full(cell) -> bool:
        spec = attributes(cell, SPACES)
        return len(cell) > 0 or int(spec.get("table:number-rows-spanned", "1")) > 1 or int(spec.get("table:number-columns-spanned", "1")) > 1

    def style_rows(self) -> list[tuple]:
        return [(name, row["family"], row["parent"], self.styles.resolve(name)) for name, row in self.styles.named.items()]


def _paragraphs(rows: list[dict], cell: int) -> list[str]:
    """Texts of a cell, one for each paragraph below it."""
    out: dict[int, list[str]] = {}
    owner: dict[int, int] = {}
    for r in rows:
        top = r["element_id"] if r["parent_id"] == cell else owner.get(r["parent_id"], r["element_id"])
        owner[r["element_id"]] = top
        out.setdefault(top, [])
        if r["element_type"] == "text":
            out[top].append(r["text"])
    return ["".join(parts) for parts in out.values()]


def meta(data: bytes) -> dict[str, str]:
    """Title, author and the like of meta.xml."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    out: dict[str, str] = {}
    if "meta.xml" in archive.namelist():
        names = {"dc:title": "title", "dc:subject": "subject", "dc:creator": "author", "meta:initial-creator": "creator", "meta:keyword": "keywords", "meta:creation-date": "creation_date", "dc:date": "modification_date", "meta:generator": "producer"}
        for node in ElementTree.fromstring(archive.read("meta.xml")).iter():
            name = names.get(prefixed(node.tag, SPACES))
            if name and node.text:
                out.setdefault(name, node.text)
    return out
