"""Office Open XML: text documents, presentations, workbooks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from ..functions.numbering import Counter
from .tree import Tree, attributes, local, prefixed, ref

SPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing": "xdr",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p",
    "http://schemas.openxmlformats.org/spreadsheetml/2006/main": "x",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
}
_LIST_FORMATS = {"decimal": "decimal", "decimalZero": "decimal_zero", "lowerLetter": "letter_lower", "upperLetter": "letter_upper", "lowerRoman": "roman_lower", "upperRoman": "roman_upper", "bullet": "bullet", "none": "none"}
MAX_LINKS = 16


class Package:
    """Parts of a package and their relationships."""

    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.archive.namelist())

    def xml(self, name: str):
        return ElementTree.fromstring(self.archive.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, str]:
        """Relationship id to part name, or to the target as it stands if it is external."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out: dict[str, str] = {}
        for node in root if root is not None else ():
            target = node.get("Target", "")
            if node.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[node.get("Id", "")] = target
        return out


def _get(node, name: str) -> str | None:
    """Attribute by local name."""
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def _child(node, name: str):
    return next((c for c in node if local(c.tag) == name), None) if node is not None else None


def _value(node, name: str) -> str | None:
    """`val` of a child."""
    child = _child(node, name)
    return _get(child, "val") if child is not None else None


class Numbering:
    """List definitions of a text document."""

    def __init__(self, root):
        self.abstract: dict[str, dict] = {}
        self.number: dict[str, tuple[str, dict]] = {}
        self.by_style: dict[str, str] = {}
        for node in root if root is not None else ():
            tag = local(node.tag)
            if tag == "abstractNum":
                own = _get(node, "abstractNumId") or ""
                self.abstract[own] = {"levels": {int(_get(n, "ilvl") or 0): self._level(n) for n in node if local(n.tag) == "lvl"}, "link": _value(node, "numStyleLink")}
                if _value(node, "styleLink"):
                    self.by_style[_value(node, "styleLink")] = own
            elif tag == "num":
                over = {}
                for n in node:
                    if local(n.tag) == "lvlOverride":
                        level = _child(n, "lvl")
                        start = _value(n, "startOverride")
                        over[int(_get(n, "ilvl") or 0)] = (self._level(level) if level is not None else None, int(start) if start else None)
                self.number[_get(node, "numId") or ""] = (_value(node, "abstractNumId") or "", over)

    @staticmethod
    def _level(node) -> dict:
        return {"fmt": _LIST_FORMATS.get(_value(node, "numFmt") or "decimal", "decimal"), "label": _value(node, "lvlText") or "", "start": int(_value(node, "start") or 1)}

    def level(self, num_id: str, level: int) -> dict:
        """Override, else the abstract definition (through style links); what is unknown is a bullet."""
        abstract, over = self.number.get(num_id, ("", {}))
        found, start = over.get(level, (None, None))
        for _ in range(MAX_LINKS):
            if found:
                break
            row = self.abstract.get(abstract)
            if row is None:
                break
            found = row["levels"].get(level)
            if found or not row["link"]:
                break
            abstract = self.by_style.get(row["link"], "")
        out = dict(found or {"fmt": "bullet", "label": "•", "start": 1})
        if start is not None:
            out["start"] = start
        if out["fmt"] == "bullet" and (not out["label"] or ord(out["label"][0]) >= 0xE000):
            out["label"] = "•"
        return out


class Text:
    """A text document's tree."""

    def __init__(self, data: bytes):
        package = Package(data)
        self.relations = package.relations("word/document.xml")
        self.numbering = Numbering(package.xml("word/numbering.xml"))
        self.styles = Cascade(package.xml("word/styles.xml"))
        self.counters: dict[str, Counter] = {}
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "text"
        body = _child(package.xml("word/document.xml"), "body")
        self.blocks(body, self.tree.add(None, "root", attrs={"document": "text"}))

    def blocks(self, node, parent: int) -> None:
        """Children in order; runs of numbered paragraphs become nested lists."""
        open_: list[tuple[int, int | None]] = []
        for child in node if node is not None else ():
            numbered = self._number(child)
            if numbered is None:
                open_ = []
                self.element(child, parent)
                continue
            num_id, level = numbered
            del open_[level + 1 :]
            while len(open_) <= level:
                above = parent if not open_ else open_[-1][1] if open_[-1][1] is not None else open_[-1][0]
                spec = self.numbering.level(num_id, len(open_))
                open_.append((self.tree.add(above, "list", list_type="unordered" if spec["fmt"] in ("bullet", "none") else "ordered"), None))
            spec = self.numbering.level(num_id, level)
            counter = self.counters.setdefault(num_id, Counter())
            marker = counter.advance(level, spec["label"], spec["fmt"], spec["start"])
            for above in range(level):  # levels that were skipped count from their own formats
                counter.formats[above] = self.numbering.level(num_id, above)["fmt"] if counter.numbers[above] == 0 else counter.formats[above]
            item = self.tree.add(open_[level][0], "list_item", list_marker=marker, list_number=None if spec["fmt"] in ("bullet", "none") else counter.numbers[level])
            open_[level] = (open_[level][0], item)
            self.element(child, item)

    @staticmethod
    def _number(node) -> tuple[str, int] | None:
        if prefixed(node.tag, SPACES) != "w:p":
            return None
        spec = _child(_child(node, "pPr"), "numPr")
        num_id = _value(spec, "numId") if spec is not None else None
        return (num_id, min(int(_value(spec, "ilvl") or 0), 8)) if num_id and num_id != "0" else None

    def element(self, node, parent: int) -> None:
        tag = prefixed(node.tag, SPACES)
        if tag == "w:t":
            self.tree.text(parent, node.text or "")
        elif tag == "w:tab":
            self.tree.text(parent, "\t")
        elif tag == "w:p":
            at = self.tree.add(parent, "paragraph", style_name=_value(_child(node, "pPr"), "pStyle"), attrs=paragraph_properties(_child(node, "pPr")) or None)
            for child in node:
                self.element(child, at)
        elif tag == "w:r":
            at = self.tree.add(parent, "span", style_name=_value(_child(node, "rPr"), "rStyle"), attrs=run_properties(_child(node, "rPr")) or None)
            for child in node:
                self.element(child, at)
        elif tag == "w:br":
            self.tree.add(parent, "line_break")
        elif tag == "w:bookmarkStart":
            self.tree.add(parent, "bookmark", name=_get(node, "name"))
        elif tag == "w:hyperlink":
            anchor, target = _get(node, "anchor"), self.relations.get(_get(node, "id") or "")
            at = self.tree.add(parent, "link", href=f"#{anchor}" if anchor else target)
            for child in node:
                self.element(child, at)
        elif tag == "w:tbl":
            self.table(node, parent)
        elif tag in ("w:sdt", "w:sdtContent", "wp:anchor", "wp:inline", "a:graphic"):
            self.blocks(node, self.tree.add(parent, "group"))
        elif tag == "w:drawing":
            at = self.tree.add(parent, "frame")
            for child in node:
                self.element(child, at)
        elif tag == "a:graphicData":
            blip = next((n for n in node.iter() if local(n.tag) == "blip"), None)
            self.tree.add(parent, "image", href=self.relations.get((_get(blip, "embed") or "") if blip is not None else ""))

    def table(self, node, parent: int) -> None:
        at = self.tree.add(parent, "table", style_name=_value(_child(node, "tblPr"), "tblStyle"))
        for column in _child(node, "tblGrid") if _child(node, "tblGrid") is not None else ():
            if local(column.tag) == "gridCol":
                self.tree.add(at, "table_column", attrs={"width": twips(_get(column, "w"))} if _get(column, "w") else None)
        for row in (r for r in node if local(r.tag) == "tr"):
            line = self.tree.add(at, "table_row")
            for cell in (c for c in row if local(c.tag) == "tc"):
                spec = _child(cell, "tcPr")
                merge = _child(spec, "vMerge")
                covered = merge is not None and (_get(merge, "val") or "continue") == "continue"
                self.blocks(cell, self.tree.add(line, "table_cell", col_span=int(_value(spec, "gridSpan") or 1), row_span=1, is_covered=covered))


def twips(value: str | None) -> str | None:
    """Twentieths of a point as inches."""
    return f"{int(value) / 1440:g}in" if value and re.fullmatch(r"-?\d+", value) else None


def emu(value: str | None) -> str | None:
    return f"{int(value) / 914400:g}in" if value and re.fullmatch(r"-?\d+", value) else None


def on_off(node) -> bool | None:
    """A toggle: false only for 0, false and off."""
    return None if node is None else (_get(node, "val") or "true") not in ("0", "false", "off")


def run_properties(node) -> dict[str, str]:
    """Direct character properties."""
    out: dict[str, str] = {}
    if node is None:
        return out
    for child in node:
        tag, value = local(child.tag), _get(child, "val")
        if tag == "b":
            out["font_weight"] = "bold" if on_off(child) else "normal"
        elif tag == "i":
            out["font_style"] = "italic" if on_off(child) else "normal"
        elif tag == "u" and value:
            out["underline"] = str(value != "none").lower()
        elif tag == "strike":
            out["line_through"] = str(bool(on_off(child))).lower()
        elif tag == "sz" and value:
            out["font_size"] = f"{float(value) * 0.5:g}pt"
        elif tag == "color" and value and re.fullmatch("[0-9A-Fa-f]{6}", value):
            out["font_color"] = "#" + value.lower()
        elif tag == "rFonts" and _get(child, "ascii"):
            out["font_name"] = _get(child, "ascii")
    return out


def paragraph_properties(node) -> dict[str, str]:
    """Direct paragraph properties: alignment, spacing, indents."""
    out: dict[str, str] = {}
    if node is None:
        return out
    align = _value(node, "jc")
    if align:
        out["fo:text-align"] = {"both": "justify", "start": "left", "end": "right"}.get(align, align)
    spacing, indent = _child(node, "spacing"), _child(node, "ind")
    for part, key, name in ((spacing, "before", "fo:margin-top"), (spacing, "after", "fo:margin-bottom"), (indent, "left", "fo:margin-left"), (indent, "start", "fo:margin-left"), (indent, "right", "fo:margin-right"), (indent, "end", "fo:margin-right")):
        value = twips(_get(part, key)) if part is not None else None
        if value:
            out[name] = value
    if spacing is not None and _get(spacing, "line") and (_get(spacing, "lineRule") or "auto") == "auto":
        out["fo:line-height"] = f"{int(_get(spacing, 'line')) / 240:g}"
    if on_off(_child(node, "contextualSpacing")):
        out["contextual_spacing"] = "true"
    return out


class Cascade:
    """Styles of a text document: defaults, then the chain of basedOn, then direct properties."""

    def __init__(self, root):
        self.named: dict[str, dict] = {}
        self.default: dict[str, str] = {}
        for node in root if root is not None else ():
            if local(node.tag) == "docDefaults":
                self.default = paragraph_properties(_child(_child(node, "pPrDefault"), "pPr")) | run_properties(_child(_child(node, "rPrDefault"), "rPr"))
            elif local(node.tag) == "style":
                self.named[_get(node, "styleId") or ""] = {"family": _get(node, "type"), "parent": _value(node, "basedOn"), "properties": paragraph_properties(_child(node, "pPr")) | run_properties(_child(node, "rPr"))}

    def resolve(self, name: str | None) -> dict[str, str]:
        """Properties of a style; a cycle ends where it closes."""
        chain, seen = [], set()
        while name and name in self.named and name not in seen:
            seen.add(name)
            chain.append(self.named[name])
            name = self.named[name]["parent"]
        out = dict(self.default)
        for row in reversed(chain):
            out |= row["properties"]
        return out


class Presentation:
    """Slides in the order of the presentation's list."""

    def __init__(self, data: bytes):
        self.package = Package(data)
        root = self.package.xml("ppt/presentation.xml")
        relations = self.package.relations("ppt/presentation.xml")
        size = _child(root, "sldSz")
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "presentation"
        width, height = (emu(_get(size, "cx")), emu(_get(size, "cy"))) if size is not None else ("10in", "7.5in")
        top = self.tree.add(None, "root", attrs={"document": "presentation", "width": width, "height": height})
        ids = _child(root, "sldIdLst")
        for n, node in enumerate(ids if ids is not None else ()):
            part = relations.get(node.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") or "")
            slide = self.package.xml(part) if part else None
            at = self.tree.add(top, "slide", name=f"slide{n + 1}")
            self.relations = self.package.relations(part) if part else {}
            for shapes in slide.iter("{http://schemas.openxmlformats.org/presentationml/2006/main}spTree") if slide is not None else ():
                for shape in shapes:
                    self.element(shape, at)

    def element(self, node, parent: int) -> None:
        tag = prefixed(node.tag, SPACES)
        if tag in ("p:sp", "p:graphicFrame"):
            at = self.tree.add(parent, "frame", attrs=self._box(node))
            for child in node.iter() if tag == "p:graphicFrame" else node:
                if prefixed(child.tag, SPACES) in ("p:txBody", "a:tbl"):
                    self.element(child, at)
        elif tag in ("p:txBody", "a:txBody"):
            self._all(node, self.tree.add(parent, "group"))
        elif tag == "a:p":
            self._all(node, self.tree.add(parent, "paragraph"))
        elif tag == "a:r":
            self._all(node, self.tree.add(parent, "span"))
        elif tag == "a:t":
            self.tree.text(parent, node.text or "")
        elif tag == "a:tab":
            self.tree.text(parent, "\t")
        elif tag == "a:tbl":
            at = self.tree.add(parent, "table")
            for row in (r for r in node if local(r.tag) == "tr"):
                line = self.tree.add(at, "table_row")
                for cell in (c for c in row if local(c.tag) == "tc"):
                    covered = any(_get(cell, m) in ("1", "true") for m in ("hMerge", "vMerge"))
                    self._all(cell, self.tree.add(line, "table_cell", row_span=int(_get(cell, "rowSpan") or 1), col_span=int(_get(cell, "gridSpan") or 1), is_covered=covered))

    def _all(self, node, parent: int) -> None:
        for child in node:
            self.element(child, parent)

    @staticmethod
    def _box(node) -> dict[str, str] | None:
        place = next((n for n in node.iter() if local(n.tag) == "xfrm"), None)
        off, ext = _child(place, "off"), _child(place, "ext")
        out = {}
        if off is not None:
            out |= {"x": emu(_get(off, "x")), "y": emu(_get(off, "y"))}
        if ext is not None:
            out |= {"width": emu(_get(ext, "cx")), "height": emu(_get(ext, "cy"))}
        return {k: v for k, v in out.items() if v} or None


class CellStyles:
    """Cell formats of a workbook: fonts, fills, borders and alignment by format index."""

    def __init__(self, root):
        part = lambda name: list(_child(root, name)) if _child(root, name) is not None else []
        fonts, fills, borders = ([f(n) for n in part(name)] for name, f in (("fonts", self._font), ("fills", self._fill), ("borders", self._border)))
        self.formats: list[dict[str, str]] = []
        for node in part("cellXfs") if root is not None else []:
            out: dict[str, str] = {}
            for table, key in ((fonts, "fontId"), (fills, "fillId"), (borders, "borderId")):
                at = int(node.get(key) or 0)
                if at < len(table):
                    out |= table[at]
            align = _child(node, "alignment")
            if align is not None:
                if align.get("horizontal") in ("left", "right", "center", "justify"):
                    out["fo:text-align"] = align.get("horizontal")
                if align.get("vertical"):
                    out["style:vertical-align"] = {"center": "middle"}.get(align.get("vertical"), align.get("vertical"))
                if on_off_value(align.get("wrapText")):
                    out["wrap"] = "true"
            self.formats.append(out)

    @staticmethod
    def _color(node) -> str | None:
        value = node.get("rgb") if node is not None else None
        return "#" + value[-6:].lower() if value and re.fullmatch("[0-9A-Fa-f]{6,8}", value) else None

    def _font(self, node) -> dict[str, str]:
        out = {}
        if _value(node, "sz"):
            out["font_size"] = f"{float(_value(node, 'sz')):g}pt"
        if _value(node, "name"):
            out["font_name"] = _value(node, "name")
        for tag, key, on in (("b", "font_weight", "bold"), ("i", "font_style", "italic")):
            if on_off(_child(node, tag)):
                out[key] = on
        if _child(node, "u") is not None and _value(node, "u") != "none":
            out["underline"] = "true"
        if on_off(_child(node, "strike")):
            out["line_through"] = "true"
        if self._color(_child(node, "color")):
            out["font_color"] = self._color(_child(node, "color"))
        return out

    def _fill(self, node) -> dict[str, str]:
        pattern = _child(node, "patternFill")
        color = self._color(_child(pattern, "fgColor")) if pattern is not None and pattern.get("patternType") == "solid" else None
        return {"fo:background-color": color} if color else {}

    def _border(self, node) -> dict[str, str]:
        widths = {"thin": "0.75pt", "medium": "1.5pt", "thick": "2.25pt", "hair": "0.25pt"}
        out = {}
        for side in ("left", "right", "top", "bottom"):
            edge = _child(node, side)
            style = edge.get("style") if edge is not None else None
            if style and style != "none":
                line = style if style in ("dashed", "dotted", "double") else "solid"
                out[f"fo:border-{side}"] = f"{widths.get(style, '0.75pt')} {line} {self._color(_child(edge, 'color')) or '#000000'}"
        return out


def on_off_value(value: str | None) -> bool:
    return value is not None and value not in ("0", "false", "off")


_REF = re.compile(r"^\$?([A-Z]+)\$?([0-9]+)$")


def parse_ref(text: str) -> tuple[int, int]:
    """(column, row) of A1."""
    m = _REF.match(text)
    if not m:
        raise ValueError(f"no cell reference: {text}")
    col = 0
    for c in m.group(1):
        col = col * 26 + ord(c) - 64
    return col - 1, int(m.group(2)) - 1


class Workbook:
    """Sheets and their cells."""

    def __init__(self, data: bytes):
        self.package = Package(data)
        root, relations = self.package.xml("xl/workbook.xml"), self.package.relations("xl/workbook.xml")
        self.formats = CellStyles(self.package.xml("xl/styles.xml")).formats
        strings = self.package.xml("xl/sharedStrings.xml")
        self.strings = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in strings] if strings is not None else []
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "spreadsheet"
        top = self.tree.add(None, "root", attrs={"document": "spreadsheet"})
        listed = _child(root, "sheets")
        for ix, node in enumerate(listed if listed is not None else ()):
            part = relations.get(node.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") or "", "")
            sheet = self.package.xml(part)
            if sheet is not None:
                self.sheet(ix, node.get("name"), sheet, top)

    def sheet(self, ix: int, name: str | None, root, parent: int) -> None:
        at = self.tree.add(parent, "sheet", name=name)
        found: dict[tuple[int, int], list] = {}
        row_no = -1
        data = _child(root, "sheetData")
        for row in data if data is not None else ():
            row_no = int(row.get("r")) - 1 if row.get("r") else row_no + 1
            col_no = -1
            for cell in (c for c in row if local(c.tag) == "c"):
                col_no, own_row = parse_ref(cell.get("r")) if cell.get("r") else (col_no + 1, row_no)
                text, kind = self._text(cell)
                own = cell.get("s")
                found[own_row, col_no] = [text, kind, 1, 1, False, int(own) if own and own.isdigit() else None]
        merges = _child(root, "mergeCells")
        for node in merges if merges is not None else ():
            a, _, b = (node.get("ref") or "").partition(":")
            try:
                (c0, r0), (c1, r1) = parse_ref(a), parse_ref(b or a)
            except ValueError:
                continue
            if (r0, c0) not in found:
                continue
            found[r0, c0][2:4] = [r1 - r0 + 1, c1 - c0 + 1]
            if (r1 - r0 + 1) * (c1 - c0 + 1) > len(found):
                inside = [k for k in found if r0 <= k[0] <= r1 and c0 <= k[1] <= c1]
            else:
                inside = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) in found]
            for key in inside:
                if key != (r0, c0):
                    found[key][4] = True
        columns = _child(root, "cols")
        for column in columns if columns is not None else ():
            if column.get("width"):
                self.tree.add(at, "table_column", name=f"{column.get('min')}-{column.get('max')}", attrs={"width": f"{float(column.get('width')):g}ch"})
        for (r, c), (text, kind, down, across, covered, own) in sorted(found.items()):
            look = self.formats[own] if own is not None and own < len(self.formats) else None
            box = self.tree.add(at, "sheet_cell", ref=ref(c, r), name=ref(c, r), value_type=kind, row_span=down, col_span=across, is_covered=covered, style_name=str(own) if own is not None else None, attrs=look or None)
            self.tree.text(box, text)
            number = None
            if kind == "float":
                try:
                    number = float(text)
                except ValueError:
                    pass
            self.cells.append((ix, r, c, text, kind, number, down, across, covered))
        rows, cols = max((r for r, _ in found), default=-1) + 1, max((c for _, c in found), default=-1) + 1
        told = _child(root, "dimension")
        if told is not None and told.get("ref"):
            try:
                col, row = parse_ref(told.get("ref").rpartition(":")[2])
                rows, cols = row + 1, col + 1
            except ValueError:
                pass
        self.sheets.append((ix, name, rows, cols, rows, cols))

    def _text(self, cell) -> tuple[str, str]:
        kind, value = cell.get("t"), _child(cell, "v")
        raw = value.text or "" if value is not None else ""
        if kind == "s":
            i = int(raw) if raw.isdigit() else -1
            return (self.strings[i] if 0 <= i < len(self.strings) else "", "string")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if local(t.tag) == "t"), "string"
        if kind in ("str", "b", "e", "d"):
            return raw, "string"
        return raw, "float" if value is not None else "string"


def meta(data: bytes) -> dict[str, str]:
    """Core properties."""
    root = Package(data).xml("docProps/core.xml")
    names = {"title": "title", "subject": "subject", "creator": "author", "keywords": "keywords", "created": "creation_date", "modified": "modification_date"}
    return {names[local(n.tag)]: n.text for n in (root if root is not None else ()) if local(n.tag) in names and n.text}


def reader(kind: str):
    return {"docx": Text, "pptx": Presentation, "xlsx": Workbook}[kind]


__all__ = ["Cascade", "Numbering", "Package", "Presentation", "Text", "Workbook", "attributes", "meta", "parse_ref", "reader"]
