"""The element tree that all document decoders build, and its table."""

from __future__ import annotations

import pyarrow as pa

ELEMENTS = (
    "file_id long, element_id long, parent_id long, ordinal int, depth int, element_type string, path string, text string, href string, name string, "
    "style_name string, list_marker string, list_number int, list_type string, row_span int, col_span int, is_covered boolean, value_type string, is_editable boolean, attrs map<string,string>"
)
_FIELDS = [f.split() for f in ELEMENTS.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
ELEMENT_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in _FIELDS])


class Tree:
    """Elements in document order. Ids are numbers in pre-order, so ordering by id is reading order."""

    def __init__(self):
        self.rows: list[dict] = []
        self._children: list[int] = []

    def add(self, parent: int | None, kind: str, ref: str | None = None, **values) -> int:
        """Add an element below `parent`; `ref` is a sheet cell's reference."""
        at = len(self.rows)
        if parent is None:
            ordinal, depth, path = 0, 0, ""
        else:
            above = self.rows[parent]
            ordinal, depth = self._children[parent], above["depth"] + 1
            path = f"{above['path']}/cell:{ref}" if ref else f"{above['path']}/child:{ordinal}"
            self._children[parent] += 1
        self.rows.append({"element_id": at, "parent_id": parent, "ordinal": ordinal, "depth": depth, "element_type": kind, "path": path, "is_editable": True, **values})
        self._children.append(0)
        return at

    def text(self, parent: int, text: str) -> None:
        """Add text; it continues a text element that stands last below `parent`."""
        last = len(self.rows) - 1
        if text and last > parent and self.rows[last]["element_type"] == "text" and self.rows[last]["parent_id"] == parent:
            self.rows[last]["text"] += text
        elif text:
            self.add(parent, "text", text=text)


def element_batch(rows: list[tuple[int, dict]]) -> pa.RecordBatch:
    """A batch of (file_id, row of a tree)."""
    columns = [pa.array([file_id for file_id, _ in rows], pa.int64())]
    for field in list(ELEMENT_SCHEMA)[1:]:
        name = field.name
        values = [r.get(name) for _, r in rows]
        columns.append(pa.array([list(v.items()) if v else v for v in values] if name == "attrs" else values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=ELEMENT_SCHEMA)


def local(tag) -> str:
    """Local name of an XML tag."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def prefixed(tag, spaces: dict[str, str]) -> str:
    """`text:p` of a namespaced tag, by a map of namespace to prefix."""
    if not isinstance(tag, str):
        return ""
    space, _, name = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return f"{spaces.get(space, '?')}:{name}" if space else name


def attributes(node, spaces: dict[str, str]) -> dict[str, str]:
    return {prefixed(k, spaces): v for k, v in node.attrib.items()}


def label(index: int) -> str:
    out = ""
    index += 1
    while index > 0:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def ref(col: int, row: int) -> str:
    return f"{label(col)}{row + 1}"


class Cursor:
    """Position in a table whose cells span rows and columns; covered positions are skipped."""

    def __init__(self):
        self.row = self.col = 0
        self._below: list[list[tuple[int, int]]] = [[]]

    def add_column(self, repeat: int = 1) -> None:
        self.col += repeat

    def add_row(self, repeat: int = 1) -> None:
        self.row += repeat
        self.col = 0
        self._below = self._below[1:] if repeat == 1 else []
        if not self._below:
            self._below = [[]]
        self._skip()

    def add_cell(self, colspan: int = 1, rowspan: int = 1, repeat: int = 1) -> None:
        end = self.col + colspan * repeat
        for i in range(1, rowspan):
            if len(self._below) <= i:
                self._below.append([])
            self._below[i] = sorted([*self._below[i], (self.col, end)])
        self.col = end
        self._skip()

    def _skip(self) -> None:
        now = self._below[0]
        while now and now[0][0] <= self.col:
            self.col = max(self.col, now.pop(0)[1])
