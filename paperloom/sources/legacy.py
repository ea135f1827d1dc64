"""Legacy binary office files: workbooks (BIFF8), text documents, presentations."""

from __future__ import annotations

import struct

from .containers import CompoundFile
from .tree import Tree, ref

#: Error codes of cells.
_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Encrypted(ValueError):
    """Encrypted legacy files are named, never opened."""


def _records(data: bytes, at: int = 0):
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + size], at
        at += 4 + size


def _rk(value: int) -> float:
    if value & 2:
        number = float(value >> 2 if value < 0x80000000 else (value - (1 << 32)) >> 2)
    else:
        number = struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def number_text(value: float) -> str:
    return f"{value:.15g}"


class _Strings:
    """Reader over a record and its continuations, where a string's characters may change width at a border."""

    def __init__(self, blocks: list[bytes]):
        self.blocks, self.block, self.at = blocks, 0, 0

    def _fill(self) -> bool:
        while self.block < len(self.blocks) and self.at >= len(self.blocks[self.block]):
            self.block, self.at = self.block + 1, 0
        return self.block < len(self.blocks)

    def take(self, n: int) -> bytes:
        out = b""
        while n and self._fill():
            part = self.blocks[self.block][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def string(self) -> str:
        head = self.take(3)
        if len(head) < 3:
            return ""
        length, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while length > 0:
            if self.at >= len(self.blocks[self.block]):
                if not self._fill():
                    break
                wide = self.take(1)[0] & 1
            left = len(self.blocks[self.block]) - self.at
            n = min(length, left // (2 if wide else 1))
            if not n:
                self.take(left)
                continue
            raw = self.take(n * (2 if wide else 1))
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            length -= n
        self.take(4 * runs + extra)
        return "".join(out)


def _short(data: bytes, at: int, length_size: int = 2) -> str:
    """A string within one record."""
    length = int.from_bytes(data[at : at + length_size], "little")
    flags = data[at + length_size]
    at += length_size + 1
    return data[at : at + length * 2].decode("utf-16-le", "replace") if flags & 1 else data[at : at + length].decode("latin-1")


class Workbook:
    """Sheets with the displayed values of their cells; formulas give their stored results."""

    def __init__(self, data: bytes):
        file = CompoundFile(data)
        stream = file.stream("/Workbook") or file.stream("/Book")
        if stream is None:
            raise ValueError("no workbook stream")
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "spreadsheet"
        bound, self.strings, blocks = [], [], None
        for kind, body, _ in _records(stream):
            if kind == 0x3C and blocks is not None:
                blocks.append(body)
                continue
            if blocks is not None:
                self._shared(blocks)
                blocks = None
            if kind == 0x2F:
                raise Encrypted("encrypted workbook")
            if kind == 0x85:
                bound.append((struct.unpack_from("<I", body)[0], _short(body, 6, 1), body[5]))
            elif kind == 0xFC:
                blocks = [body]
            elif kind == 0x0A:
                break
        if blocks is not None:
            self._shared(blocks)
        top = self.tree.add(None, "root", attrs={"document": "spreadsheet"})
        for ix, (offset, name, _) in enumerate(bound):
            self._sheet(ix, name, stream, offset, top)

    def _shared(self, blocks: list[bytes]) -> None:
        count = struct.unpack_from("<I", blocks[0], 4)[0]
        reader = _Strings([blocks[0][8:], *blocks[1:]])
        for _ in range(count):
            if not reader._fill():
                break
            self.strings.append(reader.string())

    def _sheet(self, ix: int, name: str, stream: bytes, offset: int, parent: int) -> None:
        at = self.tree.add(parent, "sheet", name=name)
        found: dict[tuple[int, int], str] = {}
        merged: list[tuple[int, int, int, int]] = []
        rows = cols = 0
        pending = None
        first = True
        for kind, body, _ in _records(stream, offset):
            if kind == 0x809 and not first:
                break
            first = False
            if kind == 0x0A:
                break
            if kind == 0x200 and len(body) >= 12:
                _, rows, _, cols = struct.unpack_from("<IIHH", body)
            elif kind == 0xFD:
                r, c, _, i = struct.unpack_from("<HHHI", body)
                found[r, c] = self.strings[i] if i < len(self.strings) else ""
            elif kind == 0x27E:
                r, c, _, v = struct.unpack_from("<HHHI", body)
                found[r, c] = number_text(_rk(v))
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", body)
                for n in range((len(body) - 6) // 6):
                    found[r, c + n] = number_text(_rk(struct.unpack_from("<I", body, 6 + 6 * n)[0]))
            elif kind == 0x203:
                r, c, _, v = struct.unpack_from("<HHHd", body)
                found[r, c] = number_text(v)
            elif kind == 0x204:
                r, c = struct.unpack_from("<HH", body)
                found[r, c] = _short(body, 6)
            elif kind == 0x205:
                r, c, _, v, is_error = struct.unpack_from("<HHHBB", body)
                found[r, c] = _ERRORS.get(v, "#ERR") if is_error else "TRUE" if v else "FALSE"
            elif kind == 0x06:
                r, c = struct.unpack_from("<HH", body)
                result, mark = body[6:14], struct.unpack_from("<H", body, 12)[0]
                pending = None
                if mark != 0xFFFF:
                    found[r, c] = number_text(struct.unpack("<d", result)[0])
                elif result[0] == 0:
                    pending = (r, c)
                elif result[0] == 1:
                    found[r, c] = "TRUE" if result[2] else "FALSE"
                elif result[0] == 2:
                    found[r, c] = _ERRORS.get(result[2], "#ERR")
            elif kind == 0x207 and pending:
                found[pending] = _short(body, 0)
                pending = None
            elif kind == 0xE5:
                for n in range(struct.unpack_from("<H", body)[0]):
                    merged.append(struct.unpack_from("<HHHH", body, 2 + 8 * n))
        span = {(r0, c0): (r1 - r0 + 1, c1 - c0 + 1) for r0, r1, c0, c1 in merged if (r0, c0) in found}
        covered = {k for k in found for r0, r1, c0, c1 in merged if (r0, c0) in found and r0 <= k[0] <= r1 and c0 <= k[1] <= c1 and k != (r0, c0)} if merged else set()
        for (r, c), text in sorted(found.items()):
            down, across = span.get((r, c), (1, 1))
            box = self.tree.add(at, "sheet_cell", ref=ref(c, r), name=ref(c, r), value_type="string", row_span=down, col_span=across, is_covered=(r, c) in covered)
            self.tree.text(box, text)
            self.cells.append((ix, r, c, text, "string", None, down, across, (r, c) in covered))
        used_rows, used_cols = max((r for r, _ in found), default=-1) + 1, max((c for _, c in found), default=-1) + 1
        self.sheets.append((ix, name, max(rows, used_rows), max(cols, used_cols), used_rows, used_cols))


class TextDocument:
    """Paragraphs of a text document by its piece table."""

    def __init__(self, data: bytes):
        file = CompoundFile(data)
        main = file.stream("/WordDocument")
        if main is None or len(main) < 0x1AA:
            raise ValueError("no document stream")
        flags = struct.unpack_from("<H", main, 0x0A)[0]
        if flags & 0x0100:
            raise Encrypted("encrypted document")
        table = file.stream("/1Table" if flags & 0x0200 else "/0Table") or b""
        length = struct.unpack_from("<I", main, 0x4C)[0]
        start, size = struct.unpack_from("<II", main, 0x1A2)
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "text"
        self._paragraphs(clean(self._pieces(main, table[start : start + size])[:length]))

    @staticmethod
    def _pieces(main: bytes, clx: bytes) -> str:
        at = 0
        while at < len(clx) and clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        if at >= len(clx) or clx[at] != 2:
            return ""
        size = struct.unpack_from("<I", clx, at + 1)[0]
        plc = clx[at + 5 : at + 5 + size]
        n = (len(plc) - 4) // 12
        ends = struct.unpack_from(f"<{n + 1}I", plc)
        out = []
        for i in range(n):
            where = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
            count = ends[i + 1] - ends[i]
            if where & 0x40000000:
                at = (where & 0x3FFFFFFF) // 2
                out.append(main[at : at + count].decode("cp1252", "replace"))
            else:
                out.append(main[where : where + 2 * count].decode("utf-16-le", "replace"))
        return "".join(out)

    def _paragraphs(self, text: str) -> None:
        top = self.tree.add(None, "root", attrs={"document": "text"})
        parts = text.split("\r")
        for i, part in enumerate(parts):
            if i == len(parts) - 1 and not part:
                break
            at = self.tree.add(top, "paragraph")
            for j, page in enumerate(part.split("\x0c")):
                if j:
                    self.tree.add(at, "page_break")
                for k, line in enumerate(page.split("\x0b")):
                    if k:
                        self.tree.add(at, "line_break")
                    if line:
                        self.tree.text(self.tree.add(at, "span"), line)


def clean(text: str) -> str:
    """Body text: field instructions hidden, hard hyphens plain, soft ones and other controls dropped."""
    out, fields = [], []
    for c in text:
        if c == "\x13":
            fields.append(True)
        elif c == "\x14":
            if fields:
                fields[-1] = False
        elif c == "\x15":
            if fields:
                fields.pop()
        elif any(fields):
            continue
        elif c == "\x1e":
            out.append("-")
        elif c == "\x07":
            out.append("\r")
        elif c >= " " or c in "\t\r\x0b\x0c":
            out.append(c)
    return "".join(out)


class Presentation:
    """Slides of a presentation: the texts of each slide container, then those of the outline list."""

    def __init__(self, data: bytes):
        file = CompoundFile(data)
        stream, user = file.stream("/PowerPoint Document"), file.stream("/Current User")
        if stream is None:
            raise ValueError("no presentation stream")
        if user is not None and len(user) >= 16 and struct.unpack_from("<I", user, 12)[0] == 0xF3D1C4DF:
            raise Encrypted("encrypted presentation")
        self.tree, self.cells, self.sheets, self.kind = Tree(), [], [], "presentation"
        self.stream, self.persist = stream, self._persist(stream, user)
        top = self.tree.add(None, "root", attrs={"document": "presentation"})
        slides = self._slides()
        for n, (offset, outline) in enumerate(slides):
            at = self.tree.add(top, "slide", name=f"slide{n + 1}")
            for text in self._texts(offset, outline):
                group = self.tree.add(self.tree.add(at, "frame"), "group")
                for paragraph in text.split("\r"):
                    box = self.tree.add(group, "paragraph")
                    for k, line in enumerate(paragraph.split("\x0b")):
                        if k:
                            self.tree.add(box, "line_break")
                        line = "".join(c for c in line if c >= " " or c == "\t")
                        if line:
                            self.tree.text(self.tree.add(box, "span"), line)

    @staticmethod
    def _persist(stream: bytes, user: bytes | None) -> dict[int, int]:
        """Object number to offset: edits from newest to oldest, the newest wins; offsets must decrease."""
        out: dict[int, int] = {}
        at = struct.unpack_from("<I", user, 16)[0] if user is not None and len(user) >= 20 else None
        last = len(stream)
        while at is not None and at < last and at + 28 <= len(stream):
            last = at
            _, kind, _ = struct.unpack_from("<HHI", stream, at)
            if kind != 0x0FF5:
                break
            before, directory = struct.unpack_from("<II", stream, at + 16)
            _, kind, size = struct.unpack_from("<HHI", stream, directory)
            pos, end = directory + 8, directory + 8 + size
            while kind == 0x1772 and pos + 4 <= end:
                head = struct.unpack_from("<I", stream, pos)[0]
                first, count = head & 0xFFFFF, head >> 20
                for i in range(count):
                    if pos + 8 + 4 * i <= end:
                        out.setdefault(first + i, struct.unpack_from("<I", stream, pos + 4 + 4 * i)[0])
                pos += 4 + 4 * count
            at = before or None
        return out

    def _children(self, at: int, end: int):
        while at + 8 <= end:
            version, kind, size = struct.unpack_from("<HHI", self.stream, at)
            yield version & 0xF == 0xF, version >> 4, kind, at + 8, min(at + 8 + size, end)
            at += 8 + size

    def _slides(self) -> list[tuple[int | None, list[str]]]:
        out: list[tuple[int | None, list[str]]] = []
        for box, _, kind, at, end in self._children(0, len(self.stream)):
            if kind != 0x03E8 or not box:
                continue
            out = []
            for sub, instance, tag, lo, hi in self._children(at, end):
                if tag != 0x0FF0 or instance != 0 or not sub:
                    continue
                for _, _, atom, a, b in self._children(lo, hi):
                    if atom == 0x03F3:
                        out.append((self.persist.get(struct.unpack_from("<I", self.stream, a)[0]), []))
                    elif out and atom in (0x0FA0, 0x0FA8):
                        out[-1][1].append(self._atom(atom, a, b))
        return out

    def _atom(self, kind: int, at: int, end: int) -> str:
        return self.stream[at:end].decode("utf-16-le" if kind == 0x0FA0 else "latin-1", "replace")

    def _texts(self, offset: int | None, outline: list[str]) -> list[str]:
        if offset is None or offset + 8 > len(self.stream):
            return outline
        size = struct.unpack_from("<I", self.stream, offset + 4)[0]
        found: list[str] = []

        def visit(at: int, end: int) -> None:
            for box, _, kind, lo, hi in self._children(at, end):
                if kind in (0x0FA0, 0x0FA8):
                    found.append(self._atom(kind, lo, hi))
                elif kind == 0x0F9E and hi - lo >= 4:
                    i = struct.unpack_from("<I", self.stream, lo)[0]
                    if i < len(outline):
                        found.append(outline[i])
                elif box or kind == 0xF00D:
                    visit(lo, hi)

        visit(offset + 8, min(offset + 8 + size, len(self.stream)))
        return found or outline
