"""Fonts (TrueType and OpenType): names, metrics, widths and code points of glyphs."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame


class Sfnt:
    """Tables of the first face of a font file."""

    def __init__(self, data: bytes):
        at = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
        if data[at : at + 4] not in (b"\x00\x01\x00\x00", b"true", b"OTTO"):
            raise ValueError("no font")
        self.format = "otf" if data[at : at + 4] == b"OTTO" else "ttf"
        self.tables = {}
        for i in range(struct.unpack_from(">H", data, at + 4)[0]):
            tag, _, offset, size = struct.unpack_from(">4sIII", data, at + 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = data[offset : offset + size]
        head, maxp, hhea = self.tables.get("head", b""), self.tables.get("maxp", b""), self.tables.get("hhea", b"")
        self.units_per_em = struct.unpack_from(">H", head, 18)[0] if len(head) >= 54 else 1000
        self.bbox = struct.unpack_from(">hhhh", head, 36) if len(head) >= 54 else (0, 0, 0, 0)
        self.n_glyphs = struct.unpack_from(">H", maxp, 4)[0] if len(maxp) >= 6 else 0
        self.ascender, self.descender = struct.unpack_from(">hh", hhea, 4) if len(hhea) >= 36 else (0, 0)
        self._n_metrics = struct.unpack_from(">H", hhea, 34)[0] if len(hhea) >= 36 else 0

    def width(self, glyph: int) -> int:
        hmtx = self.tables.get("hmtx", b"")
        at = 4 * min(glyph, self._n_metrics - 1) if self._n_metrics else 0
        return struct.unpack_from(">H", hmtx, at)[0] if self._n_metrics and at + 2 <= len(hmtx) else 0

    def name(self) -> str | None:
        """PostScript name before the full name, UTF-16 before single bytes."""
        table, best = self.tables.get("name", b""), None
        if len(table) < 6:
            return None
        count, base = struct.unpack_from(">HH", table, 2)
        for i in range(count):
            platform, _, _, kind, size, offset = struct.unpack_from(">HHHHHH", table, 6 + 12 * i)
            if kind in (4, 6):
                raw = table[base + offset : base + offset + size]
                wide = platform in (0, 3)
                rank = (kind == 6, wide)
                if best is None or rank > best[0]:
                    best = (rank, raw.decode("utf-16-be" if wide else "mac_roman", "replace"))
        return best[1] if best else None

    def code_points(self) -> dict[int, int]:
        """Code point to glyph by the best subtable; glyph 0 is no mapping."""
        table = self.tables.get("cmap", b"")
        if len(table) < 4:
            return {}
        score = {(3, 10): 6, (0, 6): 5, (0, 4): 5, (3, 1): 4, (0, 3): 3, (0, 2): 3, (0, 1): 3, (0, 0): 3, (3, 0): 2, (1, 0): 1}
        found = []
        for i in range(struct.unpack_from(">H", table, 2)[0]):
            platform, own, offset = struct.unpack_from(">HHI", table, 4 + 8 * i)
            if offset + 2 <= len(table) and struct.unpack_from(">H", table, offset)[0] in (0, 4, 6, 12):
                found.append((score.get((platform, own), 0), -i, offset))
        return {c: g for c, g in self._subtable(table, max(found)[2]).items() if g} if found else {}

    @staticmethod
    def _subtable(t: bytes, at: int) -> dict[int, int]:
        kind = struct.unpack_from(">H", t, at)[0]
        if kind == 0:
            return dict(enumerate(t[at + 6 : at + 262]))
        if kind == 6:
            first, n = struct.unpack_from(">HH", t, at + 6)
            return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, at + 10))}
        out: dict[int, int] = {}
        if kind == 12:
            for i in range(struct.unpack_from(">I", t, at + 12)[0]):
                a, b, g = struct.unpack_from(">III", t, at + 16 + 12 * i)
                out |= {c: g + c - a for c in range(a, min(b, a + 0xFFFF) + 1)}
            return out
        n = struct.unpack_from(">H", t, at + 6)[0] // 2
        ends, starts = struct.unpack_from(f">{n}H", t, at + 14), struct.unpack_from(f">{n}H", t, at + 16 + 2 * n)
        deltas, offsets = struct.unpack_from(f">{n}h", t, at + 16 + 4 * n), struct.unpack_from(f">{n}H", t, at + 16 + 6 * n)
        for i in range(n):
            for c in range(starts[i], ends[i] + 1):
                if c == 0xFFFF:
                    continue
                if not offsets[i]:
                    out[c] = c + deltas[i] & 0xFFFF
                else:
                    where = at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                    g = struct.unpack_from(">H", t, where)[0] if where + 2 <= len(t) else 0
                    out[c] = g + deltas[i] & 0xFFFF if g else 0
        return out


class Cff:
    """A bare CFF font: name, glyph count, glyph names or ids, widths."""

    def __init__(self, data: bytes):
        if len(data) < 4 or data[0] != 1:
            raise ValueError("no CFF font")
        self.data = data
        names, at = self._index(data[2])
        tops, at = self._index(at)
        strings, at = self._index(at)
        self._globals, _ = self._index(at)
        self._strings = [s.decode("latin-1") for s in strings]
        self.name = names[0].decode("latin-1") if names else None
        self.top = self._dict(tops[0]) if tops else {}
        self.glyphs, _ = self._index(int(self.top[17][0])) if 17 in self.top else ([], 0)
        self.is_cid = (12, 30) in self.top
        size, offset = (int(v) for v in self.top.get(18, [0, 0]))
        private = self._dict(data[offset : offset + size])
        self.default_width, self.nominal_width = private.get(20, [0])[0], private.get(21, [0])[0]
        self.bbox = [int(v) for v in self.top.get(5, [0, 0, 0, 0])]
        matrix = self.top.get((12, 7))
        self.units_per_em = round(1 / matrix[0]) if matrix and matrix[0] else 1000

    def _index(self, at: int) -> tuple[list[bytes], int]:
        count = struct.unpack_from(">H", self.data, at)[0]
        if not count:
            return [], at + 2
        size = self.data[at + 2]
        offsets = [int.from_bytes(self.data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(count + 1)]
        base = at + 2 + (count + 1) * size
        return [self.data[base + a : base + b] for a, b in zip(offsets, offsets[1:])], base + offsets[-1]

    @staticmethod
    def _dict(data: bytes) -> dict:
        out, held, at = {}, [], 0
        while at < len(data):
            b = data[at]
            at += 1
            if b <= 21:
                key = b
                if b == 12:
                    key = (12, data[at])
                    at += 1
                out[key], held = held, []
            elif b == 28:
                held.append(struct.unpack_from(">h", data, at)[0])
                at += 2
            elif b == 29:
                held.append(struct.unpack_from(">i", data, at)[0])
                at += 4
            elif b == 30:
                text = ""
                while "f" not in text and at < len(data):
                    text += f"{data[at]:02x}"
                    at += 1
                for code, shown in (("c", "E-"), ("b", "E"), ("a", "."), ("e", "-")):
                    text = text.split("f")[0].replace(code, shown)
                held.append(float(text or 0))
            elif 32 <= b <= 246:
                held.append(b - 139)
            elif b <= 250:
                held.append((b - 247) * 256 + data[at] + 108)
                at += 1
            elif b <= 254:
                held.append(-(b - 251) * 256 - data[at] - 108)
                at += 1
        return out

    def charset(self) -> list[int]:
        """String or character id of each glyph; glyph 0 is 0."""
        at, n, out = int(self.top.get(15, [0])[0]), len(self.glyphs), [0]
        if at <= 2:
            return list(range(n))
        kind = self.data[at]
        at += 1
        while len(out) < n:
            first = struct.unpack_from(">H", self.data, at)[0]
            at += 2
            left = 0
            if kind:
                left = self.data[at] if kind == 1 else struct.unpack_from(">H", self.data, at)[0]
                at += kind
            out += range(first, first + left + 1)
        return out[:n]

    def width(self, glyph: int) -> float:
        """Width of a glyph: nominal plus the odd first operand of its program, else the default."""
        held, at, code = [], 0, self.glyphs[glyph]
        while at < len(code):
            b = code[at]
            at += 1
            if b in (1, 3, 18, 23, 19, 20):
                return self.nominal_width + held[0] if len(held) % 2 else self.default_width
            if b in (21, 22, 4, 14):
                most = {21: 2, 22: 1, 4: 1, 14: 0}[b]
                return self.nominal_width + held[0] if len(held) > most and not (b == 14 and len(held) == 4) else self.default_width
            if b == 28:
                held.append(struct.unpack_from(">h", code, at)[0])
                at += 2
            elif b == 255:
                held.append(struct.unpack_from(">i", code, at)[0] / 65536)
                at += 4
            elif 32 <= b <= 246:
                held.append(b - 139)
            elif 247 <= b <= 250:
                held.append((b - 247) * 256 + code[at] + 108)
                at += 1
            elif 251 <= b <= 254:
                held.append(-(b - 251) * 256 - code[at] - 108)
                at += 1
            else:
                return self.default_width
        return self.default_width


def decrypt_type1(data: bytes, key: int = 55665, skip: int = 4) -> bytes:
    """Encrypted portions of Type 1 fonts: key 55665 for the private part, 4330 for glyph programs."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


class Type1:
    """A Type 1 font: name, and glyph names with their widths."""

    def __init__(self, data: bytes):
        import re

        if data[:1] == b"\x80":
            parts, at = [], 0
            while data[at : at + 1] == b"\x80" and data[at + 1] in (1, 2):
                size = struct.unpack_from("<I", data, at + 2)[0]
                parts.append(data[at + 6 : at + 6 + size])
                at += 6 + size
            data = b"".join(parts)
        cut = data.find(b"eexec")
        if not data.startswith(b"%!") or cut < 0:
            raise ValueError("no Type 1 font")
        found = re.search(rb"/FontName\s*/(\S+)", data[:cut])
        self.name = found.group(1).decode("latin-1") if found else None
        body = data[cut + 5 :].lstrip(b" \t\r\n")
        if re.fullmatch(rb"[0-9A-Fa-f\s]{8}", body[:8]):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
            body = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = decrypt_type1(body)
        found = re.search(rb"/lenIV\s+(-?\d+)", private)
        skip = int(found.group(1)) if found else 4
        self.widths: dict[str, float] = {}
        at = private.find(b"/CharStrings")
        for m in iter(lambda: re.compile(rb"/(\S+)\s+(\d+)\s+(?:RD|-\|)\s").search(private, at), None):
            program = private[m.end() : m.end() + int(m.group(2))]
            at = m.end() + int(m.group(2))
            self.widths[m.group(1).decode("latin-1")] = self._width(program if skip < 0 else decrypt_type1(program, 4330, skip))

    @staticmethod
    def _width(code: bytes) -> float:
        held, at = [], 0
        while at < len(code):
            b = code[at]
            at += 1
            if b == 13 and len(held) >= 2:
                return held[1]
            if 32 <= b <= 246:
                held.append(b - 139)
            elif 247 <= b <= 250:
                held.append((b - 247) * 256 + code[at] + 108)
                at += 1
            elif 251 <= b <= 254:
                held.append(-(b - 251) * 256 - code[at] - 108)
                at += 1
            elif b == 255:
                held.append(struct.unpack_from(">i", code, at)[0])
                at += 4
            elif b == 12 and code[at : at + 1] == b"\x0c" and len(held) >= 2:
                divisor = held.pop()
                held[-1] = held[-1] / divisor if divisor else 0.0
                at += 1
            else:
                break
        return 0.0


def fonts(files: DataFrame) -> DataFrame:
    """One row per font file."""
    schema = pa.schema([("file_id", pa.int64()), ("format", pa.string()), ("name", pa.string()), *[(c, pa.int32()) for c in ("n_glyphs", "units_per_em", "ascender", "descender")], ("bbox", pa.list_(pa.int32())), ("error", pa.string())])

    def row(file_id, data):
        if data[:1] == b"\x01" and data[:4] != b"\x01\x00\x00\x00":
            font = Cff(data)
            yield {"file_id": file_id, "format": "cff", "name": font.name, "n_glyphs": len(font.glyphs), "units_per_em": font.units_per_em, "bbox": font.bbox}
            return
        if data[:2] == b"%!" or data[:1] == b"\x80":
            font = Type1(data)
            yield {"file_id": file_id, "format": "type1", "name": font.name, "n_glyphs": len(font.widths), "units_per_em": 1000}
            return
        font = Sfnt(data)
        yield {"file_id": file_id, "format": font.format, "name": font.name(), "n_glyphs": font.n_glyphs, "units_per_em": font.units_per_em, "ascender": font.ascender, "descender": font.descender, "bbox": list(font.bbox)}

    return _rows(files, schema, "file_id long, format string, name string, n_glyphs int, units_per_em int, ascender int, descender int, bbox array<int>, error string", row)


def glyphs(files: DataFrame) -> DataFrame:
    """One row per glyph: width and the lowest code point mapped to it."""
    schema = pa.schema([("file_id", pa.int64()), ("glyph", pa.int32()), ("width", pa.int32()), ("code_point", pa.int32()), ("error", pa.string())])

    def row(file_id, data):
        font = Sfnt(data)
        lowest: dict[int, int] = {}
        for code, glyph in sorted(font.code_points().items(), reverse=True):
            lowest[glyph] = code
        for glyph in range(font.n_glyphs):
            yield {"file_id": file_id, "glyph": glyph, "width": font.width(glyph), "code_point": lowest.get(glyph)}

    return _rows(files, schema, "file_id long, glyph int, width int, code_point int, error string", row)


def _rows(files: DataFrame, schema: pa.Schema, ddl: str, each) -> DataFrame:
    def run(batches):
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = list(each(file_id, content.as_py() or b""))
                except Exception as error:
                    rows = [{"file_id": file_id, "error": f"{type(error).__name__}: {error}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").mapInArrow(run, ddl)
