"""StarView metafiles: their drawing actions as SVG."""

from __future__ import annotations

import struct


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        out = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += struct.calcsize("<" + kind)
        return out if len(out) > 1 else out[0]

    def points(self) -> list[tuple[int, int]]:
        return [self.take("ii") for _ in range(self.take("H"))]

    def text(self) -> str:
        n = self.take("H")
        raw = self.data[self.at : self.at + n]
        self.at += n
        return raw.decode("latin-1")

    def versioned(self) -> _Bytes:
        """A structure with version and length; what follows it is skipped."""
        _, size = self.take("HI")
        part = _Bytes(self.data[self.at : self.at + size])
        self.at += size
        return part


def _color(value: int) -> str:
    return f"#{value & 0xFFFFFF:06x}"


def to_svg(data: bytes) -> str:
    """SVG of the actions that are known; others are passed over by their length."""
    from ..operators.html import escape_attribute, escape_text

    if not data.startswith(b"VCLMTF"):
        raise ValueError("no metafile")
    reader = _Bytes(data[6:])
    head = reader.versioned()
    head.take("I")
    head.versioned()
    width, height = head.take("ii")
    count = head.take("I")
    line, fill, color, size, family, out = "#000000", "none", "#000000", 12, "sans-serif", []
    state: list[tuple] = []
    for _ in range(count):
        if reader.at + 8 > len(reader.data):
            break
        kind = reader.take("H")
        body = reader.versioned()
        try:
            shape = f'stroke="{line}" fill="{fill}"'
            if kind == 103:
                x0, y0, x1, y1 = body.take("iiii")
                out.append(f'<rect x="{x0}" y="{y0}" width="{x1 - x0}" height="{y1 - y0}" {shape}/>')
            elif kind in (109, 110):
                points = " ".join(f"{x},{y}" for x, y in body.points())
                out.append(f'<poly{"line" if kind == 109 else "gon"} points="{points}" stroke="{line}" fill="{"none" if kind == 109 else fill}"/>')
            elif kind == 111:
                parts = ["M" + " L".join(f"{x},{y}" for x, y in body.points()) + " Z" for _ in range(body.take("H"))]
                out.append(f'<path d="{" ".join(parts)}" fill-rule="evenodd" {shape}/>')
            elif kind in (112, 113, 114):
                x, y = body.take("ii")
                text = body.text()
                start, n = body.take("HH") if kind == 112 else (0, len(text))
                out.append(f'<text x="{x}" y="{y}" fill="{color}" font-size="{size}" font-family="{escape_attribute(family)}">{escape_text(text[start : start + n])}</text>')
            elif kind == 132:
                value, on = body.take("I?")
                line = _color(value) if on else "none"
            elif kind == 133:
                value, on = body.take("I?")
                fill = _color(value) if on else "none"
            elif kind == 134:
                color = _color(body.take("I"))
            elif kind == 138:
                font = body.versioned()
                family = font.text()
                font.text()
                size = abs(font.take("ii")[1]) or size
            elif kind == 141:
                state.append((line, fill, color, size, family))
            elif kind == 142 and state:
                line, fill, color, size, family = state.pop()
        except struct.error:
            continue  # a short action draws nothing
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{"".join(out)}</svg>'
