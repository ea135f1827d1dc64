"""Small files made from rows, for round trips."""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from functools import lru_cache

from ..sources import crypto, pdf as pdf_source
from ..sources.containers import write_zip
from ..sources.tree import ref

_ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:style="urn:oasis:names:tc:opendocument:xmlns:style:1.0"'
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _x(text: str) -> str:
    return html.escape(_ILLEGAL.sub("", text), quote=False)


def docx(text: str) -> bytes:
    """A paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_x(line)}</w:t></w:r></w:p>' for line in (text or "").split("\n"))
    return write_zip([("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>".encode(), 1)])


def _odf(body: str, kind: str) -> bytes:
    content = f"<office:document-content {_ODF}><office:body>{body}</office:body></office:document-content>"
    return write_zip([("mimetype", f"application/vnd.oasis.opendocument.{kind}".encode(), None), ("content.xml", content.encode(), 1)])


def odt(text: str) -> bytes:
    """A paragraph for each line; runs of spaces and tabs as elements."""

    def inline(line: str) -> str:
        line = re.sub(" {2,}", lambda m: f'\x01{len(m.group())}\x02', line)
        line = _x(line.replace("\t", "\x03").replace("\x01", "\ue001").replace("\x02", "\ue002").replace("\x03", "\ue003"))
        return re.sub("\ue001(\\d+)\ue002", r'<text:s text:c="\1"/>', line).replace("\ue003", "<text:tab/>")

    return _odf("<office:text>" + "".join(f"<text:p>{inline(line)}</text:p>" for line in (text or "").split("\n")) + "</office:text>", "text")


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def ods(rows: list) -> bytes:
    def cell(value) -> str:
        kind = f'office:value-type="float" office:value="{value}"' if _number(value) else 'office:value-type="string"'
        return f"<table:table-cell {kind}><text:p>{_x(str(value))}</text:p></table:table-cell>" if value is not None else "<table:table-cell/>"

    return _odf('<office:spreadsheet><table:table table:name="rows">' + "".join(f"<table:table-row>{''.join(map(cell, r))}</table:table-row>" for r in rows) + "</table:table></office:spreadsheet>", "spreadsheet")


def xlsx(rows: list) -> bytes:
    """Texts as shared strings, numbers as they are."""
    strings: dict[str, int] = {}

    def cell(value, r: int, c: int) -> str:
        if value is None:
            return ""
        if _number(value):
            return f'<c r="{ref(c, r)}"><v>{value}</v></c>'
        return f'<c r="{ref(c, r)}" t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>'

    data = "".join(f'<row r="{i + 1}">' + "".join(cell(v, i, j) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    shared = "".join(f'<si><t xml:space="preserve">{_x(s)}</t></si>' for s in strings)
    return write_zip(
        [
            ("xl/workbook.xml", f'<workbook {_S}><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>'.encode(), 1),
            ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="sheet" Target="worksheets/sheet1.xml"/></Relationships>'.encode(), 1),
            ("xl/sharedStrings.xml", f"<sst {_S}>{shared}</sst>".encode(), 1),
            ("xl/worksheets/sheet1.xml", f"<worksheet {_S}><sheetData>{data}</sheetData></worksheet>".encode(), 1),
        ]
    )


_RUN = 1 << 16


@lru_cache(maxsize=1)
def _packed_run() -> bytes:
    """_RUN letters x, deflated so that more may follow."""
    packer = zlib.compressobj(9, wbits=-15)
    return packer.compress(b"x" * _RUN) + packer.flush(zlib.Z_FULL_FLUSH)


#: Checksums of 0, 1, 2, ... times _RUN letters x, as far as they were needed.
_RUN_CHECKS = [0]


def zip_with_run(path: str, content: bytes, run_path: str, n: int) -> bytes:
    """An archive of one file and of one with n letters x, put together from runs that are packed once: a letter costs next to nothing to make."""
    whole, rest = divmod(n, _RUN)
    while len(_RUN_CHECKS) <= whole:
        _RUN_CHECKS.append(zlib.crc32(b"x" * _RUN, _RUN_CHECKS[-1]))
    pack = lambda b: (lambda p: p.compress(b) + p.flush())(zlib.compressobj(1, wbits=-15))
    out, directory = bytearray(), bytearray()
    for name, packed, check, size in ((path, pack(content), zlib.crc32(content), len(content)), (run_path, _packed_run() * whole + pack(b"x" * rest), zlib.crc32(b"x" * rest, _RUN_CHECKS[whole]), n)):
        raw = name.lstrip("/").encode()
        fields = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, check, len(packed), size, len(raw), 0)
        directory += b"PK\1\2" + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + raw
        out += b"PK\3\4" + fields + raw + packed
    return bytes(out + directory + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 2, 2, len(directory), len(out), 0))


def encoded(text: str, number: int) -> bytes:
    names = ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "latin-1")
    return (text or "").encode(names[number % 5], "replace")


def pdf(text: str, lines_per_page: int = 60) -> bytes:
    """Pages of lines in a one-byte font whose characters are all half an em wide."""
    lines = (text or "").split("\n")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /LastChar 255 /Widths [" + b"500 " * 256 + b"] >>"]
    kids = []
    for at in range(0, len(lines), lines_per_page):
        body = [b"BT /F1 10 Tf 12 TL 40 780 Td"]
        for line in lines[at : at + lines_per_page]:
            raw = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
            body.append(b"(" + raw + b") Tj T*")
        stream = zlib.compress(b"\n".join([*body, b"ET"]), 1)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def record(kind: int, body: bytes) -> bytes:
    """A record of a legacy workbook."""
    return struct.pack("<HH", kind, len(body)) + body


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams are padded beyond the cutoff."""
    sectors, entries = [], []
    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, len(sectors), len(data)))
        sectors += [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
    fat = []
    for _, start, size in entries:
        n = -(-size // 512)
        fat += [start + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    directory = len(sectors)
    cell = lambda name, kind, left, right, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", len(name) * 2 + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    none = 0xFFFFFFFF
    rows = [cell("Root Entry", 5, none, none, 1, 0xFFFFFFFE, 0)]
    for i, (name, start, size) in enumerate(entries):
        rows.append(cell(name, 2, none, i + 2 if i + 1 < len(entries) else none, none, start, size))
    block = b"".join(rows)
    block = block.ljust(-(-len(block) // 512) * 512, b"\0")
    for i in range(0, len(block), 512):
        fat.append(directory + i // 512 + 1 if i + 512 < len(block) else 0xFFFFFFFE)
        sectors.append(block[i : i + 512])
    fat.append(0xFFFFFFFD)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, len(sectors))
    return head.ljust(512, b"\xff") + b"".join(sectors) + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")


def sfnt() -> bytes:
    """A font of three glyphs, two of which stand for A and B."""
    tables = {
        b"cmap": struct.pack(">HH", 0, 1) + struct.pack(">HHI", 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HH", 66, 0xFFFF) + struct.pack(">H", 0) + struct.pack(">HH", 65, 0xFFFF) + struct.pack(">hh", -64, 1) + struct.pack(">HH", 0, 0),
        b"head": b"\0" * 18 + struct.pack(">H", 2048) + b"\0" * 16 + struct.pack(">hhhh", 0, -10, 100, 200) + b"\0" * 10,
        b"hhea": struct.pack(">Ihh", 0, 800, -200) + b"\0" * 26 + struct.pack(">H", 2),
        b"hmtx": struct.pack(">HhHh", 500, 0, 600, 0),
        b"maxp": struct.pack(">IH", 0x10000, 3),
        b"name": struct.pack(">HHH", 0, 1, 18) + struct.pack(">HHHHHH", 3, 1, 0, 6, 4, 0) + "Ab".encode("utf-16-be"),
    }
    at, head, body = 12 + 16 * len(tables), b"", b""
    for tag, data in tables.items():
        head += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data
    return b"\x00\x01\x00\x00" + struct.pack(">HHHH", len(tables), 0, 0, 0) + head + body


def legacy_text(lines: list[str]) -> bytes:
    """A word processor's compound file: paragraphs of one byte a character."""
    body, at = "".join(f"{line}\r" for line in lines).encode("cp1252", "replace"), 0x400
    main = bytearray(at + len(body) + 10)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<I", main, 0x4C, len(body))
    main[at : at + len(body)] = body
    pieces = struct.pack("<II", 0, len(body)) + struct.pack("<HIH", 0, at * 2 | 0x40000000, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main), "0Table": clx})


def legacy_sheet(name: str, number: float, whole: int) -> bytes:
    """A workbook of one sheet: a shared string in A1, a number in B1, a packed whole number in A2."""
    start, sheet = record(0x809, b"\0" * 16), b"S1"
    shared = record(0xFC, struct.pack("<IIHB", 1, 1, len(name), 0) + name.encode("latin-1", "replace"))
    cells = record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0x203, struct.pack("<HHHd", 0, 1, 0, number)) + record(0x27E, struct.pack("<HHHI", 1, 0, 0, whole << 2 | 2))
    head = lambda at: start + record(0x85, struct.pack("<IBBBB", at, 0, 0, len(sheet), 0) + sheet) + shared + record(0x0A, b"")
    return compound({"Workbook": head(len(head(0))) + start + cells + record(0x0A, b"")})


_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def pptx(slides: list[str]) -> bytes:
    """A slide with one text each; they are stored backwards, their order is that of the presentation part."""
    slide = lambda t: f"<p:sld {_P}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{_x(t)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>".encode()
    n = len(slides)
    relations = "".join(f'<Relationship Id="r{i}" Target="slides/s{n - i}.xml"/>' for i in range(n))
    listed = "".join(f'<p:sldId r:id="r{i}"/>' for i in range(n))
    parts = [("ppt/presentation.xml", f"<p:presentation {_P}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>".encode(), 1), ("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{_RELS}">{relations}</Relationships>'.encode(), 1)]
    return write_zip(parts + [(f"ppt/slides/s{n - i}.xml", slide(t), 1) for i, t in enumerate(slides)])


_LISTS = '<text:list-style style:name="L"><text:list-level-style-number text:level="1" style:num-format="1" style:num-suffix="."/><text:list-level-style-number text:level="2" style:num-format="a" style:num-suffix=")" text:display-levels="2"/></text:list-style>'


def odf_text(body: str, styles: str = "", more: list = ()) -> bytes:
    """A text document of given markup."""
    spaces = 'xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:fo="urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0"'
    content = f"<office:document-content {_ODF} {spaces}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>"
    return write_zip([("mimetype", b"application/vnd.oasis.opendocument.text", None), ("content.xml", content.encode(), 1), *more])


def odt_list(tops: int, subs: int, start: int = 0) -> bytes:
    """A list of `tops` items with `subs` items below each; `start`: the number its second item starts at, if any."""
    below = "<text:list>" + "<text:list-item><text:p>s</text:p></text:list-item>" * subs + "</text:list>" if subs else ""
    items = "".join(f'<text:list-item{f" text:start-value=" + chr(34) + str(start) + chr(34) if start and i == 1 else ""}><text:p>t</text:p>{below}</text:list-item>' for i in range(tops))
    return odf_text(f'<text:list text:style-name="L">{items}</text:list>', _LISTS)


def docx_parts(body: str, more: list = ()) -> bytes:
    """A word processor's package of given markup."""
    return write_zip([("word/document.xml", f'<w:document {_W} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>'.encode(), 1), *more])


def docx_list(levels: list[int]) -> bytes:
    """Paragraphs of one list at given levels."""
    spec = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'
    body = "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{n}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>x</w:t></w:r></w:p>' for n in levels)
    return docx_parts(body, [("word/numbering.xml", f"<w:numbering {_W}>{spec}</w:numbering>".encode(), 1)])


def pdf_objects(objects: list[bytes], trailer: bytes = b"") -> bytes:
    """A file of numbered objects, the first of them its catalog."""
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, trailer, start))


def pdf_page(content: bytes, more: bytes = b"", extra: list[bytes] = (), trailer: bytes = b"") -> bytes:
    """One page with given content, page entries, and objects from number 6 on."""
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /LastChar 255 /Widths [" + b"500 " * 256 + b"] >>"
    page = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> " + more + b" >>"
    stream = b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"
    return pdf_objects([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", page, font, stream, *extra], trailer)


def sealed(revision: int, method: bytes, password: bytes = b"") -> bytes:
    """A PDF whose info title is encrypted by the standard handler."""
    pad = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
    ident, owner = b"0123456789abcdef", b"o" * 32
    hexed = lambda b: b"<" + b.hex().encode() + b">"
    if revision == 6:
        file_key, user = bytes(range(32)), b"v" * 8 + b"k" * 8

        def digest(salt):
            k, i = hashlib.sha256(password + salt).digest(), 0
            while True:
                e = crypto.aes_cbc_encrypt(k[:16], k[16:32], (password + k) * 64)
                k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[int.from_bytes(e[:16], "big") % 3](e).digest()
                i += 1
                if i >= 64 and e[-1] <= i - 32:
                    return k[:32]

        user = digest(b"v" * 8) + user
        extra = b"/UE " + hexed(crypto.aes_cbc_encrypt(digest(b"k" * 8), bytes(16), file_key))
        key = file_key
    else:
        key = hashlib.md5((password + pad)[:32] + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        user = pdf_source.rc4(key, hashlib.md5(pad + ident).digest())
        for i in range(1, 20):
            user = pdf_source.rc4(bytes(b ^ i for b in key), user)
        user, extra = user + b"\0" * 16, b""
        key = hashlib.md5(key + b"\4\0\0\0\0" + (b"sAlT" if method == b"AESV2" else b"")).digest()
    title = b"Secret title"
    if method == b"V2":
        body = pdf_source.rc4(key, title)
    else:
        n = 16 - len(title) % 16
        body = b"i" * 16 + crypto.aes_cbc_encrypt(key, b"i" * 16, title + bytes([n]) * n)
    cf = b"/CF << /StdCF << /CFM /" + method + b" >> >> /StmF /StdCF /StrF /StdCF" if revision >= 4 else b""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>", b"<< /Filter /Standard /V 4 /R %d /Length 128 /P -4 /O %s /U %s %s %s >>" % (revision, hexed(owner), hexed(user), extra, cf), b"<< /Title %s >>" % hexed(body)]
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for i, o in enumerate(objects):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 5\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size 5 /Root 1 0 R /Encrypt 3 0 R /Info 4 0 R /ID [%s %s] >>\nstartxref\n%d\n%%%%EOF" % (hexed(ident), hexed(ident), start))


def cff() -> bytes:
    """A bare font of two glyphs, 500 and 650 wide."""
    index = lambda *items: struct.pack(">HB", len(items), 1) + bytes(1 + sum(map(len, items[:i])) for i in range(len(items) + 1)) + b"".join(items) if items else b"\0\0"
    number = lambda n: b"\x1c" + struct.pack(">h", n)
    programs = index(b"\x0e", number(50) + number(0) + number(0) + b"\x15\x0e")
    private = number(500) + b"\x14" + number(600) + b"\x15"
    make = lambda glyphs, priv: b"\1\0\4\1" + index(b"Mini") + index(number(glyphs) + b"\x11" + number(len(private)) + number(priv) + b"\x12") + index() + index()
    size = len(make(0, 0))
    return make(size, size + len(programs)) + programs + private


def type1() -> bytes:
    """A font program with one glyph, 100 wide, in encrypted form."""
    def lock(data, key):
        out = bytearray()
        for b in data:
            c = b ^ key >> 8
            key = (c + key) * 52845 + 22719 & 0xFFFF
            out.append(c)
        return bytes(out)

    program = lock(b"\0\0\0\0" + bytes([139, 139 + 100, 13, 14]), 4330)
    private = b"\0\0\0\0/CharStrings 1 dict dup begin /A %d RD " % len(program) + program + b" ND end"
    return b"%!PS-AdobeFont-1.0\n/FontName /Tiny def\ncurrentfile eexec\n" + lock(private, 55665).hex().encode()
