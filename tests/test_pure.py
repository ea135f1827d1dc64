"""Functions without Spark: dialects, encodings, signatures, numbers, ciphers, paths, cursors."""

import base64
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom import dims
from paperloom.functions.numbering import Counter, plain_number
from paperloom.operators import tree as T
from paperloom.plans import builders
from paperloom.sources import containers as C
from paperloom.sources import crypto, csvdoc, detect, encoding, pdf
from paperloom.sources.tree import Cursor, label


def test_file_types_are_unique():
    rows = dims.file_type_rows()
    assert len(rows) == 51
    mimes = [m for r in rows.values() for m in r["mimetypes"]]
    extensions = [e for r in rows.values() for e in r["extensions"]]
    assert len(mimes) == len(set(mimes)) and len(extensions) == len(set(extensions))
    assert dims.type_by_extension("DOCX") == "docx" and dims.type_by_extension("zzz") == "unknown"
    assert dims.type_by_mimetype("image/jpg") == "jpg"
    assert not any(r["capabilities"]["encrypt"] for r in rows.values())


def test_encoding_names():
    assert len(dims.encoding_rows()) == 40 and sum(r["decodable"] for r in dims.encoding_rows()) == 33
    for name, want in (("utf8", "UTF-8"), ("LATIN-1", "ISO-8859-1"), ("Windows 1252", "windows-1252"), ("sjis", "Shift_JIS"), ("nope", None)):
        assert dims.encoding_by_name(name) == want
    assert not dims.is_decodable("big5")


@pytest.mark.parametrize(
    "data, name, want",
    [
        (b"caf\xe9", "ISO-8859-1", "café"),
        (b"\x80", "windows-1252", "€"),
        (b"\xa4", "ISO-8859-15", "€"),
        (b"\x81", "windows-1252", "�"),
        (b"a\xffb", "UTF-8", "a�b"),
        (b"\xff\xfea\x00", "UTF-16LE", "a"),
        (b"\x3d\xd8\x00\xde", "UTF-16LE", "\U0001f600"),
        (b"\x00\xd8", "UTF-16LE", "�"),
        (b"a\x00b", "UTF-16LE", "a�"),
        (b"\xef\xbb\xbfa", "windows-1252", "ï»¿a"),
        (b"\xef\xbb\xbfa", "UTF-8", "a"),
    ],
)
def test_transcoding(data, name, want):
    assert encoding.transcode(data, name) == want


def test_marks_and_guesses():
    assert encoding.bom(b"\xff\xfe\x00\x00") == "UTF-32LE" and encoding.bom(b"\xff\xfea") == "UTF-16LE"
    assert encoding.guess("é".encode()) == "UTF-8" and encoding.guess(b"\x00\x01\xff") is None
    assert encoding.declared(b'<?xml version="1.0" encoding="latin1"?>') == "ISO-8859-1"
    with pytest.raises(encoding.Undecodable):
        encoding.transcode(b"x", "big5")


HEADS = {
    "webp": b"RIFF\0\0\0\0WEBP", "wav": b"RIFF\0\0\0\0WAVE", "avi": b"RIFF\0\0\0\0AVI ", "unknown": b"RIFF\0\0\0\0XXXX", "mov": b"\0\0\0\x14ftypqt  ", "3gp": b"\0\0\0\x14ftyp3gp5",
    "heif": b"\0\0\0\x14ftypheic", "avif": b"\0\0\0\x14ftypavif", "m4a": b"\0\0\0\x14ftypM4A ", "mp4": b"\0\0\0\x14ftypisom", "tiff": b"MM\0*", "mkv": b"\x1aE\xdf\xa3", "ogg": b"OggS",
    "flac": b"fLaC", "mp3": b"ID3\4", "ico": b"\0\0\1\0", "jp2": b"\xff\x4f\xff\x51", "jxl": b"\xff\x0a", "psd": b"8BPS", "wmf": b"\xd7\xcd\xc6\x9a", "emf": b"\1\0\0\0" + b"\0" * 36 + b" EMF", "jpg": b"\xff\xd8\xff\xe1\0\0Exif\0\0",
}


@pytest.mark.parametrize("kind", HEADS)
def test_signatures(kind):
    assert detect.magic(HEADS[kind]) == kind


def test_short_heads_and_orders():
    assert detect.magic(b"") == detect.magic(b"B") == detect.magic(b"\1\0\0\0" + b"\0" * 40) == "unknown"
    assert detect.preferred(["zip", "odt"]) == ["odt", "zip"]
    assert detect.preferred(["txt", "csv", "json"], priority=("txt",)) == ["txt", "json", "csv"]
    assert detect.preferred(["zip"], "odt") == ["odt"]


def test_text_candidates():
    assert detect.candidates(b"hello") == ["txt"]
    assert detect.candidates(b'{"a": 1}') == ["txt", "json"]
    assert detect.candidates(b"a,b\n1,2\n") == ["txt", "csv"]
    assert detect.candidates(b"<r><a/></r>") == ["txt", "xml"]
    assert detect.candidates(b'<svg xmlns="http://www.w3.org/2000/svg"/>') == ["txt", "xml", "svg"]
    assert detect.candidates(b"PK\3\4broken") == []
    assert not detect.is_json(b"NaN") and not detect.is_json(b"1 x")


@pytest.mark.parametrize("text", ["a,b,c\n1,2,3\n", "a,b,c\n1,2,3", "a,b,c\r\n1,2,3\r\n", 'a,b\n"x,y",1\n', "a;b\n1;2\n", "a\tb\n1\t2\n", "a|b\n1|2\n", "name;note\nx;a, b\ny;c, d, e\n", "a, b, c\n1, 2, 3\n4, 5, 6\n"])
def test_is_csv(text):
    found = csvdoc.probe(text)
    assert found and found.is_csv


@pytest.mark.parametrize("text", ["", "abc\ndef\n", "a,b,c,d,e,f,g,h\n", 'a,b\n"x,1\n', "This is a sentence, which goes on and on for long\nAnother sentence, which goes on as well as this\nAnd a third sentence, with as many words in it\n"])
def test_is_not_csv(text):
    found = csvdoc.probe(text)
    assert found is None or not found.is_csv


def test_incomplete_samples_and_directives():
    assert csvdoc.probe('a,b\n1,2\n3,"x', complete=True) is None
    assert csvdoc.probe('a,b\n1,2\n3,"x', complete=False).is_csv
    found = csvdoc.probe("sep=;\na;b\n1;2\n")
    assert (found.separator, found.directive, found.columns, found.records) == (";", True, 2, 2)
    assert csvdoc.read(b"sep=;\na;b\n") == [["a", "b"]]
    assert csvdoc.read(b"sep=;\na;b\n", csvdoc.Options(separator=";")) == [["sep=", ""], ["a", "b"]]
    for bad in ({"separator": "\n"}, {"separator": '"'}, {"separator": ",,"}):
        with pytest.raises(ValueError):
            csvdoc.Options(**bad)


def test_records():
    read = lambda t: csvdoc.records(t, ",")
    assert read('a"b,c"d\n') == ([["ab,cd"]], False)
    assert read('"x""y",1\n') == ([['x"y', "1"]], False)
    assert read('\n""\n\n') == ([[""]], False)
    assert read('a,"b\nc') == ([["a", "b\nc"]], True)
    assert read("a,\r\n,b") == ([["a", ""], ["", "b"]], False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\0")), min_size=2, max_size=4), min_size=1, max_size=6), st.sampled_from(",;\t|"))
def test_written_records_are_read(rows, separator):
    assert csvdoc.records(csvdoc.write(rows, separator), separator) == (rows, False)


def test_list_numbers():
    assert [plain_number(n, "letter_lower") for n in (1, 26, 27, 52, 703)] == ["a", "z", "aa", "az", "aaa"]
    assert [plain_number(n, "roman_upper") for n in (4, 1994, 3999, 4000, 0)] == ["IV", "MCMXCIV", "MMMCMXCIX", "4000", "0"]
    assert plain_number(7, "decimal_zero") == "07" and plain_number(3, "bullet") == ""


def test_list_counters():
    c = Counter()
    steps = [(0, "%1."), (1, "%1.%2."), (1, "%1.%2."), (0, "%1."), (1, "%1.%2.")]
    assert [c.advance(level, text, "decimal") for level, text in steps] == ["1.", "1.1.", "1.2.", "2.", "2.1."]
    c = Counter()
    assert c.advance(0, "%1%", "decimal", 5) == "5%" and c.advance(0, "100% %9", "decimal") == "100% "
    c.restart(0, 3)
    assert c.advance(0, "%1", "roman_lower") == "iii"


def test_labels_and_cursor():
    assert [label(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    t = Cursor()
    t.add_cell(1, 2)
    t.add_cell(2, 1)
    assert (t.col, t.row) == (3, 0)
    t.add_row()
    assert (t.col, t.row) == (1, 1)
    t.add_cell()
    t.add_row(3)
    assert (t.col, t.row) == (0, 4)


def test_element_paths():
    assert T.parse_path("/child:3/cell:A17") == ["child:3", "cell:A17"] and T.parse_path("") == []
    for bad in ("child:3", "/child:x", "/other:1", "/cell:7"):
        with pytest.raises(ValueError):
            T.parse_path(bad)


def test_file_paths():
    assert C.normal_path("/a/./b/../c") == "/a/c" and C.normal_path("../a") == "../a"
    assert C.is_escaping("a/../../b") and not C.is_escaping("a/..")
    assert C.join_path("/a", "b/../c") == "/a/c" and C.parent_path("/a/b") == "/a"
    assert (C.basename("/a/b.tar.gz"), C.extension("/a/b.tar.gz")) == ("b.tar.gz", "gz")
    assert C.common_root("/a/b/c", "/a/x") == "/a" and C.rebase_path("/a/b/c", "/a/x") == "../b/c"
    with pytest.raises(ValueError):
        C.parent_path("/")


def test_ciphers():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.Aes(key).encrypt(plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.Aes(bytes(range(32))).encrypt(plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.Aes(bytes(range(24))).decrypt(crypto.Aes(bytes(range(24))).encrypt(plain)) == plain
    iv, text = b"i" * 16, b"x" * 48
    assert crypto.aes_cbc_decrypt(key, iv, crypto.aes_cbc_encrypt(key, iv, text)) == text
    assert crypto._pi_words()[:2] == [0x243F6A88, 0x85A308D3]
    assert crypto.Blowfish(b"\0" * 8).encrypt(b"\0" * 8).hex() == "4ef997456198dd78"
    assert pdf.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_encrypted_opendocument():
    from paperloom.plans import builders

    plain, salt, iv, rounds = builders.odt("secret  text"), b"s" * 16, b"v" * 16, 10
    import io
    import zipfile

    content = zipfile.ZipFile(io.BytesIO(plain)).read("content.xml")
    packer = zlib.compressobj(wbits=-15)
    packed = packer.compress(content) + packer.flush()
    body = packed + bytes([16 - len(packed) % 16]) * (16 - len(packed) % 16)
    key = hashlib.pbkdf2_hmac("sha1", hashlib.sha256(b"pw").digest(), salt, rounds, 32)
    b64 = lambda b: base64.b64encode(b).decode()
    manifest = f'''<m:manifest xmlns:m="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><m:file-entry m:full-path="/" m:media-type="application/vnd.oasis.opendocument.text"/>
    <m:file-entry m:full-path="content.xml" m:size="{len(content)}"><m:encryption-data m:checksum-type="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0#sha256-1k" m:checksum="{b64(hashlib.sha256(packed[:1024]).digest())}">
    <m:algorithm m:algorithm-name="http://www.w3.org/2001/04/xmlenc#aes256-cbc" m:initialisation-vector="{b64(iv)}"/><m:key-derivation m:key-derivation-name="PBKDF2" m:key-size="32" m:iteration-count="{rounds}" m:salt="{b64(salt)}"/>
    <m:start-key-generation m:start-key-generation-name="http://www.w3.org/2000/09/xmldsig#sha256" m:key-size="32"/></m:encryption-data></m:file-entry></m:manifest>'''
    locked = C.write_zip([("mimetype", b"application/vnd.oasis.opendocument.text", None), ("META-INF/manifest.xml", manifest.encode(), 6), ("content.xml", crypto.aes_cbc_encrypt(key, iv, body), None)])
    from paperloom.sources import decode

    assert detect.encryption_state(locked, detect.candidates(locked)) == "encrypted"
    with pytest.raises(decode.Unsupported):
        decode.open_document(locked)
    _, document = decode.open_document(locked, decode.Options(password="pw"))
    assert [r["text"] for r in document.tree.rows if r["element_type"] == "text"] == ["secret  text"]
    with pytest.raises(decode.Unsupported):
        decode.open_document(locked, decode.Options(password="no", as_type="odt"))


def test_pdf_filters():
    assert pdf.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    assert pdf.apply_filter("ASCIIHexDecode", b"61 62 6>", {}) == b"ab`"
    assert pdf.apply_filter("A85", base64.a85encode(b"hello") + b"~>", {}) == b"hello"
    assert pdf.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = b"\x00\x01\x02\x03" + b"\x02\x01\x01\x01"
    assert pdf.predict(rows, {"Predictor": 12, "Columns": 3}) == b"\1\2\3\2\3\4"


def test_pdf_objects_and_functions():
    o = pdf.Lexer(rb"<< /A#42 [1 -2.5 (a\(b\)\101) <6162> 3 0 R true null] >>").object()
    assert o == {"AB": [1, -2.5, b"a(b)A", b"ab", pdf.Ref((3, 0)), True, None]}
    assert pdf.calculator(b"{ 0 div }", [5.0]) == [0.0]
    assert pdf.calculator(b"{ dup 0.5 gt { pop 1 } { pop 0 } ifelse }", [0.7]) == [1.0]
    file = pdf.File(b"%PDF-1.4")
    two = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 1], "C1": [1, 0], "N": 1}
    assert pdf.functions_eval(file, two, [0.25]) == [0.25, 0.75]
    three = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [two, two]}
    assert pdf.functions_eval(file, three, [0.75]) == [0.5, 0.5]
    assert pdf.functions_eval(file, pdf.Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 1], "Size": [2], "BitsPerSample": 8}, b"\x00\xff"), [0.5]) == [0.5]


def test_pdf_glyph_names_and_cmaps():
    assert [pdf.glyph_text(n) for n in ("A", "eacute", "uni00E9", "u1F600", "a.alt", "nope")] == ["A", "é", "é", "\U0001f600", "a", ""]
    m = pdf.CMap(b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0042> endbfrange")
    assert m.map == {b"\1": "A", b"\2": "B", b"\3": "C", b"\4": "D"} and m.lengths == {1}


@pytest.mark.parametrize("revision, method", [(3, b"V2"), (4, b"V2"), (4, b"AESV2"), (6, b"AESV3")])
def test_encrypted_pdfs(revision, method):
    opened = pdf.File(builders.sealed(revision, method))
    assert not opened.encrypted and opened.meta() == {"title": "Secret title"}
    assert pdf.File(builders.sealed(revision, method, b"pw")).encrypted
    assert pdf.File(builders.sealed(revision, method, b"pw"), b"pw").meta() == {"title": "Secret title"}
    assert pdf.File(builders.sealed(revision, method).replace(b"/R %d " % revision, b"/R 5 ")).encrypted


def test_pdf_colours():
    file = pdf.File(b"%PDF-1.4")
    n = pdf.Name
    assert pdf.to_rgb(file, n("DeviceCMYK"), [0, 1, 1, 0]) == (1, 0, 0) and pdf.to_rgb(file, n("DeviceGray"), [0.5]) == (0.5,) * 3
    assert pdf.to_rgb(file, [n("Indexed"), n("DeviceRGB"), 1, b"\0\0\0\xff\0\xff"], [1]) == (1, 0, 1)
    assert pdf.to_rgb(file, [n("ICCBased"), pdf.Stream({"N": 3}, b"")], [0.1, 0.2, 0.3]) == (0.1, 0.2, 0.3)
    tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0, 0], "C1": [0, 0, 1, 0], "N": 1}
    assert pdf.to_rgb(file, [n("Separation"), n("Spot"), n("DeviceCMYK"), tint], [1.0]) == (1, 1, 0)
    white = pdf.to_rgb(file, [n("Lab"), {"WhitePoint": [0.9505, 1.0, 1.089]}], [100.0, 0.0, 0.0])
    assert all(abs(v - 1) < 0.01 for v in white)
