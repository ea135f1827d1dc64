"""Queries over files of every format, made from the synthetic tables: detection, containers, trees, sheets, lists, styles, pages, fonts, views, edits."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from .. import dims
from ..functions import numbering, paths, registry, text
from ..operators import edit, html, styles, tree
from ..sources import containers, crypto, csvdoc, decode, detect, fonts, scratch
from ..streaming import windows
from . import builders
from .queries import per_row, query, table


def _files(spark, sf_dir, make, *columns):
    """A file for each customer, made from its key and other columns."""
    c = table(spark, sf_dir, "customer").withColumn("no", F.col("c_custkey").cast("long"))
    return per_row(c, make, "no", *columns, key="c_custkey")


def _key():
    return F.col("file_id").alias("c_custkey")


def _chosen(*values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))


# Detection

#: The first bytes of each type and its name.
_MAGIC = [
    ("zip", "504B0304"), ("cfb", "D0CF11E0A1B11AE1"), ("pdf", "255044462D"), ("png", "89504E470D0A1A0A"), ("jpg", "FFD8FFDB"), ("jpg", "FFD8FFE000104A4649460001"), ("jpg", "FFD8FFEE"), ("jpg", "FFD8FFE10000457869660000"),
    ("bmp", "424D"), ("gif", "474946383761"), ("svm", "56434C4D5446"), ("rtf", "7B5C72746631"), ("wpd", "FF575043"), ("otf", "4F54544F"), ("ttf", "00010000"), ("ttf", "74727565"), ("ttf", "74746366"), ("avi", "524946460000000041564920"),
    ("3gp", "0000001466747970336770"), ("avif", "000000146674797061766966"), ("heif", "000000146674797068656963"), ("m4a", "00000014667479704D344120"), ("tiff", "49492A00"), ("ogg", "4F676753"), ("flac", "664C6143"), ("mp3", "494433"), ("mp3", "FFFB"),
    ("mp3", "FFF3"), ("mp3", "FFF2"), ("mp3", "FFFA"), ("ico", "00000100"), ("ico", "00000200"), ("jp2", "0000000C6A5020200D0A870A"), ("jp2", "FF4FFF51"), ("jxl", "0000000C4A584C200D0A870A"), ("psd", "38425053"),
    ("wmf", "D7CDC69A"), ("wmf", "010009000003"), ("wmf", "020009000003"), ("emf", "01000000" + "00" * 36 + "20454D46"), ("unknown", "01000000" + "00" * 36 + "20454D47"),
]


@query(f"SELECT c_custkey, ({[k for k, _ in _MAGIC]!r})[c_custkey % {len(_MAGIC)} + 1] AS kind FROM customer")
def magic_types(spark, sf_dir):
    head = F.unhex(_chosen(*[h for _, h in _MAGIC]))
    return table(spark, sf_dir, "customer").select("c_custkey", detect.magic_type(F.concat(head, F.encode("c_name", "UTF-8"))).alias("kind"))


_PACKAGES = "[['zip', 'docx'], ['zip', 'xlsx'], ['zip', 'pptx'], ['zip', 'odt'], ['zip', 'ods'], ['cfb', 'doc'], ['cfb', 'xls'], ['cfb', 'ppt'], ['zip'], ['cfb'], ['zip', 'odt'], ['zip', 'odg']]"


def _package(no, name):
    kind = no % 12
    if kind < 8:
        return (
            lambda: builders.docx(name), lambda: builders.xlsx([[name]]), lambda: builders.pptx([name]), lambda: builders.odt(name), lambda: builders.ods([[name]]),
            lambda: builders.legacy_text([name]), lambda: builders.legacy_sheet(name, 1.5, no), lambda: builders.compound({"PowerPoint Document": b"x"}),
        )[kind]()
    if kind == 9:
        return builders.compound({"Other": name.encode()})
    mimetype = {8: None, 10: b"application/vnd.oasis.opendocument.text-template", 11: b"application/vnd.sun.xml.draw"}[kind]
    return containers.write_zip([("mimetype", mimetype, None)] if mimetype else [("a.txt", name.encode(), 1)])


@query(f"SELECT c_custkey, ({_PACKAGES})[c_custkey % 12 + 1] AS file_types, ({_PACKAGES})[c_custkey % 12 + 1][-1] AS file_type FROM customer")
def container_types(spark, sf_dir):
    """Types of documents in archives and compound files, templates and older types among them."""
    found = detect.detect(_files(spark, sf_dir, _package, "c_name"))
    return found.select(_key(), "file_types", "file_type")


@query(
    "SELECT c_custkey, e AS extension, ['odt', 'docx', 'jpg', 'csv', 'unknown', 'ppt'][c_custkey % 6 + 1] AS by_extension, ['application/pdf', 'image/jpg', 'TEXT/CSV', 'application/json', 'x/y', 'image/png'][c_custkey % 6 + 1] AS mimetype, "
    "['pdf', 'jpg', 'csv', 'json', 'unknown', 'png'][c_custkey % 6 + 1] AS by_mimetype FROM (SELECT c_custkey, ['odt', 'DOCX', 'jpeg', 'csv', 'zzz', 'ppt'][c_custkey % 6 + 1] AS e FROM customer)"
)
def type_lookups(spark, sf_dir):
    """The type table by extension and by media type, whatever the case."""
    types = dims.file_types(spark)
    extensions = types.select(F.explode("extensions").alias("e"), F.col("name").alias("by_extension"))
    mimes = types.select(F.explode("mimetypes").alias("m"), F.col("name").alias("by_mimetype"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", _chosen("odt", "DOCX", "jpeg", "csv", "zzz", "ppt").alias("extension"), _chosen("application/pdf", "image/jpg", "TEXT/CSV", "application/json", "x/y", "image/png").alias("mimetype"))
    rows = rows.join(F.broadcast(extensions), F.lower("extension") == F.col("e"), "left").join(F.broadcast(mimes), F.lower("mimetype") == F.lower("m"), "left")
    return rows.select("c_custkey", "extension", F.coalesce("by_extension", F.lit("unknown")).alias("by_extension"), "mimetype", F.coalesce("by_mimetype", F.lit("unknown")).alias("by_mimetype"))


@query("SELECT c_custkey, ['UTF-8', 'ISO-8859-1', 'windows-1252', 'Shift_JIS', NULL, 'KOI8-R'][c_custkey % 6 + 1] AS encoding, [true, true, true, false, NULL, true][c_custkey % 6 + 1] AS decodable FROM customer")
def encoding_aliases(spark, sf_dir):
    known = dims.encodings(spark).select(F.explode("labels").alias("label"), F.col("name").alias("encoding"), "decodable")
    name = F.lower(F.translate(_chosen("utf8", "LATIN-1", "Windows 1252", "sjis", "nope", "koi8_r"), "-_ ", ""))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("label")).join(F.broadcast(known), "label", "left").select("c_custkey", "encoding", "decodable")


@query("SELECT c_custkey, how, CASE WHEN how IN ('listed first', 'as text') THEN 'text' ELSE 'spreadsheet' END AS opened FROM customer, (SELECT unnest(['by itself', 'listed first', 'as text', 'as csv']) AS how)")
def open_preference(spark, sf_dir):
    """One delimited file opened by itself, with text listed first, as text, as csv."""
    made = _files(spark, sf_dir, lambda no, name: f"name,key\n{name},{no}\n".encode(), "c_name")
    out = None
    for how, options in (("by itself", decode.Options()), ("listed first", decode.Options(priority=("txt",))), ("as text", decode.Options(as_type="txt")), ("as csv", decode.Options(as_type="csv"))):
        root = decode.elements(made, options, types=("root",)).select(_key(), F.lit(how).alias("how"), F.element_at("attrs", "document").alias("opened"))
        out = root if out is None else out.unionByName(root)
    return out


def _locked_odt(no, name):
    """An OpenDocument text, encrypted for the customer's name."""
    import base64

    plain, salt, iv, rounds = builders.odt(f"secret of {name}"), b"s" * 16, b"v" * 16, 10
    import io
    import zipfile

    content = zipfile.ZipFile(io.BytesIO(plain)).read("content.xml")
    packer = zlib.compressobj(wbits=-15)
    packed = packer.compress(content) + packer.flush()
    pad = 16 - len(packed) % 16
    key = hashlib.pbkdf2_hmac("sha1", hashlib.sha256(b"pw").digest(), salt, rounds, 32)
    b64 = lambda b: base64.b64encode(b).decode()
    names = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
    manifest = (
        f'<m:manifest xmlns:m="{names}"><m:file-entry m:full-path="/" m:media-type="application/vnd.oasis.opendocument.text"/><m:file-entry m:full-path="content.xml" m:size="{len(content)}">'
        f'<m:encryption-data m:checksum-type="{names}#sha256-1k" m:checksum="{b64(hashlib.sha256(packed[:1024]).digest())}"><m:algorithm m:algorithm-name="http://www.w3.org/2001/04/xmlenc#aes256-cbc" m:initialisation-vector="{b64(iv)}"/>'
        f'<m:key-derivation m:key-derivation-name="PBKDF2" m:key-size="32" m:iteration-count="{rounds}" m:salt="{b64(salt)}"/><m:start-key-generation m:start-key-generation-name="http://www.w3.org/2000/09/xmldsig#sha256" m:key-size="32"/></m:encryption-data></m:file-entry></m:manifest>'
    )
    sealed = crypto.aes_cbc_encrypt(key, iv, packed + bytes([pad]) * pad)
    return containers.write_zip([("mimetype", b"application/vnd.oasis.opendocument.text", None), ("META-INF/manifest.xml", manifest.encode(), 1), ("content.xml", sealed, None)])


def _lockable(no, name):
    if no % 4 == 0:
        return _locked_odt(no, name)
    if no % 4 == 1:
        return builders.odt(name)
    locked = builders.pdf_objects([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 0 >>", b"<< /Filter /Standard /R 5 >>"], b"/Encrypt 3 0 R" if no % 4 == 2 else b"")
    return locked + b"\n%" + b" " * 5000


@query("SELECT c_custkey, ['encrypted', 'not_encrypted', 'encrypted', 'not_encrypted'][c_custkey % 4 + 1] AS state FROM customer")
def encryption_states(spark, sf_dir):
    """Documents with an encrypted entry, and PDF files whose trailer stands far before the end."""
    return detect.detect(_files(spark, sf_dir, _lockable, "c_name")).select(_key(), F.col("encryption_state").alias("state"))


@query("SELECT c_custkey, c_custkey % 2 = 1 AS can_edit, c_custkey % 4 = 0 AS can_decrypt, c_custkey % 4 <> 0 AS can_translate FROM customer")
def capabilities_of_files(spark, sf_dir):
    made = _files(spark, sf_dir, lambda no, name: _locked_odt(no, name) if no % 4 == 0 else builders.odt(name) if no % 2 else b"\x38\x42\x50\x53" + name.encode(), "c_name")
    caps = detect.file_capabilities(detect.detect(made))
    return caps.select(_key(), F.col("capabilities.edit").alias("can_edit"), F.col("capabilities.decrypt").alias("can_decrypt"), F.col("capabilities.translate_html").alias("can_translate"))


@query("SELECT c_custkey, 'secret of ' || c_name AS text FROM customer")
def odf_decrypted(spark, sf_dir):
    """Texts of encrypted documents, opened with their password."""
    return tree.text_of(decode.elements(_files(spark, sf_dir, _locked_odt, "c_name"), decode.Options(password="pw"))).select(_key(), "text")


@query("SELECT c_custkey, [NULL, 'no content', 'too large', 'no decoder'][c_custkey % 4 + 1] AS problem FROM customer WHERE c_custkey % 4 > 0")
def files_that_do_not_open(spark, sf_dir):
    """Every file without rows in the other tables has one here."""
    made = _files(spark, sf_dir, lambda no, name: (b"a,b\n1,2\n", None, b"x" * 200, b"PK\3\4broken")[no % 4], "c_name")
    errors = decode.errors(made, decode.Options(max_file_bytes=100))
    problem = F.when(F.col("error").contains("no content"), "no content").when(F.col("error").contains("too large"), "too large").when(F.col("error").contains("no decoder"), "no decoder")
    return errors.select(_key(), problem.alias("problem"))


# Containers and paths


@query("SELECT c_custkey, s AS entry_path, true AS is_file, (CASE s WHEN '/A' THEN 4096 ELSE 4608 END)::BIGINT AS size, md5(c_name) AS starts FROM customer, (SELECT unnest(['/A', '/B']) AS s)")
def compound_entries(spark, sf_dir):
    made = _files(spark, sf_dir, lambda no, name: builders.compound({"A": name.encode(), "B": name.encode().ljust(4608, b"\0")}), "c_name")
    found = containers.entries(made).where("is_file")
    body = F.substring_index(F.decode("content", "ISO-8859-1"), "\0", 1)
    return found.select(_key(), "entry_path", "is_file", "size", F.md5(body.cast("binary")).alias("starts"))


def _tree_zip(no, name):
    deep = "/".join(f"d{i}" for i in range(no % 4))
    return builders.zip_with_run("/top.txt", name.encode(), f"/{deep + '/' if deep else ''}leaf.png", no)


@query("SELECT c_custkey, '/top.txt' AS entry_path, 0 AS depth, 'text/plain' AS mimetype FROM customer UNION ALL SELECT c_custkey, ['/', '/d0/', '/d0/d1/', '/d0/d1/d2/'][c_custkey % 4 + 1] || 'leaf.png', (c_custkey % 4)::INTEGER, 'image/png' FROM customer")
def archive_walk(spark, sf_dir):
    found = containers.walk(containers.entries(_files(spark, sf_dir, _tree_zip, "c_name"), bodies=False))
    return found.select(_key(), "entry_path", F.col("depth").cast("int").alias("depth"), "mimetype")


@query("SELECT c_custkey, unnest((['/', '/d0', '/d0/d1', '/d0/d1/d2'])[1:c_custkey % 4 + 1]) AS path FROM customer")
def archive_directories(spark, sf_dir):
    return containers.directories(containers.entries(_files(spark, sf_dir, _tree_zip, "c_name"), bodies=False)).select(_key(), "path")


@query("SELECT c_custkey, sha256(c_name) AS top, c_custkey::BIGINT AS leaf_size FROM customer")
def archive_bodies(spark, sf_dir):
    """Contents of entries read through the view of an archive."""
    found = containers.digests(_files(spark, sf_dir, _tree_zip, "c_name"), ("text/plain",))
    by_file = found.groupBy("file_id").agg(F.max(F.when(F.col("entry_path") == "/top.txt", F.col("sha256"))).alias("top"), F.max(F.when(F.col("mimetype") == "image/png", F.col("length"))).alias("leaf_size"))
    return by_file.select(_key(), "top", "leaf_size")


@query(
    "SELECT o_orderkey, '/c' || o_custkey || '/' || o_orderkey || '.tar.gz' AS normal, '/c' || o_custkey AS parent, o_orderkey || '.tar.gz' AS name, 'gz' AS extension, '/c' || o_custkey || '/x' AS joined, o_orderkey % 2 = 0 AS escaping, "
    "CASE WHEN o_custkey % 2 = 0 THEN '/c' || o_custkey ELSE '/' END AS shared, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey || '.tar.gz' ELSE '../c' || o_custkey || '/' || o_orderkey || '.tar.gz' END AS relative FROM orders"
)
def path_algebra(spark, sf_dir):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    raw = F.concat(F.lit("/c"), customer, F.lit("/./b/../"), key, F.lit(".tar.gz"))
    base = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("/c"), customer)).otherwise(F.lit("/other"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", paths.normal_path(raw).alias("normal"), base.alias("base"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "../").otherwise("a/../"), key).alias("loose"))
    parent = paths.parent_path(F.col("normal"))
    return rows.select(
        "o_orderkey", "normal", parent.alias("parent"), paths.basename(F.col("normal")).alias("name"), paths.extension(F.col("normal")).alias("extension"), paths.join_path(parent, F.lit("./y/../x")).alias("joined"),
        paths.is_escaping(F.col("loose")).alias("escaping"), paths.common_root(F.col("normal"), F.col("base")).alias("shared"), paths.rebase_path(F.col("normal"), F.col("base")).alias("relative"),
    )


# Trees


@query("SELECT c_custkey, 0 AS slide, c_name AS text FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer")
def presentation_texts(spark, sf_dir):
    """Slides in the order of the presentation, not of their parts."""
    made = _files(spark, sf_dir, lambda no, name, segment: builders.pptx([name, segment]), "c_name", "c_mktsegment")
    rows = decode.elements(made)
    slide = F.regexp_extract("path", "^/child:([0-9]+)", 1).cast("int")
    return rows.where("element_type = 'text'").select(_key(), slide.alias("slide"), "text")


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text FROM customer")
def legacy_texts(spark, sf_dir):
    made = _files(spark, sf_dir, lambda no, name, segment: builders.legacy_text([name, segment]), "c_name", "c_mktsegment")
    return tree.text_of(decode.elements(made)).select(_key(), "text")


@query("SELECT c_custkey, 'A1' AS ref, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'B1', '0.5' FROM customer UNION ALL SELECT c_custkey, 'A2', c_custkey::VARCHAR FROM customer")
def legacy_cells(spark, sf_dir):
    return decode.cells(_files(spark, sf_dir, lambda no, name: builders.legacy_sheet(name, 0.5, no), "c_name")).select(_key(), "ref", "text")


_XML = "[{'t': 'declaration', 'n': NULL, 'x': NULL}, {'t': 'comment', 'n': NULL, 'x': ' c '}, {'t': 'element', 'n': 'r', 'x': NULL}, {'t': 'element', 'n': 'a', 'x': NULL}, {'t': 'cdata', 'n': NULL, 'x': '<' || c_name || '>'}, {'t': 'pcdata', 'n': NULL, 'x': 'y'}, {'t': 'processing_instruction', 'n': 'p', 'x': 'q'}, {'t': 'element', 'n': 'b', 'x': NULL}, {'t': 'pcdata', 'n': NULL, 'x': ' '}]"


@query(f"SELECT c_custkey, i::BIGINT AS element_id, e.t AS element_type, e.n AS name, e.x AS text FROM (SELECT c_custkey, generate_subscripts(l, 1) AS i, unnest(l) AS e FROM (SELECT c_custkey, {_XML} AS l FROM customer))")
def xml_nodes(spark, sf_dir):
    """All kinds of nodes, marked sections apart from the text beside them; the words of an entity declaration within one declare none."""
    make = lambda no, name: f'<?xml version="1.0"?><!-- c --><r><a k="1"><![CDATA[<{name}>]]>y</a><?p q?><b> </b></r>'.encode()
    rows = decode.elements(_files(spark, sf_dir, make, "c_name")).where("element_type <> 'root'")
    return rows.select(_key(), "element_id", "element_type", "name", "text")


@query("SELECT c_custkey, 'a' || c_name AS text, true AS shown FROM customer UNION ALL SELECT c_custkey, NULL, false FROM customer")
def visible_elements(spark, sf_dir):
    """Spans with text are visible, empty ones are not."""
    made = _files(spark, sf_dir, lambda no, name: builders.odf_text(f"<text:p><text:span>a{name}</text:span><text:span/></text:p>"), "c_name")
    # Four branches of the plan read the rows: they are decoded once.
    rows = scratch.written(decode.elements(made).select("file_id", "element_id", "parent_id", "element_type", "path", "text"))
    spans = rows.where("element_type = 'span'").select("file_id", "element_id")
    seen = tree.visible(rows).withColumn("seen", F.lit(True))
    words = rows.where("element_type = 'text'").select("file_id", F.col("parent_id").alias("element_id"), "text")
    return spans.join(seen, ["file_id", "element_id"], "left").join(words, ["file_id", "element_id"], "left").select(_key(), "text", F.coalesce("seen", F.lit(False)).alias("shown"))


@query("SELECT c_custkey, e AS element_type, CASE e WHEN 'link' THEN 'http://x/' || c_custkey WHEN 'text' THEN 'a   b' || chr(9) || c_name ELSE NULL END AS value FROM customer, (SELECT unnest(['text', 'line_break', 'link']) AS e)")
def inline_elements(spark, sf_dir):
    """Runs of spaces and tabs are one text; breaks and links are elements."""
    make = lambda no, name: builders.odf_text(f'<text:p>a<text:s text:c="3"/>b<text:tab/>{name}<text:line-break/><text:a xlink:href="http://x/{no}"/></text:p>')
    rows = decode.elements(_files(spark, sf_dir, make, "c_name")).where("element_type in ('text', 'line_break', 'link')")
    return rows.select(_key(), "element_type", F.coalesce("text", "href").alias("value"))


@query("SELECT c_custkey, [1, 1, 2][i] AS col_span, [2, 1, 1][i] AS row_span, i = 2 AND false AS is_covered FROM customer, (SELECT unnest([1, 2, 3]) AS i) UNION ALL SELECT c_custkey, 1, 1, true FROM customer")
def text_table_spans(spark, sf_dir):
    make = lambda no, name: builders.odf_text(
        f'<table:table><table:table-row><table:table-cell table:number-rows-spanned="2"><text:p>{name}</text:p></table:table-cell><table:table-cell/></table:table-row><table:table-row><table:covered-table-cell/><table:table-cell table:number-columns-spanned="2"/></table:table-row></table:table>'
    )
    rows = decode.elements(_files(spark, sf_dir, make, "c_name")).where("element_type = 'table_cell'")
    return rows.select(_key(), "col_span", "row_span", "is_covered")


# Delimited text


@query("SELECT c_custkey, c::BIGINT AS col_ix, [c_name, c_custkey || '|'][c + 1] AS text FROM customer, (SELECT unnest([0, 1]) AS c)")
def csv_directive(spark, sf_dir):
    """A first line that names the separator is no record, and needs no agreement."""
    made = _files(spark, sf_dir, lambda no, name: f"sep=~\r\n{name}~{no}|\n".encode(), "c_name")
    return csvdoc.csv_cells(made, typed=False).select(_key(), F.col("col_ix").cast("long").alias("col_ix"), "text")


@query("SELECT c_custkey, c_custkey % 3 = 0 AS is_csv FROM customer")
def csv_prose(spark, sf_dir):
    """Commas of prose and fields that do not agree make no table."""
    name = F.col("c_name")
    table_like = F.concat(F.lit("name,key\n"), name, F.lit(",1\nother,2\n"))
    prose = F.concat(name, F.lit(" wrote a letter, which was long and full of words\nNobody answered it, as nobody had the time for it\nSo it went, until the last of them gave it up\n"))
    ragged = F.concat(name, F.lit(",1\na,b,c\nd,e,f,g\nh,i,j,k,l\n"))
    shown = F.element_at(F.array(table_like, prose, ragged), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(csvdoc.csv_probe(shown)["is_csv"], F.lit(False)).alias("is_csv"))


@query("SELECT n_nationkey, ['txt', 'csv'] AS file_types FROM nation")
def csv_long_sample(spark, sf_dir):
    """Only the head of a long file is probed, and the record that it cuts does not count."""
    make = lambda name: f'name,note\na,b\na,b\na,b\n{name},"{"x" * 70_000}\n"\n'.encode()
    made = per_row(table(spark, sf_dir, "nation"), make, "n_name", key="n_nationkey")
    return detect.detect(made).select(F.col("file_id").cast("int").alias("n_nationkey"), "file_types")


@query("SELECT c_custkey, how, [c_name || ',x', '1'][c + 1] AS text, c::BIGINT AS col_ix FROM customer, (SELECT unnest(['quote', 'encoding']) AS how), (SELECT unnest([0, 1]) AS c)")
def csv_given_options(spark, sf_dir):
    """A quote, a separator and an encoding that are given are not detected."""
    out = None
    for how, make, options in (
        ("quote", lambda no, name: f"'{name},x';1\n".encode(), csvdoc.Options(separator=";", quote="'")),
        ("encoding", lambda no, name: f'"{name},x"|1\n'.encode("utf-16-le"), csvdoc.Options(encoding="UTF-16LE", separator="|")),
    ):
        one = csvdoc.csv_cells(_files(spark, sf_dir, make, "c_name"), options, typed=False).select(_key(), F.lit(how).alias("how"), "text", F.col("col_ix").cast("long").alias("col_ix"))
        out = one if out is None else out.unionByName(one)
    return out


# Sheets


@query("SELECT c_custkey, 'A' || (c_custkey % 7 + r) AS ref, c_name AS text FROM customer, (SELECT unnest([1, 2]) AS r) UNION ALL SELECT c_custkey, 'B' || (c_custkey % 7 + r), c_name FROM customer, (SELECT unnest([1, 2]) AS r)")
def ods_repeats(spark, sf_dir):
    """Repeated full rows and cells are written out, repeated empty ones only move on, hidden groups are left out."""
    make = lambda no, name: builders._odf(
        f'<office:spreadsheet><table:table table:name="t">{f"""<table:table-row table:number-rows-repeated="{no % 7}"><table:table-cell table:number-columns-repeated="9"/></table:table-row>""" if no % 7 else ""}'
        f'<table:table-row-group table:display="false"><table:table-row><table:table-cell><text:p>hidden</text:p></table:table-cell></table:table-row></table:table-row-group>'
        f'<table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>{name}</text:p></table:table-cell></table:table-row></table:table></office:spreadsheet>',
        "spreadsheet",
    )
    return decode.cells(_files(spark, sf_dir, make, "c_name")).select(_key(), "ref", "text")


@query("SELECT c_custkey, 'rows' AS name, (c_custkey % 5 + 1)::BIGINT AS used_rows, 2::BIGINT AS used_cols FROM customer")
def sheet_extents(spark, sf_dir):
    """Names and used extents of the sheets of both formats."""
    make = lambda no, name: (builders.xlsx if no % 2 else builders.ods)([[name, i] for i in range(no % 5 + 1)])
    return decode.sheets(_files(spark, sf_dir, make, "c_name")).select(_key(), "name", F.col("used_rows").cast("long").alias("used_rows"), F.col("used_cols").cast("long").alias("used_cols"))


@query("SELECT c_custkey, ['A1', 'B1', 'A2', 'B2'][i] AS ref, [c_custkey % 2 + 1, 1, 1, 1][i]::INTEGER AS row_span, [2, 1, 1, 1][i]::INTEGER AS col_span, i = 2 OR (i > 2 AND c_custkey % 2 = 1) AS is_covered FROM customer, (SELECT unnest([1, 2, 3, 4]) AS i)")
def xlsx_merges(spark, sf_dir):
    def make(no, name):
        import io
        import zipfile

        source = zipfile.ZipFile(io.BytesIO(builders.xlsx([[name, "b"], ["c", "d"]])))
        ref = "A1:B2" if no % 2 else "A1:B1"
        return containers.write_zip([(n, source.read(n).replace(b"</sheetData>", f'</sheetData><mergeCells><mergeCell ref="{ref}"/></mergeCells>'.encode()), 1) for n in source.namelist()])

    return decode.cells(_files(spark, sf_dir, make, "c_name")).select(_key(), "ref", "row_span", "col_span", "is_covered")


# Lists and styles

_LIST_SQL = "WITH t AS (SELECT c_custkey, unnest(generate_series(0, c_custkey % 3)) AS i FROM customer), n AS (SELECT *, CASE WHEN i = 0 OR c_custkey % 2 = 0 THEN i + 1 ELSE i + 4 END AS top FROM t)"


@query(_LIST_SQL + " SELECT c_custkey, top || '.' AS marker FROM n UNION ALL SELECT c_custkey, top || '.' || s || ')' FROM n, (SELECT unnest(['a', 'b']) AS s)")
def odt_list_markers(spark, sf_dir):
    """Levels, formats and restarts of lists; odd customers' second item starts at five."""
    made = _files(spark, sf_dir, lambda no: builders.odt_list(no % 3 + 1, 2, 5 if no % 2 else 0))
    return decode.elements(made).where("element_type = 'list_item'").select(_key(), F.col("list_marker").alias("marker"))


@query("SELECT c_custkey, ['1.', '1.a)', '1.b)', '2.', '2.a)'][i]  AS marker FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE i <= c_custkey % 5 + 1")
def docx_list_markers(spark, sf_dir):
    made = _files(spark, sf_dir, lambda no: builders.docx_list([0, 1, 1, 0, 1][: no % 5 + 1]))
    return decode.elements(made).where("element_type = 'list_item'").select(_key(), F.col("list_marker").alias("marker"))


_FORMATTED = "CASE c_custkey % 6 WHEN 0 THEN n::VARCHAR WHEN 1 THEN lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') WHEN 2 THEN chr((96 + n)::INTEGER) WHEN 3 THEN chr((64 + n)::INTEGER) WHEN 4 THEN ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'xiii', 'xiv', 'xv', 'xvi', 'xvii', 'xviii', 'xix', 'xx'][n] ELSE '' END"


@query(f"SELECT c_custkey, {_FORMATTED} AS shown, {_FORMATTED} AS by_function FROM (SELECT c_custkey, c_custkey % 20 + 1 AS n FROM customer)")
def number_formats(spark, sf_dir):
    """List numbers in every format, by expression and by the function that SQL knows."""
    registry.register(spark)
    kinds = ("decimal", "decimal_zero", "letter_lower", "letter_upper", "roman_lower", "bullet")
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 20 + 1).cast("int").alias("n"), _chosen(*kinds).alias("fmt"))
    return rows.select("c_custkey", numbering.format_number(F.col("n"), F.col("fmt")).alias("shown"), F.expr("list_number(n, fmt)").alias("by_function"))


@query("SELECT c_custkey, s AS style_name, CASE WHEN s = 'A' THEN (c_custkey % 9 + 8) || 'pt' ELSE '14pt' END AS size, '#ff0000' AS color FROM customer, (SELECT unnest(['A', 'B']) AS s)")
def odf_styles(spark, sf_dir):
    make = lambda no, name: builders.odf_text(
        "<text:p/>",
        f'<style:style style:name="A" style:family="paragraph"><style:text-properties fo:font-size="{no % 9 + 8}pt" fo:color="#ff0000"/></style:style><style:style style:name="B" style:family="paragraph" style:parent-style-name="A"><style:text-properties fo:font-size="14pt"/></style:style>',
    )
    rows = decode.styles(_files(spark, sf_dir, make, "c_name"))
    return rows.select(_key(), "style_name", F.element_at("resolved", "fo:font-size").alias("size"), F.element_at("resolved", "fo:color").alias("color"))


@query("SELECT c_custkey, 'justify' AS align, (c_custkey % 20 + 4) || 'pt' AS size, 'bold' AS weight FROM customer")
def docx_styles(spark, sf_dir):
    """Document defaults, a style and the style that is based on it."""

    def make(no, name):
        rules = f'<w:styles {builders._W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="{2 * (no % 20 + 4)}"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="A"><w:pPr><w:jc w:val="both"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
        return builders.docx_parts("<w:p/>", [("word/styles.xml", rules.encode(), 1)])

    rows = decode.styles(_files(spark, sf_dir, make, "c_name")).where("style_name = 'B'")
    get = lambda n: F.element_at("resolved", n)
    return rows.select(_key(), get("fo:text-align").alias("align"), get("font_size").alias("size"), get("font_weight").alias("weight"))


@query("SELECT c_custkey, (c_custkey % 60)::BIGINT AS root FROM customer")
def long_style_chains(spark, sf_dir):
    """Chains of any length reach their root's field."""
    c = table(spark, sf_dir, "customer")
    rows = c.select((F.col("c_custkey") % 60).alias("file_id"), F.col("c_custkey").cast("string").alias("style_name"), F.when(F.col("c_custkey") >= 60, (F.col("c_custkey") - 60).cast("string")).alias("parent_name"), F.when(F.col("c_custkey") < 60, F.col("c_custkey").cast("long")).alias("root"))
    rows = rows.withColumn("root", F.when(F.col("style_name") == "60", 0).otherwise(F.col("root"))).withColumn("parent_name", F.when(F.col("style_name") != "60", F.col("parent_name")))
    return styles.resolve(rows, ["root"]).select(F.col("style_name").cast("long").alias("c_custkey"), "root")


@query(
    "SELECT p_partkey, p_size * 0.5::DOUBLE AS half_points, p_size / 1440.0::DOUBLE AS twips, p_size / 50.0::DOUBLE AS share, p_size % 2 = 1 AS toggled, CASE p_size % 3 WHEN 0 THEN '#000080' WHEN 1 THEN '#aabbcc' END AS color, "
    "'#' || lower(lpad(to_hex(p_size % 256), 2, '0')) || '00ff' AS hex, regexp_replace((p_size / 8.0::DOUBLE)::VARCHAR, '\\.0$', '') AS printed FROM part"
)
def office_units(spark, sf_dir):
    size = F.col("p_size")
    shown = size.cast("string")
    color = F.when(size % 3 == 0, "darkBlue").when(size % 3 == 1, "AABBCC").otherwise("auto")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.office_measure(shown, "half_point")["magnitude"].alias("half_points"), text.office_width(shown, F.lit("dxa"))["magnitude"].alias("twips"), text.office_width(shown, F.lit("pct"))["magnitude"].alias("share"),
        text.on_off(F.when(size % 2 == 1, F.lit(None).cast("string")).otherwise("off")).alias("toggled"), text.office_color(color).alias("color"), text.color_hex((size % 256).cast("int"), F.lit(0), F.lit(255)).alias("hex"), text.print_number(size / F.lit(8.0)).alias("printed"),
    )


@query("SELECT p_partkey, [2.0 * p_size, 0, 0, 2.0 * p_size, 2.0 * p_size, 6]::DOUBLE[] AS cells FROM part")
def affine_products(spark, sf_dir):
    m = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) if not hasattr(x, "cast") else x.cast("double").alias(n) for x, n in zip(v, "abcdef")])
    size = F.col("p_size")
    made = text.affine(m(size, 0, 0, size, size, 3), m(2, 0, 0, 2, 0, 0))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("m")).select("p_partkey", F.array(*[F.col(f"m.{n}") for n in "abcdef"]).alias("cells"))


# Pages and fonts


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment AS title, 'é' || c_custkey AS author, 1 AS pages FROM customer")
def pdf_metadata(spark, sf_dir):
    make = lambda no, name, segment: builders.pdf_page(b"", extra=[b"<< /Title (%s of %s) /Author <FEFF%s> >>" % (name.encode(), segment.encode(), f"é{no}".encode("utf-16-be").hex().encode())], trailer=b"/Info 6 0 R")
    return decode.meta(_files(spark, sf_dir, make, "c_name", "c_mktsegment")).select(_key(), "title", "author", F.col("entry_count").alias("pages"))


@query("SELECT c_custkey, c_name AS text FROM customer")
def pdf_recovered(spark, sf_dir):
    """Files whose tables are broken are read by scanning for objects."""
    make = lambda no, name: builders.pdf_page(b"BT /F1 10 Tf 40 700 Td (%s) Tj ET" % name.encode()).replace(b"startxref\n", b"startxref\n9").replace(b"xref\n0 ", b"xrex\n0 ")
    return decode.pdf_pages(_files(spark, sf_dir, make, "c_name")).select(_key(), "text")


@query("SELECT c_custkey, c_mktsegment || ' ' || c_name AS text FROM customer")
def pdf_replacement_text(spark, sf_dir):
    """Marked content with a replacement reads as that."""
    make = lambda no, name, segment: builders.pdf_page(b"BT /F1 10 Tf 40 700 Td /Span << /ActualText (%s) >> BDC (xx) Tj EMC 40 0 Td (%s) Tj ET" % (segment.encode(), name.encode()))
    return decode.pdf_pages(_files(spark, sf_dir, make, "c_name", "c_mktsegment")).select(_key(), "text")


@query("SELECT c_custkey, 'uri' AS kind, 'https://x/' || c_custkey AS target FROM customer UNION ALL SELECT c_custkey, 'named', c_name FROM customer")
def pdf_link_targets(spark, sf_dir):
    make = lambda no, name: builders.pdf_page(
        b"", b"/Annots [6 0 R 7 0 R 8 0 R]", [b"<< /Subtype /Link /A << /S /URI /URI (https://x/%d) >> >>" % no, b"<< /Subtype /Link /Dest (%s) >>" % name.encode(), b"<< /Subtype /Link /A << /S /URI /URI (javascript:x) >> >>"]
    )
    return decode.pdf_links(_files(spark, sf_dir, make, "c_name")).select(_key(), "kind", "target")


@query("SELECT c_custkey, c_name AS text, 40.0::DOUBLE AS x, (700 - c_custkey % 50)::DOUBLE AS y, 10.0::DOUBLE AS size, 40 + 5.0::DOUBLE * length(c_name) AS end_x FROM customer")
def pdf_geometry(spark, sf_dir):
    """Origins, sizes and advances of text, moved by a form that another form paints."""

    def make(no, name):
        inner = b"BT /F1 10 Tf 0 0 Td (%s) Tj ET" % name.encode()
        form = lambda body, matrix, more: b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 %s] /Resources << /Font << /F1 4 0 R >> %s >> /Length %d >>\nstream\n" % (matrix, more, len(body)) + body + b"\nendstream"
        page = builders.pdf_page(b"/X Do", extra=[form(b"/Y Do", b"40 700", b"/XObject << /Y 7 0 R >>"), form(inner, b"0 -%d" % (no % 50), b"")])
        return page.replace(b"<< /Font << /F1 4 0 R >> >>", b"<< /Font << /F1 4 0 R >> /XObject << /X 6 0 R >> >>", 1).replace(b"startxref", b"startxrex")

    return decode.pdf_segments(_files(spark, sf_dir, make, "c_name")).select(_key(), "text", "x", "y", "size", "end_x")


_CJK = (("UniGB-UCS2-H", "utf-16-be"), ("GBK-EUC-H", "gbk"), ("90ms-RKSJ-H", "cp932"), ("KSCms-UHC-H", "cp949"), ("ETen-B5-V", "cp950"), ("UniJIS-UTF16-H", "utf-16-be"))


def _composite(no, name):
    """A page whose font has a predefined encoding, an embedded one of two-byte ids, or an embedded program that names its glyphs."""
    kind = no % 8
    text_page = lambda raw, font, extra=(): builders.pdf_page(b"BT /F2 10 Tf 40 700 Td <%s> Tj ET" % raw.hex().encode(), extra=[font, *extra]).replace(b"/Font << /F1 4 0 R >>", b"/Font << /F2 6 0 R >>", 1).replace(b"startxref", b"startxrex")
    stream = lambda body: b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"
    if kind < 6:
        encoding, codec = _CJK[kind]
        return text_page(f"日本 {name}".encode(codec), b"<< /Type /Font /Subtype /Type0 /Encoding /%s /DescendantFonts [<< /DW 1000 >>] >>" % encoding.encode())
    if kind == 6:
        codes = b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 1 begincidrange <8000> <8FFF> 100 endcidrange"
        names = b"1 begincodespacerange <00> <7F> endcodespacerange 2 beginbfrange <00> <7F> <0000> <8000> <8FFF> <6000> endbfrange 2 beginbfchar <8001> <65E5> <8002> <672C> endbfchar"
        return text_page(b"\x80\x01\x80\x02 " + name.encode(), b"<< /Type /Font /Subtype /Type0 /Encoding 7 0 R /ToUnicode 8 0 R /DescendantFonts [<< /DW 500 >>] >>", [stream(codes), stream(names)])
    return text_page(b"\0\1\0\2", b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 500 /FontDescriptor << /FontFile2 7 0 R >> >>] >>", [stream(builders.sfnt())])


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 = 7 THEN 'AB' ELSE '日本 ' || c_name END AS text FROM customer")
def pdf_composite_fonts(spark, sf_dir):
    """Text of composite fonts by predefined encodings, by embedded ones and by what an embedded font names."""
    return decode.pdf_pages(_files(spark, sf_dir, _composite, "c_name")).select(_key(), "text")


@query("SELECT n_nationkey, g AS glyph, [500, 600, 600][g + 1] AS width, [NULL, 65, 66][g + 1] AS code_point FROM nation, (SELECT unnest([0, 1, 2]) AS g)")
def font_glyphs(spark, sf_dir):
    made = per_row(table(spark, sf_dir, "nation"), lambda name: builders.sfnt(), "n_name", key="n_nationkey")
    return fonts.glyphs(made).select(F.col("file_id").cast("int").alias("n_nationkey"), F.col("glyph").cast("int").alias("glyph"), F.col("width").cast("int").alias("width"), F.col("code_point").cast("int").alias("code_point"))


@query("SELECT n_nationkey, 'Ab' AS name, 2048 AS units_per_em, 800 AS ascender, 3 AS n_glyphs FROM nation")
def font_facts(spark, sf_dir):
    made = per_row(table(spark, sf_dir, "nation"), lambda name: builders.sfnt(), "n_name", key="n_nationkey")
    of = lambda c: F.col(c).cast("int").alias(c)
    return fonts.fonts(made).select(F.col("file_id").cast("int").alias("n_nationkey"), "name", of("units_per_em"), of("ascender"), of("n_glyphs"))


# Views, edits, facts


@query("SELECT c_custkey, v AS view_ix, ['document', 'rows'][v + 1] AS name, ['document.html', 'sheet0.html'][v + 1] AS path, true AS has_name, v = 1 AS has_cell FROM customer, (SELECT unnest([0, 1]) AS v)")
def views_of_sheets(spark, sf_dir):
    """The whole document and each of its sheets; the name is escaped."""
    made = _files(spark, sf_dir, lambda no, name: builders.xlsx([[f"<{name}>", no]]), "c_name")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("file_id"), "c_name")
    views = html.html_views(made).join(names, "file_id")
    return views.select(_key(), "view_ix", "name", "path", F.contains("html", F.concat(F.lit("&lt;"), "c_name", F.lit("&gt;"))).alias("has_name"), ((F.col("view_ix") == 1) & F.contains("html", F.lit("value-type-float"))).alias("has_cell"))


@query("SELECT c_custkey, unnest([1, 2]) AS line, unnest([replace(c_name, '#', '&lt;'), '&nbsp;b &nbsp;' || c_custkey]) AS shown FROM customer")
def views_of_text(spark, sf_dir):
    """Lines of plain text in their view."""
    made = _files(spark, sf_dir, lambda no, name: f"{name.replace('#', '<')}\n b  {no}".encode(), "c_name")
    found = F.regexp_extract_all("html", F.lit('<div class="line" data-line="[0-9]+">([^\\n]*?)</div>'), F.lit(1))
    return html.html_views(made).select(_key(), F.posexplode(found).alias("at", "shown")).select("c_custkey", (F.col("at") + 1).alias("line"), "shown")


@query("""SELECT c_custkey, '{"fileType":"' || t || '","fileCategory":"' || c || '","isEncrypted":false' || CASE WHEN t = 'ods' THEN ',"document":{"documentType":"spreadsheet","entryCount":1}' WHEN t = 'odt' THEN ',"document":{"documentType":"text"}' ELSE '' END || '}' AS json FROM (SELECT c_custkey, ['png', 'ods', 'odt'][c_custkey % 3 + 1] AS t, ['image', 'document', 'document'][c_custkey % 3 + 1] AS c FROM customer)""")
def facts_as_json(spark, sf_dir):
    make = lambda no, name: (b"\x89PNG\r\n\x1a\n" if no % 3 == 0 else builders.ods([[name]]) if no % 3 == 1 else builders.odt(name))
    return decode.meta_json(decode.meta(_files(spark, sf_dir, make, "c_name"))).select(_key(), "json")


@query("SELECT c_custkey, 'new  ' || c_name || chr(9) || 'end' || chr(10) || 'kept' AS text FROM customer")
def edited_and_saved(spark, sf_dir):
    """A text element of each document changed by a diff, the document saved and read again; both formats."""
    c = table(spark, sf_dir, "customer")
    made = _files(spark, sf_dir, lambda no, name: builders.odt(f"{name}\nkept") if no % 2 else builders.docx(f"{name}\nkept"), "c_name")
    path = F.when(F.col("c_custkey") % 2 == 1, "/child:0/child:0").otherwise("/child:0/child:0/child:0")
    changes = c.select(F.col("c_custkey").cast("long").alias("file_id"), path.alias("path"), F.concat(F.lit("new  "), "c_name", F.lit("\tend")).alias("new_text"))
    saved = edit.save_documents(made, edit.generate_diff(changes))
    return tree.text_of(decode.elements(saved.select("file_id", "content"))).select(_key(), "text")


@query("SELECT c_custkey, 'xlsx cannot be saved' AS problem FROM customer")
def saves_refused(spark, sf_dir):
    made = _files(spark, sf_dir, lambda no, name: builders.xlsx([[name]]), "c_name")
    changes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("file_id"), F.lit("/child:0").alias("path"), F.lit("x").alias("new_text"))
    return edit.save_documents(made, edit.generate_diff(changes)).select(_key(), F.regexp_extract("error", "([a-z]+ cannot be saved)", 1).alias("problem"))


@query("SELECT c_custkey, 'data:image/png;base64,' || base64(encode('png of ' || c_name)) AS href, 'Pictures/a.png' AS path FROM customer")
def located_resources(spark, sf_dir):
    """Images of a document as resources of its view, embedded."""
    make = lambda no, name: builders.odf_text("<text:p/>", "", [("Pictures/a.png", f"png of {name}".encode(), None)])
    return html.locate(html.html_resources(containers.entries(_files(spark, sf_dir, make, "c_name")))).select(_key(), "href", "path")


@query("SELECT n_nationkey, true AS drawn, 'n' || n_nationkey || '</text>' AS label FROM nation")
def metafile_drawings(spark, sf_dir):
    """A rectangle and a text of a metafile, drawn in its view."""
    import struct

    box = lambda body: struct.pack("<HI", 1, len(body)) + body
    action = lambda kind, body: struct.pack("<H", kind) + box(body)

    def make(no):
        said = f"n{no}".encode()
        head = box(struct.pack("<I", 0) + box(b"\0" * 4) + struct.pack("<ii", 100, 50) + struct.pack("<I", 3))
        words = struct.pack("<ii", 5, 6) + struct.pack("<H", len(said)) + said + struct.pack("<HH", 0, len(said))
        return b"VCLMTF" + head + action(133, struct.pack("<I?", 0xFF0000, True)) + action(103, struct.pack("<iiii", 1, 2, 11, 22)) + action(112, words)

    rows = table(spark, sf_dir, "nation").withColumn("no", F.col("n_nationkey").cast("long"))
    views = html.html_views(per_row(rows, make, "no", key="n_nationkey"))
    return views.select(F.col("file_id").cast("int").alias("n_nationkey"), F.contains("html", F.lit('<rect x="1" y="2" width="10" height="20"')).alias("drawn"), F.regexp_extract("html", "(n[0-9]+</text>)", 1).alias("label"))


# Relational operations


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def ordering_semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_nationkey, count(*)::BIGINT AS poorer FROM nation JOIN supplier ON s_acctbal < n_nationkey * 100 - 1000 GROUP BY n_nationkey")
def balances_theta_join(spark, sf_dir):
    """An inequality join against the 25 nations, whose number is fixed."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey"))
    joined = table(spark, sf_dir, "supplier").join(nations, F.col("s_acctbal") < F.col("n_nationkey") * 100 - 1000)
    return joined.groupBy("n_nationkey").agg(F.count("*").alias("poorer"))


@query("SELECT 'both' AS side, k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def nations_set_operations(spark, sf_dir):
    some = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    both = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).intersect(some)
    only = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(some)
    return both.select(F.lit("both").alias("side"), "k").unionByName(only.select(F.lit("only").alias("side"), "k"))


@query("SELECT o_orderpriority, true AS near FROM orders GROUP BY o_orderpriority")
def customers_approximately(spark, sf_dir):
    """A sketch's count of distinct customers within five percent of the exact one."""
    # Beside a distinct count Spark would keep a sketch for each customer; distinct rows leave the same sketch.
    pairs = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey").distinct()
    counts = pairs.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.01).alias("about"), F.count("o_custkey").alias("n"))
    return counts.select("o_orderpriority", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near"))


@query("SELECT c_custkey, r AS record, f AS field, CASE WHEN r = 0 THEN ['name', 'key'][f + 1] ELSE [c_name || ';x', c_custkey::VARCHAR][f + 1] END AS text FROM customer, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS f)")
def csv_table_function(spark, sf_dir):
    """Records of a column of texts by the table function that SQL knows."""
    registry.register(spark)
    table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('name;key\n"'), "c_name", F.lit(';x";'), F.col("c_custkey").cast("string")).alias("body")).createOrReplaceTempView("paperloom_bodies")
    return spark.sql("SELECT c_custkey, r.record, r.field, r.text FROM paperloom_bodies, LATERAL csv_records(body, ';') r")


@query("SELECT p_partkey, p_size + sqrt(p_size::DOUBLE) AS grown, (p_size * 7) % 13 AS rest, round(ln(p_size::DOUBLE + 1), 9) AS log FROM part")
def part_numbers(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (size + F.sqrt(size)).alias("grown"), (size * 7 % 13).alias("rest"), F.round(F.ln(size.cast("double") + 1), 9).alias("log"))


# Streams


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last FROM events GROUP BY ALL")
def events_by_day_stream(spark, sf_dir):
    """Events read as a stream, aggregated by day and type with a watermark."""
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    # Days begin where the session says; windows of epoch hours are summed to them.
    found = windows.windowed(arriving.withColumn("ts", F.col("day").cast("timestamp")), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.max("event_id").cast("long").alias("last")], late="400 days")
    done = windows.run_to_table(found, scratch.scratch_dir(spark))
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "last")


@query("SELECT c_custkey, c_name AS text, (['#ff0000', '#808080', '#00ffff', '#0000ff', '#000000'])[c_custkey % 5 + 1] AS color FROM customer")
def pdf_colours(spark, sf_dir):
    """Colour of text in device, indexed and default spaces."""
    paint = (b"1 0 0 rg", b"0.5 g", b"1 0 0 0 k", b"/C0 cs 1 sc", b"")
    space = b"/ColorSpace << /C0 [/Indexed /DeviceRGB 1 <0000000000FF>] >> >>"
    make = lambda no, name: builders.pdf_page(paint[no % 5] + b" BT /F1 10 Tf 40 700 Td (%s) Tj ET" % name.encode()).replace(b"/Font << /F1 4 0 R >> >>", b"/Font << /F1 4 0 R >> " + space, 1).replace(b"startxref", b"startxrex")
    return decode.pdf_segments(_files(spark, sf_dir, make, "c_name")).select(_key(), "text", "color")


@query("SELECT n_nationkey, 'Secret title' AS title, false AS is_encrypted FROM nation")
def pdf_decrypted(spark, sf_dir):
    """Facts of files that open without a password, of all revisions of the standard handler."""
    kinds = ((3, b"V2"), (4, b"V2"), (4, b"AESV2"), (6, b"AESV3"))
    rows = table(spark, sf_dir, "nation").withColumn("no", F.col("n_nationkey").cast("long"))
    facts = decode.meta(per_row(rows, lambda no: builders.sealed(*kinds[no % 4]), "no", key="n_nationkey"))
    return facts.select(F.col("file_id").cast("int").alias("n_nationkey"), "title", "is_encrypted")


@query("SELECT c_custkey, 'I' AS name, 2 AS width, 3 AS height, 'image/jpeg' AS mimetype, md5('jpeg of ' || c_name) AS body FROM customer")
def pdf_image_objects(spark, sf_dir):
    def make(no, name):
        body = f"jpeg of {name}".encode()
        image = b"<< /Subtype /Image /Width 2 /Height 3 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"
        return builders.pdf_page(b"", extra=[image]).replace(b"/Font << /F1 4 0 R >> >>", b"/XObject << /I 6 0 R >> >>", 1).replace(b"startxref", b"startxrex")

    return decode.pdf_images(_files(spark, sf_dir, make, "c_name")).select(_key(), "name", "width", "height", "mimetype", F.md5("content").alias("body"))


@query("SELECT n_nationkey, f AS format, CASE f WHEN 'cff' THEN 'Mini' ELSE 'Tiny' END AS name, CASE f WHEN 'cff' THEN 2 ELSE 1 END AS n_glyphs FROM nation, (SELECT unnest(['cff', 'type1']) AS f)")
def font_programs(spark, sf_dir):
    out = None
    for make in (builders.cff, builders.type1):
        made = per_row(table(spark, sf_dir, "nation"), lambda name, make=make: make(), "n_name", key="n_nationkey")
        one = fonts.fonts(made).select(F.col("file_id").cast("int").alias("n_nationkey"), "format", "name", F.col("n_glyphs").cast("int").alias("n_glyphs"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "WITH d AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents), n AS (SELECT doc_id, t, strpos(substr(t, 51), 'the') AS later, strpos(t, 'the') AS first, strpos(reverse(substr(t, 1, 51)), 'eht') AS back, strpos(reverse(t), 'eht') AS last FROM d) "
    "SELECT doc_id, (CASE WHEN later > 0 THEN later + 50 ELSE first END)::BIGINT AS next, (CASE WHEN length(t) >= 51 AND back > 0 THEN 51 - back - 1 WHEN length(t) < 51 AND strpos(reverse(t), 'eht') > 0 THEN length(t) - last - 1 WHEN last > 0 THEN length(t) - last - 1 ELSE 0 END)::BIGINT AS previous FROM n"
)
def search_steps(spark, sf_dir):
    """The hits next to place 50, forwards and backwards, around the ends of a text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.next_hit(F.col("text"), "the", F.lit(50)).alias("next"), text.previous_hit(F.col("text"), "the", F.lit(50)).alias("previous"))


@query("SELECT c_custkey, true AS editable, 'font-size:' || (c_custkey % 9 + 8) || 'pt;color:#ff0000' AS style FROM customer")
def views_styled(spark, sf_dir):
    """Resolved styles as inline CSS, and texts that name their path in an editable view."""
    make = lambda no, name: builders.odf_text(
        f'<text:p text:style-name="A">{name}</text:p>', f'<style:style style:name="A" style:family="paragraph"><style:text-properties fo:font-size="{no % 9 + 8}pt" fo:color="#ff0000"/></style:style>'
    )
    views = html.html_views(_files(spark, sf_dir, make, "c_name"), html.HtmlConfig(editable=True))
    return views.select(_key(), F.contains("html", F.lit('data-path="/child:0/child:0" contenteditable="true"')).alias("editable"), F.regexp_extract("html", '<x-p style="([^"]*)"', 1).alias("style"))
