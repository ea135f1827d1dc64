"""Dimension tables: file types and text encodings, with their lookups."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Name | extensions | media types, canonical first | category | document type | capabilities.
#: Capabilities: D detect by content, O open, X decrypt, H html, C colour scheme, E edit, S save, N encrypt.
_FILE_TYPES = """
unknown||||unknown||
odt|odt fodt ott odm otm|application/vnd.oasis.opendocument.text application/x-vnd.oasis.opendocument.text application/vnd.oasis.opendocument.text-template application/vnd.oasis.opendocument.text-master application/vnd.oasis.opendocument.text-master-template application/vnd.oasis.opendocument.text-flat-xml|document|text|DOXHCES
odp|odp fodp otp|application/vnd.oasis.opendocument.presentation application/x-vnd.oasis.opendocument.presentation application/vnd.oasis.opendocument.presentation-template application/vnd.oasis.opendocument.presentation-flat-xml|document|presentation|DOXHCES
ods|ods fods ots|application/vnd.oasis.opendocument.spreadsheet application/x-vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.spreadsheet-template application/vnd.oasis.opendocument.spreadsheet-flat-xml|document|spreadsheet|DOXHCS
odg|odg fodg otg|application/vnd.oasis.opendocument.graphics application/x-vnd.oasis.opendocument.graphics application/vnd.oasis.opendocument.graphics-template application/vnd.oasis.opendocument.graphics-flat-xml|document|drawing|DOXHCES
docx|docx docm dotx dotm|application/vnd.openxmlformats-officedocument.wordprocessingml.document application/vnd.openxmlformats-officedocument.wordprocessingml.template application/vnd.ms-word.document.macroEnabled.12 application/vnd.ms-word.template.macroEnabled.12|document|text|DOXHCES
pptx|pptx pptm potx potm ppsx ppsm|application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.openxmlformats-officedocument.presentationml.slideshow application/vnd.openxmlformats-officedocument.presentationml.template application/vnd.ms-powerpoint.presentation.macroEnabled.12 application/vnd.ms-powerpoint.slideshow.macroEnabled.12 application/vnd.ms-powerpoint.template.macroEnabled.12|document|presentation|DOXHC
xlsx|xlsx xlsm xltx xltm|application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.spreadsheetml.template application/vnd.ms-excel.sheet.macroEnabled.12 application/vnd.ms-excel.template.macroEnabled.12|document|spreadsheet|DOXHC
ooxml_encrypted||application/vnd.ms-office|document||DOX
xlsb|xlsb|application/vnd.ms-excel.sheet.binary.macroEnabled.12|document|spreadsheet|
doc|doc dot|application/msword application/vnd.ms-word|document|text|DOHC
ppt|ppt pot pps|application/vnd.ms-powerpoint application/mspowerpoint|document|presentation|DOHC
xls|xls xlt xlm|application/vnd.ms-excel application/msexcel|document|spreadsheet|DOHC
wpd|wpd|application/vnd.wordperfect application/wordperfect application/x-wordperfect|document||D
rtf|rtf|application/rtf text/rtf application/x-rtf|document||D
pdf|pdf|application/pdf application/x-pdf|document|text|DOXH
txt|txt text|text/plain|text||DOHC
csv|csv|text/csv application/csv text/comma-separated-values|text|spreadsheet|DOHC
json|json|application/json text/json|text||DOHC
md|md markdown|text/markdown text/x-markdown|text||
zip|zip|application/zip application/x-zip-compressed multipart/x-zip|archive||DOHC
cfb|cfb|application/x-cfb application/x-ole-storage|archive||DOHC
png|png|image/png|image||DOHC
gif|gif|image/gif|image||DOHC
jpg|jpg jpeg jpe jif jfif jfi|image/jpeg image/jpg|image||DOHC
bmp|bmp dib|image/bmp image/x-ms-bmp image/x-bmp|image||DOHC
svm|svm|application/x-starview-metafile|image||DOHC
ttf|ttf ttc|font/ttf application/x-font-ttf application/x-font-truetype font/collection|font||DOHC
otf|otf|font/otf application/x-font-otf application/x-font-opentype application/vnd.ms-opentype|font||DOHC
webp|webp|image/webp|image||DOHC
tiff|tif tiff|image/tiff image/x-tiff|image||DOHC
heif|heic heif hif|image/heic image/heif image/heic-sequence image/heif-sequence|image||DOHC
avif|avif avifs|image/avif image/avif-sequence|image||DOHC
mp3|mp3|audio/mpeg audio/mp3 audio/x-mpeg|audio||DOH
m4a|m4a m4b|audio/mp4 audio/x-m4a audio/m4a|audio||DOH
ogg|ogg oga opus|audio/ogg application/ogg audio/opus|audio||DOH
wav|wav wave|audio/wav audio/x-wav audio/wave audio/vnd.wave|audio||DOH
flac|flac|audio/flac audio/x-flac|audio||DOH
mp4|mp4 m4v|video/mp4 video/x-m4v|video||DOH
mov|mov qt|video/quicktime|video||DOH
3gp|3gp 3g2|video/3gpp video/3gpp2 audio/3gpp|video||DOH
mkv|mkv webm mka|video/x-matroska video/webm audio/x-matroska audio/webm|video||DOH
avi|avi|video/x-msvideo video/avi video/msvideo|video||DOH
svg|svg|image/svg+xml|image||DOHC
ico|ico cur|image/vnd.microsoft.icon image/x-icon|image||DOHC
jxl|jxl|image/jxl|image||DOHC
jp2|jp2 jpx jpf j2k jpc j2c|image/jp2 image/jpx|image||DOHC
psd|psd psb|image/vnd.adobe.photoshop application/x-photoshop|image||DOHC
wmf|wmf|image/wmf image/x-wmf application/x-msmetafile|image||DOHC
emf|emf|image/emf image/x-emf|image||DOHC
xml|xml|application/xml text/xml|text||DOHC
"""

#: Name | aliases. Those after the dash are named but not decoded.
_ENCODINGS = """
UTF-8|ASCII|US-ASCII
UTF-16LE|UTF-16
UTF-16BE
UTF-32LE|UTF-32
UTF-32BE
IBM866|cp866|866
ISO-8859-1|latin1|l1|iso-ir-100|cp819
ISO-8859-2|latin2|l2
ISO-8859-3|latin3|l3
ISO-8859-4|latin4|l4
ISO-8859-5|cyrillic
ISO-8859-6|arabic
ISO-8859-7|greek
ISO-8859-8|hebrew
ISO-8859-10|latin6|l6
ISO-8859-13
ISO-8859-14|latin8|l8
ISO-8859-15|latin9|l9
ISO-8859-16|latin10|l10
KOI8-R|cskoi8r
KOI8-U
macintosh|mac|x-mac-roman|macroman
windows-874|cp874|TIS-620|ISO-8859-11
windows-1250|cp1250|x-cp1250
windows-1251|cp1251|x-cp1251
windows-1252|cp1252|x-cp1252|ansi
windows-1253|cp1253
windows-1254|cp1254
windows-1255|cp1255
windows-1256|cp1256
windows-1257|cp1257
windows-1258|cp1258
x-mac-cyrillic|mac-cyrillic
-
Big5|csbig5|big5-hkscs|cn-big5
EUC-JP|cseucpkdfmtjapanese
EUC-KR|windows-949|cp949|ks_c_5601-1987
gb18030|GBK|GB2312|csgb2312|x-gbk
ISO-2022-JP|csiso2022jp
ISO-2022-KR|csiso2022kr
Shift_JIS|sjis|windows-31j|cp932|ms_kanji
"""

CAPABILITIES = {"D": "detect_by_content", "O": "open", "X": "decrypt", "H": "translate_html", "C": "color_scheme", "E": "edit", "S": "save", "N": "encrypt"}

FILE_TYPES_SCHEMA = "name string, extensions array<string>, mimetypes array<string>, mimetype string, category string, document_type string, capabilities struct<" + ",".join(f"{c}:boolean" for c in CAPABILITIES.values()) + ">"


@lru_cache(maxsize=1)
def file_type_rows() -> dict[str, dict]:
    """File types by name."""
    out = {}
    for line in _FILE_TYPES.strip().splitlines():
        fields = line.split("|")
        if line.startswith("unknown"):
            fields = ["unknown", "", "", "unknown", "", ""]
        name, extensions, mimes, category, kind, caps = fields
        out[name] = {
            "name": name,
            "extensions": extensions.split(),
            "mimetypes": mimes.split(),
            "mimetype": (mimes.split() or [None])[0],
            "category": category,
            "document_type": kind or None,
            "capabilities": {long: short in caps for short, long in CAPABILITIES.items()},
        }
    return out


@lru_cache(maxsize=1)
def by_extension() -> dict[str, str]:
    return {e: r["name"] for r in file_type_rows().values() for e in r["extensions"]}


@lru_cache(maxsize=1)
def by_mimetype() -> dict[str, str]:
    return {m.lower(): r["name"] for r in file_type_rows().values() for m in r["mimetypes"]}


def type_by_extension(extension: str) -> str:
    return by_extension().get(extension.lower().lstrip("."), "unknown")


def type_by_mimetype(mimetype: str) -> str:
    return by_mimetype().get(mimetype.lower(), "unknown")


@lru_cache(maxsize=256)
def normal_label(name: str) -> str:
    """Case, '-', '_' and spaces carry no meaning in an encoding's name."""
    return name.lower().translate({ord(c): None for c in "-_ "})


@lru_cache(maxsize=1)
def encoding_rows() -> list[dict]:
    named, only_named = _ENCODINGS.strip().split("\n-\n")
    return [{"name": names[0], "names": names, "decodable": decodable} for block, decodable in ((named, True), (only_named, False)) for names in (line.split("|") for line in block.splitlines())]


@lru_cache(maxsize=1)
def _labels() -> dict[str, dict]:
    return {normal_label(n): row for row in encoding_rows() for n in row["names"]}


def encoding_by_name(name: str | None) -> str | None:
    row = _labels().get(normal_label(name)) if name else None
    return row["name"] if row else None


def is_decodable(name: str | None) -> bool:
    row = _labels().get(normal_label(name)) if name else None
    return bool(row and row["decodable"])


def file_types(spark: SparkSession) -> DataFrame:
    """The file type dimension (51 rows)."""
    rows = [(r["name"], r["extensions"], r["mimetypes"], r["mimetype"], r["category"], r["document_type"], tuple(r["capabilities"].values())) for r in file_type_rows().values()]
    return spark.createDataFrame(rows, FILE_TYPES_SCHEMA)


def encodings(spark: SparkSession) -> DataFrame:
    """The encoding dimension (40 rows): name, names, labels (normalised names), decodable."""
    rows = [(r["name"], r["names"], [normal_label(n) for n in r["names"]], r["decodable"]) for r in encoding_rows()]
    return spark.createDataFrame(rows, "name string, names array<string>, labels array<string>, decodable boolean")
