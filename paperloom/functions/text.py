"""Text and markup expressions; all native, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spaces that the search folds to one space, and accented letters whose accent it drops.
_SPACES = "              　"


def _accent_pairs() -> tuple[str, str]:
    """Letters below U+2000 that lose combining marks U+0300..U+036F, and what is left; one character each."""
    import unicodedata

    given, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not "̀" <= c <= "ͯ")
        if base != chr(code) and len(base) == 1:
            given.append(chr(code))
            plain.append(base)
    return "".join(given), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()
_MARKS = "".join(chr(c) for c in range(0x300, 0x370))


def fold(text: Column) -> Column:
    """Search folding: accents dropped, special spaces plain, lower case. Marks alone vanish; sharp s stays."""
    folded = F.translate(text, _ACCENTED + _SPACES + _MARKS, _PLAIN + " " * len(_SPACES))
    return F.lower(folded)


def count_hits(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a folded needle in folded text, left to right; none for an empty needle."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    t, n = fold(text), fold(needle)
    hits = (F.char_length(t) - F.char_length(F.replace(t, n, F.lit("")))) / F.char_length(n)
    return F.when(F.char_length(n) == 0, F.lit(0)).otherwise(hits).cast("long")


def count_folded(folded: Column, needle: str) -> Column:
    """As `count_hits`, in text that is folded already, of a needle that is."""
    if not needle:
        return F.lit(0).cast("long")
    return ((F.char_length(folded) - F.char_length(F.replace(folded, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def next_hit(text: Column, needle: str, at: Column) -> Column:
    """Place (from 1) of the first hit after place `at`; after the last one the first one again; 0 if there is none."""
    t, n = fold(text), fold(F.lit(needle))
    later = F.position(n, t, at + 1)
    return F.when(F.char_length(n) == 0, 0).when(later > 0, later).otherwise(F.position(n, t, F.lit(1))).cast("long")


def previous_hit(text: Column, needle: str, at: Column) -> Column:
    """Place (from 1) of the last hit before place `at`; before the first one the last one again; 0 if there is none."""
    t, n = fold(text), fold(F.lit(needle))
    size, length = F.char_length(n), F.char_length(t)
    # In the text read backwards, the hit that starts at p begins at length - p - size + 2.
    back = F.position(F.reverse(n), F.reverse(t), F.greatest(F.lit(1), length - at - size + 3))
    last = F.position(F.reverse(n), F.reverse(t), F.lit(1))
    place = lambda p: length - p - size + 2
    return F.when(size == 0, 0).when((back > 0) & (at > 1), place(back)).when(last > 0, place(last)).otherwise(0).cast("long")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, line_no from 1; a final newline yields a last empty line."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "line")).withColumn("line_no", (F.col("_pos") + 1).cast("long")).drop("_pos")


def escape_text(text: Column) -> Column:
    """Markup escaping of text: & < >, outer spaces, double spaces and tabs become entities."""
    t = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(raw), F.lit(entity))
    t = F.when(t.startswith(" "), F.concat(F.lit("&nbsp;"), F.substring(t, 2, 2147483647))).otherwise(t)
    t = F.when(t.endswith(" "), F.concat(F.expr("''"), F.left(t, F.char_length(t) - 1), F.lit("&nbsp;"))).otherwise(t)
    return F.replace(F.replace(t, F.lit("  "), F.lit(" &nbsp;")), F.lit("\t"), F.lit("&emsp;"))


def escape_attribute(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def data_url(content: Column, mimetype: Column | str) -> Column:
    mimetype = F.lit(mimetype) if isinstance(mimetype, str) else mimetype
    return F.concat(F.lit("data:"), mimetype, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def color_hex(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02x%02x%02x", red, green, blue)


#: CSS pixels of one unit.
PIXELS = {"px": 1.0, "in": 96.0, "pt": 96.0 / 72.0, "pc": 16.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4}


def to_pixels(magnitude: Column, unit: Column) -> Column:
    """CSS pixels; null for other units and for what is not positive."""
    out = F.lit(None).cast("double")
    for name, factor in PIXELS.items():
        out = F.when(unit == name, magnitude * F.lit(factor)).otherwise(out)
    return F.when(magnitude > 0, out)


def parse_measure(text: Column) -> Column:
    """'1.5cm' to struct(magnitude, unit); null if it does not start with a number."""
    pattern = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)(.*)$"
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", F.struct(number.try_cast("double").alias("magnitude"), F.trim(F.regexp_extract(text, pattern, 2)).alias("unit")))


#: Points, inches and percent of one unit of office formats.
UNITS = {"half_point": (0.5, "pt"), "hundredth_point": (0.01, "pt"), "emu": (1 / 914400, "in"), "twip": (1 / 1440, "in"), "fiftieth_percent": (1 / 50, "%")}


def office_measure(value: Column, unit: str) -> Column:
    """struct(magnitude, unit) of a whole number in one of UNITS; null if it is no number."""
    factor, name = UNITS[unit]
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull(), F.struct((number * F.lit(factor)).alias("magnitude"), F.lit(name).alias("unit")))


def office_width(value: Column, kind: Column) -> Column:
    """Table width by its type: twips, fiftieths of a percent (or a percentage as written); auto and nil are null."""
    percent = F.when(value.endswith("%"), F.struct(F.regexp_replace(value, "%$", "").try_cast("double").alias("magnitude"), F.lit("%").alias("unit"))).otherwise(office_measure(value, "fiftieth_percent"))
    return F.when(kind == "dxa", office_measure(value, "twip")).when(kind == "pct", percent)


def on_off(value: Column) -> Column:
    """A toggle: false only for 0, false and off."""
    return ~F.coalesce(value, F.lit("true")).isin("0", "false", "off")


#: Colours of the highlight palette.
COLORS = {"black": "000000", "blue": "0000ff", "cyan": "00ffff", "darkBlue": "000080", "darkCyan": "008080", "darkGray": "808080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000", "green": "00ff00", "lightGray": "c0c0c0", "magenta": "ff00ff", "red": "ff0000", "white": "ffffff", "yellow": "ffff00"}


def office_color(value: Column) -> Column:
    """#rrggbb of a named colour or six hex digits; auto and none are null."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair]), value)
    return F.concat(F.lit("#"), F.coalesce(named, F.when(value.rlike("^[0-9A-Fa-f]{6}$"), F.lower(value))))


def print_number(value: Column) -> Column:
    """Seven significant digits, positional, without trailing zeros."""
    whole = F.abs(value)
    digits = F.when(whole < 1, F.lit(1)).otherwise(F.floor(F.log10(whole)).cast("int") + 1)
    decimals = F.greatest(F.lit(0), F.least(F.lit(15), F.lit(7) - digits))
    fixed = F.lit(None).cast("string")
    for n in range(16):
        fixed = F.when(decimals == n, F.format_string(f"%.{n}f", value)).otherwise(fixed)
    plain = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "[.]$", "")).otherwise(fixed)
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def human_size(size: Column, largest: str = "TiB") -> Column:
    """Binary units B, KiB to the largest; no decimals for bytes, one otherwise."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
        if unit == largest:
            break
    return out


def token_runs(text: Column) -> Column:
    """Runs of tabs, runs of two or more spaces, and everything between, in order."""
    marked = F.regexp_replace(text, "(\\t++|[ ]{2,}+)", "\u0001$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda t: t != "")


def token_kind(token: Column) -> Column:
    return F.when(token.startswith("\t"), "tabs").when(token.startswith("  "), "spaces").otherwise("string")


def declared_encoding(content: Column) -> Column:
    """Encoding named in an XML declaration within the first 1024 bytes; null if none."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    name = F.regexp_extract(head, r"""^(?:\x{EF}\x{BB}\x{BF})?<\?xml[^>]*?\sencoding\s*=\s*["']([^"']+)["']""", 1)
    return F.when(name != "", name)


def bom_encoding(content: Column) -> Column:
    """Encoding of a byte order mark; the four-byte marks are tried first."""
    out = F.lit(None).cast("string")
    for mark, name in (("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE"), ("EFBBBF", "UTF-8"), ("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE")):
        out = F.when(F.startswith(content, F.unhex(F.lit(mark))), F.lit(name)).otherwise(out)
    return out


def hashes(content: Column) -> dict[str, Column]:
    """Digests and codecs of a binary column."""
    return {"crc32": F.crc32(content), "md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha384": F.sha2(content, 384), "sha512": F.sha2(content, 512), "base64": F.replace(F.base64(content), F.lit("\r\n"), F.lit("")), "hex": F.hex(content)}


def viewport(mode: str, paged: bool, content: str | None = None) -> str:
    """Viewport meta tag: explicit content wins; automatic fits the width of paged output; none writes nothing."""
    if content is not None:
        value = content.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    elif mode == "none":
        return ""
    elif mode == "fit_width" or mode == "automatic" and paged:
        value = "width=device-width,user-scalable=yes"
    else:
        value = "width=device-width,initial-scale=1.0,user-scalable=yes"
    return f'<meta name="viewport" content="{value}"/>'


def affine(a: Column, b: Column) -> Column:
    """Product of two affine maps struct(a, b, c, d, e, f): first `a`, then `b`."""
    get = lambda m, n: m.getField(n)
    cell = lambda x, y, u, v: get(a, x) * get(b, u) + get(a, y) * get(b, v)
    return F.struct(
        cell("a", "b", "a", "c").alias("a"),
        cell("a", "b", "b", "d").alias("b"),
        cell("c", "d", "a", "c").alias("c"),
        cell("c", "d", "b", "d").alias("d"),
        (cell("e", "f", "a", "c") + get(b, "e")).alias("e"),
        (cell("e", "f", "b", "d") + get(b, "f")).alias("f"),
    )
