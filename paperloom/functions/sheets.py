"""Sheet algebra: labels, references, ranges, value types, sorting. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell's text is a number: no leading zeros, no separators of thousands.
NUMBER = r"^[ \t]*[+-]?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?[ \t]*$"


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def column_label(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA: bijective base 26."""
    index = index.cast("long")
    letter = lambda n: F.char(F.lit(65) + n % 26)
    out, first, count = letter(index), 26, 26
    labels = [(26, out)]
    for width in range(2, 7):
        count *= 26
        rest, letters = index - first, []
        for _ in range(width):
            letters.append(letter(rest))
            rest = F.floor(rest / 26)
        first += count
        labels.append((first, F.concat(*letters[::-1])))
    result = F.lit(None).cast("string")
    for limit, label in reversed(labels):
        result = F.when(index < limit, label).otherwise(result)
    return F.when(index >= 0, result)


def column_index(label: Column) -> Column:
    """A to 0, AA to 26; null unless capital letters only."""
    codes = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long") - 64)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, d: acc * 26 + d) - 1
    return F.when(label.rlike("^[A-Z]{1,12}$"), total)


def cell_ref(column: Column, row: Column) -> Column:
    """(0, 0) to A1."""
    return F.concat(column_label(column), (row.cast("long") + 1).cast("string"))


def parse_ref(ref: Column) -> Column:
    """A1 to struct(col, row), from 0; null if it is none."""
    ok = ref.rlike("^[A-Z]{1,12}[1-9][0-9]{0,9}$")
    return F.when(ok, F.struct(column_index(F.regexp_extract(ref, "^([A-Z]+)", 1)).alias("col"), (F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("long") - 1).alias("row")))


def parse_range(text: Column) -> Column:
    """A1:B2 to struct(from, to) of references."""
    parts = F.split(text, ":")
    start, end = parse_ref(F.try_element_at(parts, F.lit(1))), parse_ref(F.try_element_at(parts, F.lit(2)))
    return F.when(F.size(parts) == 2, F.struct(start.alias("from"), end.alias("to")))


def range_contains(rng: Column, col: Column, row: Column) -> Column:
    """Membership that leaves out the upper corner's row and column."""
    return (col >= rng["from"]["col"]) & (row >= rng["from"]["row"]) & (col < rng["to"]["col"]) & (row < rng["to"]["row"])


def value_types(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet_ix")) -> DataFrame:
    """`cells` (keys, row_ix, col_ix, text) with value_type and num.

    A column is numeric if it has a value below its first row and all such
    values are numbers; a cell of it is a float if it is a number itself.
    The verdict is aggregated first and joined, so no column is sorted.
    """
    number = is_number(F.col("text"))
    body = cells.where((F.col("row_ix") > 0) & (F.col("text") != ""))
    verdict = body.groupBy(*keys, "col_ix").agg(F.bool_and(number).alias("_numeric"))
    joined = cells.join(verdict, [*keys, "col_ix"], "left")
    is_float = F.coalesce(F.col("_numeric"), F.lit(False)) & number
    return joined.select(*cells.columns, F.when(is_float, "float").otherwise("string").alias("value_type"), F.when(is_float, F.trim(F.translate("text", "\t", " ")).try_cast("double")).alias("num"))


def used_range(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet_ix"), limit: tuple[int, int] | None = None) -> DataFrame:
    """Rows and columns up to the last non-empty cell (within `limit` rows and columns)."""
    full = cells.where(F.col("text") != "")
    if limit is not None:
        full = full.where((F.col("row_ix") < limit[0]) & (F.col("col_ix") < limit[1]))
    return full.groupBy(*keys).agg((F.max("row_ix") + 1).cast("long").alias("used_rows"), (F.max("col_ix") + 1).cast("long").alias("used_cols"))


def render_window(rows: Column, cols: Column, limit_rows: int = 10_000, limit_cols: int = 500) -> Column:
    """Extent to render: within the limit, one by one at least."""
    return F.struct(F.greatest(F.lit(1), F.least(rows, F.lit(limit_rows))).alias("rows"), F.greatest(F.lit(1), F.least(cols, F.lit(limit_cols))).alias("cols"))


#: Rows of one band.
_BAND = 64


def merge_cover(cells: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet_ix")) -> DataFrame:
    """`cells` with row_span, col_span, is_covered from merged `ranges` (keys, r0, c0, r1, c1, inclusive).

    A range whose first cell is absent is dropped.  Ranges meet the cells that
    are present by bands of rows, so a merged column costs no row per position.
    """
    spans = ranges.select(*keys, F.col("r0").alias("row_ix"), F.col("c0").alias("col_ix"), (F.col("r1") - F.col("r0") + 1).alias("_rs"), (F.col("c1") - F.col("c0") + 1).alias("_cs"), "r1", "c1")
    anchored = spans.join(cells.select(*keys, "row_ix", "col_ix"), [*keys, "row_ix", "col_ix"], "left_semi")
    band = lambda c: F.floor(F.col(c) / _BAND)
    wide = anchored.select(*keys, F.col("row_ix").alias("r0"), F.col("col_ix").alias("c0"), "r1", "c1", F.explode(F.sequence(band("row_ix"), band("r1"))).alias("_band"))
    inside = F.col("row_ix").between(F.col("r0"), F.col("r1")) & F.col("col_ix").between(F.col("c0"), F.col("c1")) & ((F.col("row_ix") != F.col("r0")) | (F.col("col_ix") != F.col("c0")))
    covered = cells.select(*keys, "row_ix", "col_ix", band("row_ix").alias("_band")).join(wide, [*keys, "_band"]).where(inside).select(*keys, "row_ix", "col_ix").distinct().withColumn("_covered", F.lit(True))
    out = cells.join(anchored.select(*keys, "row_ix", "col_ix", "_rs", "_cs"), [*keys, "row_ix", "col_ix"], "left").join(covered, [*keys, "row_ix", "col_ix"], "left")
    return out.select(*cells.columns, F.coalesce("_rs", F.lit(1)).alias("row_span"), F.coalesce("_cs", F.lit(1)).alias("col_span"), F.coalesce("_covered", F.lit(False)).alias("is_covered"))


def shared_strings(cells: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """`cells` with the text of their index (`si`) in the file's string table (keys, si, text)."""
    return cells.join(table.withColumnRenamed("text", "shared_text"), [*keys, "si"], "left")


def to_number(text: Column) -> Column:
    """Number in displayed text: other characters dropped; the later of comma and point is the decimal mark."""
    kept = F.regexp_replace(text, "[^0-9,.eE+-]", "")
    comma, point = F.char_length(F.substring_index(kept, ",", -1)), F.char_length(F.substring_index(kept, ".", -1))
    comma_last = kept.contains(",") & (~kept.contains(".") | (comma < point))
    plain = F.when(comma_last, F.regexp_replace(F.replace(kept, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(F.replace(kept, F.lit(","), F.lit("")))
    value = F.regexp_extract(plain, r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(value != "", value.try_cast("double"))


def natural_key(text: Column) -> Column:
    """Text order with digit runs by value: digits padded, accents and case after the rest."""
    from .text import fold

    spread = F.split(F.regexp_replace(fold(text), "([0-9]+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(spread, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 24, "0")).otherwise(p)), "")


def sort_sheet(rows: DataFrame, text: str, value_type: str, order: str, direction: int = 1) -> DataFrame:
    """Rows by one column: numbers, then text, blanks last in both directions; ties keep `order`; 0 restores it."""
    if direction == 0:
        return rows.orderBy(order)
    shown = F.trim(F.col(text))
    number = F.when(F.col(value_type) == "float", to_number(shown))
    blank = F.coalesce(shown == "", F.lit(True))
    kind = F.when(number.isNotNull(), 0).otherwise(1)
    put = (lambda c: F.asc_nulls_last(c)) if direction > 0 else (lambda c: F.desc_nulls_last(c))
    keyed = rows.withColumns({"_blank": blank, "_kind": F.when(blank, None).otherwise(kind), "_num": F.when(~blank, number), "_txt": F.when(~blank & number.isNull(), natural_key(shown))})
    return keyed.orderBy("_blank", put("_kind"), put("_num"), put("_txt"), order).drop("_blank", "_kind", "_num", "_txt")


def rectangle(cells: DataFrame, keys: tuple[str, ...] = ("file_id", "sheet_ix"), limit: tuple[int, int] = (10_000, 500)) -> DataFrame:
    """Every position of each sheet within `limit` rows and columns, the extent that is rendered; absent cells have empty text."""
    size = cells.groupBy(*keys).agg(F.least(F.max("row_ix"), F.lit(limit[0] - 1)).alias("_r"), F.least(F.max("col_ix"), F.lit(limit[1] - 1)).alias("_c"))
    grid = size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_r").cast("int"))).alias("row_ix"), "_c").select(*keys, "row_ix", F.explode(F.sequence(F.lit(0), F.col("_c").cast("int"))).alias("col_ix"))
    return grid.join(cells, [*keys, "row_ix", "col_ix"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def lag_in(order: str, keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy(order)
