"""List numbering: number formats and running counters as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sheets import column_label

#: Fixed values of the additive notation.
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
FORMATS = ("decimal", "decimal_zero", "letter_lower", "letter_upper", "roman_lower", "roman_upper", "none", "bullet")
LEVELS = 9


def roman(number: Column) -> Column:
    """1 to 3999 in capitals; other numbers stay decimal."""
    digit = lambda place, one, five, ten: F.element_at(F.array(*[F.lit(s) for s in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(number / place) % 10 + 1).cast("int"))
    thousands = F.repeat(F.lit("M"), F.floor(number / 1000).cast("int"))
    whole = F.concat(thousands, digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return F.when((number > 0) & (number <= 3999), whole).otherwise(number.cast("long").cast("string"))


def format_number(number: Column, fmt: Column) -> Column:
    """A list number in one of FORMATS."""
    number = number.cast("long")
    plain = number.cast("string")
    letters = F.when(number > 0, column_label(number - 1)).otherwise("")
    return (
        F.when(fmt == "decimal", plain)
        .when(fmt == "decimal_zero", F.when(number < 10, F.concat(F.lit("0"), plain)).otherwise(plain))
        .when(fmt == "letter_upper", letters)
        .when(fmt == "letter_lower", F.lower(letters))
        .when(fmt == "roman_upper", roman(number))
        .when(fmt == "roman_lower", F.lower(roman(number)))
        .otherwise("")
    )


def list_markers(items: DataFrame, key: list[str], order: list[str], level: str, spec: list[tuple[str, str, int]]) -> DataFrame:
    """`items` with marker and number: counters run over each list in order.

    `spec`: (label, format, start) for each level; `%N` in a label stands for
    level N's number.  A level that starts takes its start value (1 at least)
    and resets the deeper ones.  A level's number is how often it occurred
    since a higher one did: running sums over one sort by list and place.
    """
    spec = spec[:LEVELS]
    n = len(spec)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.least(F.col(level), F.lit(n - 1)).cast("int")
    seen = items.withColumn("_level", at)
    seen = seen.withColumns({f"_n{i}": F.count_if(F.col("_level") == i).over(w) for i in range(n)})
    # Sums only grow, so the sum at the last reset is the largest one at any reset.
    since = [F.col(f"_n{i}") - F.coalesce(F.max(F.when(F.col("_level") < i, F.col(f"_n{i}"))).over(w), F.lit(0)) for i in range(n)]
    counts = F.array(*[F.when(c > 0, c + max(start, 1) - 1).otherwise(0).cast("int") for c, (_, _, start) in zip(since, spec)])
    rows = seen.withColumn("_counts", counts).drop(*[f"_n{i}" for i in range(n)])
    marker = F.lit(None).cast("string")
    for i, (label, _, _) in enumerate(spec):
        text = F.lit(label)
        for p in range(9):
            shown = format_number(F.greatest(F.element_at("_counts", p + 1), F.lit(1)), F.lit(spec[p][1])) if p <= i and p < n else F.lit("")
            text = F.replace(text, F.lit(f"%{p + 1}"), shown)
        marker = F.when(F.col("_level") == i, text).otherwise(marker)
    return rows.withColumns({"marker": marker, "number": F.element_at("_counts", (F.col("_level") + 1).cast("int")).cast("long")}).drop("_level", "_counts")


class Counter:
    """The same counters for decoders, which see a document's items in order."""

    def __init__(self):
        self.numbers: list[int] = []
        self.formats: list[str] = []

    def advance(self, level: int, label: str, fmt: str, start: int = 1) -> str:
        while len(self.numbers) <= level:
            self.numbers.append(0)
            self.formats.append("decimal")
        self.numbers[level] = max(start, 1) if self.numbers[level] == 0 else self.numbers[level] + 1
        self.formats[level] = fmt
        self.numbers[level + 1 :] = [0] * (len(self.numbers) - level - 1)
        out, i = [], 0
        while i < len(label):
            if label[i] == "%" and label[i + 1 : i + 2] in tuple("123456789"):
                at = int(label[i + 1]) - 1
                if at < len(self.numbers):
                    out.append(plain_number(max(self.numbers[at], 1), self.formats[at]))
                i += 2
            else:
                out.append(label[i])
                i += 1
        return "".join(out)

    def restart(self, level: int, number: int) -> None:
        """The next advance of `level` yields `number`."""
        while len(self.numbers) <= level:
            self.numbers.append(0)
            self.formats.append("decimal")
        self.numbers[level] = max(number - 1, 0)


def plain_number(number: int, fmt: str) -> str:
    if fmt == "decimal":
        return str(number)
    if fmt == "decimal_zero":
        return f"{number:02d}"
    if fmt.startswith("letter"):
        digits = []
        while number > 0:
            number, rest = divmod(number - 1, 26)
            digits.append(chr(65 + rest))
        text = "".join(reversed(digits))
    elif fmt.startswith("roman"):
        text, left = "", number
        if not 0 < number <= 3999:
            return str(number)
        for value, symbol in _ROMAN:
            count, left = divmod(left, value)
            text += symbol * count
    else:
        return ""
    return text.lower() if fmt.endswith("lower") else text
