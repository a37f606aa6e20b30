"""Table cell tests and conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_cell

#: Date shapes with their parse patterns, and the boolean words (fixed values).
DATE_SHAPES = [("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/yyyy"), ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "d-M-yyyy"), ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "yyyy/M/d")]
TRUE_WORDS, FALSE_WORDS = ["true", "oui", "yes", "1"], ["false", "non", "no", "0"]
SHARE = 0.7
_NUMBER = "^[+-]?(\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+(_\\d+)*)?$"


def is_date(c: Column) -> Column:
    """one of four shapes, valid in the calendar."""
    tests = [F.when(c.rlike(shape) & ~c.rlike("(^|[/-])0000([/-]|$)"), F.try_to_timestamp(c, F.lit(form)).isNotNull()).otherwise(False) for shape, form in DATE_SHAPES]
    return F.coalesce(tests[0] | tests[1] | tests[2] | tests[3], F.lit(False))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, ",", "."), " ", "")


def is_number(c: Column) -> Column:
    """a decimal comma or point, spaces ignored."""
    return F.coalesce(_plain(c).rlike(_NUMBER) | _plain(c).rlike("(?i)^[+-]?(nan|inf|infinity)$"), F.lit(False))


def to_number(c: Column) -> Column:
    return F.when(is_number(c), F.regexp_replace(_plain(c), "_", "").try_cast("double"))


def is_boolean(c: Column) -> Column:
    """F7."""
    return F.lower(c).isin(TRUE_WORDS + FALSE_WORDS)


def column_type(raw: Column) -> Column:
    """An aggregate. The type that over 70 % of the cells that aren't blank have; date, number, boolean, else text."""
    cell = clean_cell(raw)
    filled = F.count(F.when(cell != "", 1))
    share = lambda test: F.count(F.when((cell != "") & test(cell), 1)) > filled * SHARE
    return F.when(filled == 0, "text").when(share(is_date), "date").when(share(is_number), "number").when(share(is_boolean), "boolean").otherwise("text")


def convert(raw: Column, kind: Column) -> Column:
    """F8: struct (raw, num, bool); raw is null for blank cells and kept where a conversion fails."""
    cell = clean_cell(raw)
    word = F.lower(cell)
    return F.struct(
        F.when(cell != "", cell).alias("raw"),
        F.when((kind == "number") & (cell != ""), to_number(cell)).alias("num"),
        F.when((kind == "boolean") & word.isin(TRUE_WORDS + FALSE_WORDS), word.isin(TRUE_WORDS)).alias("bool"),
    )


def looks_like_header(row: Column) -> Column:
    """More than half of the cells hold text."""
    return F.size(F.filter(row, lambda x: clean_cell(x) != "")) * 2 > F.size(row)


def filled_rows(rows: Column) -> Column:
    """rows of cleaned cells, without those in which all are blank."""
    return F.filter(F.transform(rows, lambda row: F.transform(row, clean_cell)), lambda row: F.exists(row, lambda x: x != ""))


def detect_header(headers: Column, rows: Column) -> tuple[Column, Column]:
    """(headers, data rows) with blank rows dropped; a first row that looks like a header is used as one."""
    first = F.get(rows, F.lit(0))
    tidy = lambda row: F.transform(row, clean_cell)
    given = F.size(headers) > 0
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda i: F.concat(F.lit("Colonne_"), i.cast("string")))
    made = F.when(F.size(first) > 0, numbered).otherwise(F.array().cast("array<string>"))
    names = F.when(given, tidy(headers)).when(F.size(rows) == 0, F.array().cast("array<string>")).when(looks_like_header(first), tidy(first)).otherwise(made)
    rest = F.when(given | ~F.coalesce(looks_like_header(first), F.lit(False)), rows).otherwise(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    return names, filled_rows(rest)
