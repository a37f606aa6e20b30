"""Markdown rendering (M1-M5, A12, L2, U3, S14) as Column expressions and one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, truthy
from .blocks import kind_rank


def document_header(name: Column, kind: Column, size: Column, status: Column, created: Column) -> Column:
    """M1: bullets only for what is there."""
    bullet = lambda label, value, there: F.when(there, F.concat(F.lit(f"- **{label}** : "), value))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), name), F.lit(""), F.lit("---"), F.lit(""), F.lit("## Métadonnées"), F.lit(""),
        bullet("Type", kind, kind != ""), bullet("Taille", F.concat(F.call_function("format_number", size / 1048576, F.lit("0.00")), F.lit(" MB")), truthy(size)),
        bullet("Statut", status, status != ""), bullet("Créé le", created.cast("string"), created.isNotNull()),
        F.lit(""), F.lit("## Contenu"), F.lit(""),
    )


def text_block(text: Column, level: Column) -> Column:
    """M3: null for blank text; headings get up to six marks."""
    body = py_strip(text)
    return F.when(body != "", F.when(truthy(level), F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), body)).otherwise(body))


def table_row(cells: Column, width: Column) -> Column:
    """Padded or cut to the header's width."""
    shown = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def table_block(headers: Column, rows: Column) -> Column:
    """M4: without headers the first row is the header; cells are strings here, falsy ones already empty."""
    head = F.when(F.size(headers) > 0, headers).otherwise(F.get(rows, F.lit(0)))
    body = F.when(F.size(headers) > 0, rows).otherwise(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))
    width = F.size(head)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.concat(F.array(table_row(head, width), rule), F.transform(body, lambda r: table_row(r, width)))
    return F.when(width > 0, F.array_join(lines, "\n"))


def image_block(path: Column, alt: Column, ocr: Column, width: Column, height: Column) -> Column:
    """M5."""
    short = F.when(F.length(ocr) > 100, F.concat(F.substring(ocr, 1, 100), F.lit("..."))).otherwise(ocr)
    label = F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(alt, F.lit(" - "), short)).otherwise(alt)
    mark = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("!["), label, F.lit("]("), path, F.lit(")"))).otherwise(F.concat(F.lit("!["), label, F.lit("]")))
    quote = F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(F.lit("\n> "), ocr))
    size = F.when(truthy(width) & truthy(height), F.concat(F.lit("\n*Dimensions : "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit("*")))
    return F.concat(mark, F.coalesce(quote, F.lit("")), F.coalesce(size, F.lit("")))


def block_line(kind: Column, text: Column, level: Column, headers: Column, rows: Column, path: Column, ocr: Column, width: Column, height: Column) -> Column:
    """M2: the renderer of a block's kind; a kind without one gives null."""
    return F.when(kind.isin("text", "heading"), text_block(text, level)).when(kind == "table", table_block(headers, rows)).when(kind == "image", image_block(path, F.lit("image"), ocr, width, height))


def render(blocks: DataFrame, doc: str, line: str = "line", page: str = "page", order: str = "ord", kind: str = "kind", nth: str = "nth") -> DataFrame:
    """One Markdown text per document, a blank line after each block; null lines are left out.

    Blocks stand by page or 0, order or 0, then kind (texts, tables, images) and their place in its list, where blocks have these columns.
    """
    at = lambda c, name, kind_: (c if name in blocks.columns else F.lit(0)).cast(kind_)
    place = F.struct(
        F.coalesce(F.col(page), F.lit(0)).alias("p"), F.coalesce(F.col(order), F.lit(0)).alias("o"),
        at(kind_rank(F.col(kind)), kind, "int").alias("k"), at(F.col(nth), nth, "long").alias("n"), F.col(line).alias("line"),
    )
    made = blocks.where(F.col(line).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_list(place)).alias("b"))
    return made.select(doc, F.array_join(F.transform("b", lambda x: F.concat(x["line"], F.lit("\n"))), "\n").alias("markdown"))


def csv_text(headers: Column, rows: Column) -> Column:
    """Quotes doubled, CRLF line ends."""
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    row = lambda r: F.concat(F.array_join(F.transform(r, lambda x: quoted(F.coalesce(x, F.lit("")))), ","), F.lit("\r\n"))
    return F.concat(row(headers), F.array_join(F.transform(rows, row), ""))
