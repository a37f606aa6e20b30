"""Whole tables as arrays in one row: types, normalisation, schema, projection (P18, P21, P23-P25, F9, F10, A7, A8). No shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.text import clean_cell, let
from .blocks import merge_maps


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))


def width(headers: Column, rows: Column) -> Column:
    """The headers' number, else that of the first row's cells."""
    return F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)))


def vote(values: Column) -> Column:
    """The type that over 70 % of the cleaned cells that aren't blank have."""
    share = lambda filled, test: F.size(F.filter(filled, test)) > F.size(filled) * C.SHARE
    kind = lambda x: F.when(F.size(x) == 0, "text").when(share(x, C.is_date), "date").when(share(x, C.is_number), "number").when(share(x, C.is_boolean), "boolean").otherwise("text")
    return let(F.filter(values, lambda x: x != ""), kind)


def column_types(headers: Column, rows: Column) -> Column:
    """A type for each column; short rows count as blank there."""
    return let(rows, lambda all_: F.transform(_upto(width(headers, all_)), lambda i: vote(F.transform(all_, lambda r: clean_cell(F.get(r, i))))))


def convert_rows(rows: Column, types: Column) -> Column:
    """typed cells as structs (raw, num, bool); cells beyond the types pass as they are."""
    beyond = lambda x: F.struct(x.alias("raw"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"))
    cell = lambda kinds, x, i: F.when(i < F.size(kinds), C.convert(x, F.get(kinds, i))).otherwise(beyond(x))
    return let(types, lambda kinds: F.transform(rows, lambda r: F.transform(r, lambda x, i: cell(kinds, x, i))))


def normalize(headers: Column, rows: Column, metadata: Column) -> Column:
    """header, types and typed cells of a table in one struct; the metadata tell what was found."""
    names, body = C.detect_header(headers, rows)

    def whole(table: Column) -> Column:
        kinds = column_types(table["headers"], table["rows"])
        found = F.create_map(
            F.lit("column_types"), F.array_join(kinds, ","), F.lit("row_count"), F.size(table["rows"]).cast("string"), F.lit("column_count"), F.size(table["headers"]).cast("string"), F.lit("normalized"), F.lit("true")
        )
        return F.struct(table["headers"].alias("headers"), convert_rows(table["rows"], kinds).alias("rows"), kinds.alias("types"), merge_maps(F.coalesce(metadata, F.create_map().cast("map<string,string>")), found).alias("metadata"))

    return let(F.struct(names.alias("headers"), body.alias("rows")), whole)


def schema(headers: Column, types: Column) -> Column:
    """P25: "text" where a type is missing."""
    return F.transform(headers, lambda h, i: F.struct(h.alias("name"), F.coalesce(F.get(types, i), F.lit("text")).alias("type"), i.alias("position")))


def row_maps(headers: Column, rows: Column) -> Column:
    """Rows by header name; missing cells are null, and of equal names the last one wins."""
    last = lambda h: F.size(headers) - F.array_position(F.reverse(headers), h)
    entries = lambda r: F.filter(F.transform(headers, lambda h, i: F.struct(h.alias("k"), F.get(r, i).alias("v"), i.alias("i"))), lambda e: e["i"] == last(e["k"]))
    return F.transform(rows, lambda r: F.map_from_entries(F.transform(entries(r), lambda e: F.struct(e["k"], e["v"]))))


def project(order: Column, headers: Column, rows: Column, types: Column) -> Column:
    """The id is null for order 0."""
    return F.struct(
        F.when(order != 0, order.cast("string")).alias("id"), schema(headers, types).alias("schema"), rows.alias("rows"), F.size(rows).alias("row_count"), F.size(headers).alias("column_count")
    )


def block_dict(base: dict[str, Column], extra: Column) -> Column:
    """A map of texts; entries of ``extra`` win over those of ``base``."""
    made = F.create_map(*(x for k, v in base.items() for x in (F.lit(k), v.cast("string"))))
    return merge_maps(made, F.coalesce(extra, F.create_map().cast("map<string,string>")))
