"""The whole extraction as one plan (C6, A4, A13): files, texts and pages to one stream of blocks, enriched and normalised, to structured documents.

Sources give streams with the columns of STREAM: ``files.extract`` by ``file_blocks``, plain texts by ``text_blocks``, web pages by
``page_blocks``; they may be joined by unionByName. ``extract_documents`` appends the texts read from images, brings each document's
blocks together, and then enriches texts and normalises tables: its only exchange is the one by document. Python runs in the
parsers at the leaves alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_upper, let, py_strip, truthy, word_count
from ..operators import blocks as B
from ..operators import enrich, tables

IMAGE = "struct<path:string,width:int,height:int,format:string,mode:string,colours:int,size:long,ocr_text:string,ocr_confidence:double>"
#: cells holds a table's rows, its header among them; level is a heading's; properties are a block's, or for the kind "properties" its document's.
STREAM = {
    "doc": "string", "kind": "string", "ord": "int", "page": "int", "nth": "bigint", "text": "string", "level": "int", "title": "string",
    "cells": "array<array<string>>", "properties": "map<string,string>", "image": IMAGE, "error": "string",
}
LABELS = ("CARDINAL", "DATE", "LOC", "ORG", "PERSON")
KINDS = ("heading", "image", "table", "text")


def document_lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank, with their place and a page for every 20 lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw")).withColumn("line", py_strip(F.col("raw"))).where("line <> ''")
    return lines.select("doc_id", "ord", (F.floor(F.col("ord") / 20) + 1).cast("int").alias("page"), "line")


def line_kind(line: Column) -> Column:
    """Short upper-case lines are headings, those with a pipe are table rows."""
    return F.when(is_upper(line) & (word_count(line) <= 10), "heading").when(line.contains("|"), "table").otherwise("text")


def document_blocks(docs: DataFrame) -> DataFrame:
    """Lines as blocks."""
    return document_lines(docs).withColumns({"kind": line_kind(F.col("line")), "id": B.block_id("doc_id", "ord"), "n_entities": F.lit(0)})


def with_entities(blocks: DataFrame) -> DataFrame:
    """The entities of each line by the library's rule, with their number."""
    return blocks.withColumn("entities", enrich.entities(F.col("line"))).withColumn("n_entities", F.size("entities"))


def stream(**columns: Column) -> list[Column]:
    """The columns of STREAM: those given, the others null."""
    return [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in STREAM.items()]


def file_blocks(extracted: DataFrame) -> DataFrame:
    """Rows of ``files.extract``; each kind is numbered for itself in the order of its parser."""
    named = ("kind", "ord", "page", "text", "level", "title", "cells", "properties", "error")
    return extracted.select(*stream(doc=F.col("path"), nth=F.col("ord"), **{c: F.col(c) for c in named}))


def text_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain texts by their lines: texts and headings are numbered together, tables (a row each) by themselves; a page is 20 lines. A document without lines has one empty text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda raw, i: F.struct(i.alias("i"), py_strip(raw).alias("line")))
    sorted_ = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(x["i"], x["line"], line_kind(x["line"]).alias("kind")))
    own = lambda xs: F.transform(xs, lambda x, k: F.struct(x["i"], x["line"], x["kind"], k.alias("nth")))
    both = let(sorted_, lambda xs: F.concat(own(F.filter(xs, lambda x: x["kind"] != "table")), own(F.filter(xs, lambda x: x["kind"] == "table"))))
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.explode_outer(both).alias("b"))
    line, table = F.coalesce("b.line", F.lit("")), F.coalesce(F.col("b.kind") == "table", F.lit(False))
    return rows.select(
        *stream(
            doc=F.col("doc"), kind=F.when(table, "table").otherwise("text"), ord=F.coalesce("b.nth", F.lit(0)), page=F.floor(F.col("b.i") / 20) + 1, nth=F.coalesce("b.nth", F.lit(0)), text=F.when(~table, line),
            level=F.when(F.col("b.kind") == "heading", 1), title=F.when(F.col("b.kind") == "heading", line), cells=F.when(table, F.array(F.split(line, "\\|"))),
        )
    )


def page_blocks(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Web pages: headings, paragraphs and list items as texts, tables with their cells, images with what they say in their alt text."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->", "")
    all_ = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(f"(?is){pattern}"), F.lit(group))
    plain = lambda c: py_strip(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " "))
    spans = "<(h[1-6]|p|li)\\b[^>]*>(.*?)</(?:h[1-6]|p|li)>"
    texts = F.transform(F.arrays_zip(all_(body, spans, 1).alias("tag"), all_(body, spans, 2).alias("text")), lambda x: F.struct(F.lower(x["tag"]).alias("tag"), plain(x["text"]).alias("text")))
    rows_of = lambda grid: F.transform(all_(grid, "<tr\\b[^>]*>(.*?)</tr>", 1), lambda r: F.transform(all_(r, "<t[dh]\\b[^>]*>(.*?)</t[dh]>", 1), plain))
    grids = F.filter(F.transform(all_(body, "<table\\b[^>]*>(.*?)</table>", 1), rows_of), lambda rows: F.size(rows) > 0)
    seen = F.transform(all_(body, "<img\\b[^>]*>", 0), lambda t: F.struct(F.regexp_extract(t, "(?is)src=[\"']([^\"']*)", 1).alias("path"), F.regexp_extract(t, "(?is)alt=[\"']([^\"']*)", 1).alias("alt")))
    none = {"tag": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "cells": F.lit(None).cast("array<array<string>>"), "path": F.lit(None).cast("string")}
    entry = lambda kind, k, **filled: F.struct(F.lit(kind).alias("kind"), k.alias("nth"), *(filled.get(n, empty).alias(n) for n, empty in none.items()))
    parts = F.concat(
        F.transform(F.filter(texts, lambda x: x["text"] != ""), lambda x, k: entry("text", k, tag=x["tag"], text=x["text"])),
        F.transform(grids, lambda g, k: entry("table", k, cells=g)),
        F.transform(seen, lambda i, k: entry("image", k, path=i["path"], text=i["alt"])),
    )
    made = pages.select(F.col(doc).cast("string").alias("doc"), F.explode_outer(parts).alias("b"))
    kind, level = F.coalesce("b.kind", F.lit("text")), F.when(F.col("b.tag").startswith("h"), F.substring("b.tag", 2, 1).cast("int"))
    null = F.lit(None)
    image = F.struct(
        F.col("b.path").alias("path"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("string").alias("format"), null.cast("string").alias("mode"), null.cast("int").alias("colours"),
        null.cast("long").alias("size"), F.col("b.text").alias("ocr_text"), null.cast("double").alias("ocr_confidence"),
    )
    at = F.coalesce("b.nth", F.lit(0))
    return made.select(
        *stream(doc=F.col("doc"), kind=kind, ord=at, nth=at, text=F.when(kind == "text", F.coalesce("b.text", F.lit(""))), level=level, title=F.when(level.isNotNull(), F.col("b.text")), cells=F.col("b.cells"), image=F.when(kind == "image", image))
    )


def append_image_texts(blocks: DataFrame) -> DataFrame:
    """Each image whose reading isn't blank gives a text too, at its order and page, behind the document's own texts. In one pass."""
    read = F.coalesce(py_strip(F.col("image.ocr_text")), F.lit(""))
    none = F.create_map().cast("map<string,string>")
    made = F.create_map(F.lit("source"), F.lit("image_ocr"), F.lit("image_width"), F.col("image.width").cast("string"), F.lit("image_height"), F.col("image.height").cast("string"), F.lit("image_format"), F.col("image.format"))
    own = {c: F.col(c) for c in STREAM}
    text = own | {"kind": F.lit("text"), "nth": F.col("nth") + F.lit(B.APPENDED), "text": read, "level": F.lit(None), "title": F.lit(None), "properties": B.merge_maps(F.coalesce("properties", none), made), "image": F.lit(None)}
    each = F.array(F.struct(*stream(**own)), F.when((F.col("kind") == "image") & (read != ""), F.struct(*stream(**text))))
    return blocks.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("b")).select("b.*")


def enriched(block: Column) -> Column:
    """a gathered block with what was found in its text, or its table with header, typed rows and types."""
    said = F.when(block["said"], enrich.enrich(block["text"]))
    shaped = F.when(block["kind"] == "table", tables.normalize(F.array().cast("array<string>"), F.coalesce(block["cells"], F.array().cast("array<array<string>>")), F.map_from_entries(block["properties"])))

    def whole(x: Column) -> Column:
        added, table = x["added"], x["shaped"]
        labels = F.coalesce(F.transform(added["entities"], lambda e: e["label"]), F.array().cast("array<string>"))
        return F.struct(
            *(block[c].alias(c) for c in ("o", "p", "r", "nth", "id", "kind", "ord", "page", "text", "level", "title")), labels.alias("labels"),
            *(added[c].alias(c) for c in ("entities", "relations", "key_phrases", "language", "token_count", "relevance_score")), *(table[c].alias(c) for c in ("headers", "rows", "types")),
            F.coalesce(F.map_entries(table["metadata"]), block["properties"]).alias("properties"), block["image"].alias("image"),
        )

    return let(F.struct(said.alias("added"), shaped.alias("shaped")), whole)


def gathered(blocks: DataFrame) -> DataFrame:
    """One row a document: its blocks in their order (W1) as ``b``, enriched, its properties as ``metadata``, and its first error. The one exchange of the plan.

    Blocks go through the exchange as they came: what is found in them takes several times their room, so it is found behind it.
    """
    none = F.create_map().cast("map<string,string>")
    order, page, rank, nth = B.place()
    said = F.col("kind") == "text"
    id_ = F.concat_ws(":", "doc", rank, "nth")
    row = F.struct(
        order.alias("o"), page.alias("p"), rank.alias("r"), nth.alias("nth"), id_.alias("id"), F.when(said, B.block_kind(F.col("level"))).otherwise(F.col("kind")).alias("kind"), "ord", "page",
        F.coalesce("text", F.lit("")).alias("text"), "level", "title", "cells", F.map_entries(F.coalesce("properties", none)).alias("properties"), "image", F.coalesce(said, F.lit(False)).alias("said"),
    )
    made = blocks.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("all"), F.min("error").alias("error"))
    about = F.flatten(F.transform(F.filter("all", lambda x: x["kind"] == "properties"), lambda x: x["properties"]))
    empty = lambda x: x["kind"].isin("text", "heading") & (x["text"] == "")
    kept = F.filter("all", lambda x: x["kind"].isin(*KINDS) & ~empty(x))
    return made.select("doc", F.map_from_entries(about).alias("metadata"), F.transform(kept, enriched).alias("b"), "error")


def assemble(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Docs, with their blocks as the array ``b`` in order, to structured documents; no shuffle.

    Each block has id, kind, page, labels and the field ``text``, and may have a title of its own (a heading's is the section's; a heading without one takes its text).
    A document without blocks has empty parts and the status "failed".
    """
    fields = [f.name for f in docs.schema["b"].dataType.elementType.fields]
    named = lambda x: F.coalesce(x["title"], x[text]) if "title" in fields else x[text]
    ids = lambda xs: F.transform(xs, lambda x: x["id"])
    heads = F.transform(F.filter(F.transform("b", lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"))), lambda p: p["kind"] == "heading"), lambda p: p["i"])
    made = docs.withColumn("heads", heads)
    until = lambda j: F.coalesce(F.get("heads", j + 1), F.size("b"))
    level = lambda x: F.coalesce(x["level"], F.lit(1)) if "level" in fields else F.lit(1)
    section = lambda h, j: F.struct(h["id"].alias("id"), level(h).alias("level"), named(h).alias("title"), ids(F.slice("b", F.get("heads", j) + 1, until(j) - F.get("heads", j))).alias("block_ids"))
    made = made.withColumn("sections", F.transform(F.transform("heads", lambda i: F.get("b", i)), section))
    # a block's parent is the first heading that has the title of its section
    titles = F.array_distinct(F.transform("sections", lambda s: s["title"]))
    first = F.map_from_arrays(titles, F.transform(titles, lambda t: F.get(F.filter("sections", lambda s: s["title"] == t), F.lit(0))["id"]))
    made = made.withColumns({"first": first, "open": F.transform("heads", lambda i: F.get("b", i)["id"])})
    near = lambda i: F.get("b", i)["id"]
    parent = lambda x: F.element_at("first", named(x)) if "title" in fields else F.lit(None).cast("string")
    has = lambda x: F.coalesce(x["title"], F.lit("")) != "" if "title" in fields else F.lit(False)
    content = lambda x, i: x.dropFields("labels").withField("prev_id", F.when(i > 0, near(i - 1))).withField("next_id", near(i + 1)).withField("parent_id", F.when(has(x) | (x["kind"] == "heading"), F.try_element_at("first", named(x))))
    entries = lambda keys, found: F.map_from_entries(F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), found(k).alias("ids"))), lambda e: F.size(e["ids"]) > 0))
    of_kind = lambda k: F.filter("b", lambda x: x["kind"] == k)
    labelled = F.flatten(F.transform("b", lambda x: F.transform(x["labels"], lambda e: F.struct(e.alias("label"), x["id"].alias("id")))))
    pages = F.array_distinct(F.transform(F.filter("b", lambda x: truthy(x["page"])), lambda x: x["page"]))
    kinds, labels = (F.array(*map(F.lit, x)) for x in (KINDS, LABELS))
    return made.withColumn("named", labelled).select(
        *keep, F.transform("b", content).alias("content_blocks"), "sections", ids(F.slice("b", F.lit(1), F.coalesce(F.get("heads", F.lit(0)), F.size("b")))).alias("orphan_blocks"),
        entries(kinds, lambda k: ids(of_kind(k))).alias("by_type"), entries(pages, lambda p: ids(F.filter("b", lambda x: x["page"] == p))).alias("by_page"),
        entries(labels, lambda k: F.transform(F.filter("named", lambda n: n["label"] == k), lambda n: n["id"])).alias("by_entity"),
        F.size("b").alias("total_blocks"), *(F.size(of_kind(k)).alias(f"n_{k}") for k in KINDS), F.size("named").alias("total_entities"), F.size(pages).alias("total_pages"),
        F.when(F.size("b") > 0, "completed").otherwise("failed").alias("status"),
    )


def extract_documents(blocks: DataFrame) -> DataFrame:
    """A stream of blocks to structured documents; ``error`` says why one failed. One exchange, by document."""
    return assemble(gathered(append_image_texts(blocks)), ["doc", "metadata", "error"])


def structured(docs: DataFrame) -> DataFrame:
    """C6 on plain texts, line by line: a document is one row from the start, so there is no shuffle at all."""
    found = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda raw, i: F.struct(i.alias("ord"), (F.floor(i / 20) + 1).cast("int").alias("page"), py_strip(raw).alias("line")))
    labels: Callable[[Column], Column] = lambda x: F.transform(enrich.entities(x["line"]), lambda e: e["label"])
    lines = F.transform(F.filter(found, lambda x: x["line"] != ""), lambda x: F.struct(x["ord"], x["page"], x["line"], line_kind(x["line"]).alias("kind"), labels(x).alias("labels")))
    made = docs.select("doc_id", F.struct("source", "lang", "n_chars").alias("metadata"), lines.alias("b"))
    return assemble(made.withColumn("b", F.transform("b", lambda x: x.withField("id", F.concat_ws(":", "doc_id", x["ord"])))), ["doc_id", "metadata"], "line")
