"""Registered queries over the given tables, each with its SQL twin where SQL can express it.

Keys name operators of the inventory: block_links W1-W3, sections W5, section_fill W4, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import correct, text
from ..operators import blocks as B
from ..operators import enrich, images, markdown, tables
from ..sources import files
from . import catalog
from .extraction import document_blocks, document_lines, structured, with_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINES = r"""lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CAST((i - 1) // 20 + 1 AS INTEGER) AS page, line FROM (
  SELECT doc_id, i, regexp_replace(l, '^\s+|\s+$', '', 'g') AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> '')"""
BLOCKS = LINES + r""", blocks AS (SELECT *, doc_id || ':' || ord AS id, CASE
  WHEN len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) <= 10 AND upper(line) = line AND lower(line) <> line THEN 'heading'
  WHEN contains(line, '|') THEN 'table' ELSE 'text' END AS kind FROM lines)"""
TURNS = "turns AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, role = 'user' AS heading, coalesce(text, '') AS text FROM conversations)"
CELLS = """cells AS (SELECT o_orderkey % 50 AS tbl, o_orderkey AS row_idx, col_idx, CASE col_idx
    WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',5' WHEN 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'oui' WHEN 1 THEN 'Non' ELSE '  ' END
    ELSE ' ' || o_orderpriority END AS raw FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS col_idx))"""
NUMBER_SQL = r"regexp_full_match(replace(replace(cell, ',', '.'), ' ', ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"
DATE_SQL = r"coalesce(regexp_full_match(cell, '\d{1,2}/\d{1,2}/\d{4}') AND try_strptime(cell, '%d/%m/%Y') IS NOT NULL, false)"
BOOL_SQL = "lower(cell) IN ('true','oui','yes','1','false','non','no','0')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_blocks(table(spark, sf_dir, "documents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"), (F.col("role") == "user").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_custkey") % 3 == 0, "oui").when(F.col("o_custkey") % 3 == 1, "Non").otherwise("  ")
    made = [F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(",5")), word, F.concat(F.lit(" "), F.col("o_orderpriority"))]
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("tbl"), F.col("o_orderkey").alias("row_idx"), F.posexplode(F.array(*made)).alias("col_idx", "raw"))
    return rows


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 x 8."""
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("px"))


PIXELS = "px AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(CAST(floor((CAST(x AS DOUBLE) + 0.5) * 255) AS INTEGER), 0), 255)) AS px FROM embeddings)"


@query(f"WITH {BLOCKS} SELECT doc_id, ord, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def block_links(spark, sf):
    return B.link(blocks(spark, sf), "doc_id", ["ord"]).select("doc_id", "ord", "id", "prev_id", "next_id")


@query(f"""WITH {TURNS}, n AS (SELECT *, CAST(sum(CAST(heading AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_no FROM turns)
SELECT conv_id, section_no, max(text) FILTER (WHERE heading) AS title, string_agg(id, ',' ORDER BY turn) AS block_ids FROM n GROUP BY conv_id, section_no""")
def sections(spark, sf):
    heading = F.col("heading")
    numbered = B.number_sections(turns(spark, sf), "conv_id", ["turn"], heading)
    return B.sections(numbered, "conv_id", "turn", heading, "text").withColumn("block_ids", F.array_join("block_ids", ","))


@query(f"""WITH {BLOCKS}, n AS (SELECT *, sum(CASE kind WHEN 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM blocks)
SELECT doc_id, string_agg(id, ',' ORDER BY ord) AS orphan_blocks FROM n WHERE s = 0 GROUP BY doc_id""")
def orphans(spark, sf):
    heading = F.col("kind") == "heading"
    numbered = B.number_sections(blocks(spark, sf), "doc_id", ["ord"], heading).where("section_no = 0")
    return B.sections(numbered, "doc_id", "ord", heading, "line").select("doc_id", F.array_join("block_ids", ",").alias("orphan_blocks"))


@query(f"WITH {TURNS} SELECT id, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section_title FROM turns")
def section_fill(spark, sf):
    return B.fill_title(turns(spark, sf), "conv_id", ["turn"], F.col("heading"), "text").select("id", "section_title")


@query(f"""WITH {BLOCKS}, f AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS title FROM blocks),
h AS (SELECT doc_id, title, arg_min(id, ord) AS parent_id FROM f WHERE kind = 'heading' GROUP BY doc_id, title)
SELECT f.id, f.title AS section_title, h.parent_id FROM f LEFT JOIN h ON f.doc_id = h.doc_id AND f.title IS NOT DISTINCT FROM h.title""")
def parent_lookup(spark, sf):
    filled = B.fill_title(blocks(spark, sf), "doc_id", ["ord"], F.col("kind") == "heading", "line")
    return B.attach_parents(filled, "doc_id", "ord", "section_title", F.col("kind") == "heading").select("id", "section_title", "parent_id")


@query(f"WITH {BLOCKS} SELECT doc_id, kind, string_agg(id, ',' ORDER BY ord) AS ids FROM blocks GROUP BY doc_id, kind")
def index_by_type(spark, sf):
    return B.inverted_index(blocks(spark, sf), "doc_id", "kind", "ord").withColumn("ids", F.array_join("ids", ","))


@query(f"WITH {BLOCKS} SELECT doc_id, page, string_agg(id, ',' ORDER BY ord) AS ids FROM blocks GROUP BY doc_id, page")
def index_by_page(spark, sf):
    return B.inverted_index(blocks(spark, sf), "doc_id", "page", "ord").withColumn("ids", F.array_join("ids", ","))


#: The library's entity rule, said of a token t; and what it leaves of the token.
LABEL = r"""CASE WHEN regexp_full_match(t, '(19|20)[0-9]{2}[^0-9A-Za-z_]*') THEN 'DATE' WHEN regexp_full_match(t, '[0-9]{2,}[^0-9A-Za-z_]*') THEN 'CARDINAL' WHEN regexp_full_match(t, '\p{Lu}\p{Ll}{3,}[^0-9A-Za-z_]*') THEN 'PERSON' END"""
LABELS = f"list_filter(list_transform(string_split_regex(line, '[ \\n]'), lambda t: {LABEL}), lambda x: x IS NOT NULL)"
ENTITIES = f"ents AS (SELECT doc_id, ord, id, unnest({LABELS}) AS label FROM blocks)"


@query(f"WITH {BLOCKS}, {ENTITIES} SELECT doc_id, label, string_agg(id, ',' ORDER BY ord) AS ids FROM ents GROUP BY ALL")
def index_by_entity(spark, sf):
    found = with_entities(blocks(spark, sf)).withColumn("label", F.explode(F.transform("entities", lambda e: e["label"])))
    return B.inverted_index(found, "doc_id", "label", "ord").withColumn("ids", F.array_join("ids", ","))


STATISTICS = """count(*) AS total_blocks, count(*) FILTER (WHERE kind = 'text') AS n_text, count(*) FILTER (WHERE kind = 'heading') AS n_heading,
  count(*) FILTER (WHERE kind = 'table') AS n_table, count(*) FILTER (WHERE kind = 'image') AS n_image, CAST(0 AS BIGINT) AS total_entities, count(DISTINCT page) AS total_pages"""


@query(f"WITH {BLOCKS} SELECT doc_id, {STATISTICS} FROM blocks GROUP BY doc_id")
def doc_stats(spark, sf):
    return B.statistics(blocks(spark, sf), "doc_id")


@query(f"""WITH {BLOCKS} SELECT doc_id, count(*) FILTER (WHERE kind <> 'table') AS n_text, count(*) FILTER (WHERE kind = 'table') AS n_tables, count(*) > 0 AS has_content FROM blocks GROUP BY doc_id""")
def content_summary(spark, sf):
    return B.content_summary(blocks(spark, sf), "doc_id").select("doc_id", "n_text", "n_tables", "has_content")


@query(f"WITH {BLOCKS} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM blocks WHERE kind = 'table')")
def has_content_semi(spark, sf):
    return catalog.having(table(spark, sf, "documents").select("doc_id", "source"), blocks(spark, sf), "doc_id", "table")


@query(f"WITH {BLOCKS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM blocks WHERE kind = 'table')")
def empty_anti(spark, sf):
    return catalog.lacking(table(spark, sf, "documents").select("doc_id", "source"), blocks(spark, sf), "doc_id", "table")


@query(f"""WITH {LINES}, u AS (SELECT *, 1 AS s FROM lines WHERE page % 3 <> 0 UNION ALL SELECT *, 0 FROM lines WHERE page % 3 <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY s, ord) AS n FROM u) SELECT doc_id, page, ord, line, s AS source_rank FROM r WHERE n = 1""")
def merge_sources(spark, sf):
    lines = document_lines(table(spark, sf, "documents"))
    return B.merge_sources(lines.where("page % 3 <> 0"), lines.where("page % 3 <> 1"), "doc_id").select("doc_id", "page", "ord", "line", "source_rank")


@query("SELECT doc_id, lang AS lang, coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def merge_metadata(spark, sf):
    low = F.create_map(F.lit("lang"), F.lit("?"), F.lit("source"), F.coalesce("source", F.lit("")))
    high = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").select("doc_id", B.merge_maps(low, high).alias("m")).select("doc_id", "m.lang", "m.source", "m.n_chars")


ATTEMPTS = "tries AS (SELECT doc_id, CAST(a AS INTEGER) AS attempt, ((doc_id * 31 + a * 17) % 101) / 100.0 AS confidence, text || repeat('.', a % 3) AS text FROM documents, (SELECT unnest(range(12)) AS a))"


def _tries(spark, sf):
    rows = B.attempts(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "attempt", (((F.col("doc_id") * 31 + F.col("attempt") * 17) % 101) / 100.0).alias("confidence"), F.expr("concat(text, repeat('.', attempt % 3))").alias("text"))


@query(f"""WITH {ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, length(text) DESC, attempt) AS n FROM tries)
SELECT doc_id, attempt, CAST(confidence AS DOUBLE) AS confidence, text FROM r WHERE n = 1""")
def best_attempt(spark, sf):
    return B.best_attempt(_tries(spark, sf), "doc_id")


@query("""SELECT doc_id, round(coalesce(avg(c) FILTER (WHERE c <> -1), 0) / 100, 6) AS confidence
FROM (SELECT doc_id, CASE WHEN (doc_id + a) % 5 = 0 THEN -1 ELSE (doc_id * 31 + a * 17) % 101 END AS c FROM documents, (SELECT unnest(range(12)) AS a)) GROUP BY doc_id""")
def mean_confidence(spark, sf):
    each = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda a: F.when((F.col("doc_id") + a) % 5 == 0, -1).otherwise((F.col("doc_id") * 31 + a * 17) % 101))
    return table(spark, sf, "documents").select("doc_id", F.round(B.mean_confidence(each), 6).alias("confidence"))


SPLIT = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT doc_id, {SPLIT.format("text")} AS a, {SPLIT.format("replace(text, 'e ', 'e')")} AS b, (doc_id % 100) / 100.0 AS c FROM documents)
SELECT doc_id, round(CAST(CASE WHEN abs(a - b) > a * 0.2 THEN c * 0.9 ELSE least(1.0, c * 1.05) END AS DOUBLE), 6) AS confidence FROM t""")
def confidence_adjust(spark, sf):
    made = correct.adjust_confidence(F.col("text"), F.replace(F.col("text"), F.lit("e "), F.lit("e")), (F.col("doc_id") % 100) / 100.0)
    return table(spark, sf, "documents").select("doc_id", F.round(made, 6).alias("confidence"))


@query(f"""WITH {CELLS}, t AS (SELECT *, trim(raw) AS cell FROM cells), g AS (SELECT tbl, col_idx, count(*) FILTER (WHERE cell <> '') AS n, count(*) FILTER (WHERE cell <> '' AND {DATE_SQL}) AS d,
  count(*) FILTER (WHERE cell <> '' AND {NUMBER_SQL}) AS f, count(*) FILTER (WHERE cell <> '' AND {BOOL_SQL}) AS b FROM t GROUP BY tbl, col_idx)
SELECT tbl, col_idx, CASE WHEN n = 0 THEN 'text' WHEN d > 0.7 * n THEN 'date' WHEN f > 0.7 * n THEN 'number' WHEN b > 0.7 * n THEN 'boolean' ELSE 'text' END AS kind FROM g""")
def infer_types(spark, sf):
    return cells(spark, sf).groupBy("tbl", "col_idx").agg(C.column_type(F.col("raw")).alias("kind"))


@query(f"""WITH {CELLS}, t AS (SELECT *, trim(raw) AS cell FROM cells) SELECT row_idx, col_idx, {DATE_SQL} AS is_date, {NUMBER_SQL} AS is_number, {BOOL_SQL} AS is_boolean FROM t""")
def cell_tests(spark, sf):
    cell = text.clean_cell(F.col("raw"))
    return cells(spark, sf).select("row_idx", "col_idx", C.is_date(cell).alias("is_date"), C.is_number(cell).alias("is_number"), C.is_boolean(cell).alias("is_boolean"))


@query(f"""WITH {CELLS}, t AS (SELECT *, trim(raw) AS cell FROM cells)
SELECT row_idx, col_idx, CASE WHEN cell <> '' THEN cell END AS raw, CASE WHEN col_idx = 2 THEN TRY_CAST(replace(cell, ',', '.') AS DOUBLE) END AS num, CASE WHEN col_idx = 3 AND cell <> '' THEN lower(cell) = 'oui' END AS bool FROM t""")
def convert_cells(spark, sf):
    rows = cells(spark, sf)
    kinds = rows.groupBy("tbl", "col_idx").agg(C.column_type(F.col("raw")).alias("kind")).withColumn("kind", F.when(F.col("col_idx") == 0, "text").otherwise(F.col("kind")))
    return rows.join(kinds, ["tbl", "col_idx"]).select("row_idx", "col_idx", C.convert(F.col("raw"), F.col("kind")).alias("c")).select("row_idx", "col_idx", "c.*")


@query(r"""SELECT doc_id, string_agg(trim(h), ';' ORDER BY i) AS headers FROM (SELECT doc_id, unnest(string_split(first, '|')) AS h, generate_subscripts(string_split(first, '|'), 1) AS i FROM
 (SELECT doc_id, string_split(text, chr(10))[1] AS first FROM documents WHERE contains(text, '|')) WHERE len(list_filter(string_split(first, '|'), lambda x: trim(x) <> '')) * 2 > len(string_split(first, '|'))) GROUP BY doc_id""")
def header_detect(spark, sf):
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, "\\|"))
    found = table(spark, sf, "documents").where(F.contains(F.col("text"), F.lit("|"))).select("doc_id", rows.alias("rows"))
    names, _ = C.detect_header(F.array().cast("array<string>"), F.col("rows"))
    return found.where(C.looks_like_header(F.get("rows", F.lit(0)))).select("doc_id", F.array_join(names, ";").alias("headers"))


@query("""SELECT o_orderkey, 'clef,' || chr(34) || 'l' || chr(34) || chr(34) || 'état' || chr(34) || ',prix' || chr(13) || chr(10) || o_orderkey || ',' || chr(34) || o_orderstatus || chr(34) || chr(34) || chr(34) || ','
  || CAST(floor(o_totalprice) AS BIGINT) || chr(13) || chr(10) AS csv FROM orders""")
def table_csv(spark, sf):
    row = F.array(F.col("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit('"')), F.floor("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", markdown.csv_text(F.array(*map(F.lit, ("clef", 'l"état', "prix"))), F.array(row)).alias("csv"))


@query(f"""WITH {CELLS} SELECT row_idx, max(raw) FILTER (WHERE col_idx = 0) AS clef, max(raw) FILTER (WHERE col_idx = 1) AS date, max(raw) FILTER (WHERE col_idx = 4) AS prio FROM cells GROUP BY row_idx""")
def row_dicts(spark, sf):
    return cells(spark, sf).groupBy("row_idx").pivot("col_idx", [0, 1, 4]).agg(F.first("raw")).toDF("row_idx", "clef", "date", "prio")


@query(f"WITH {BLOCKS} SELECT id, line FROM blocks WHERE kind = 'heading'")
def filter_type(spark, sf):
    return catalog.blocks_of(blocks(spark, sf), "heading", 2).select("id", "line")


@query(f"WITH {BLOCKS} SELECT id, line FROM blocks WHERE page = 2")
def filter_page(spark, sf):
    return catalog.blocks_of(blocks(spark, sf), page=2).select("id", "line")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf):
    return catalog.point(table(spark, sf, "orders"), "o_orderkey", 7).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_status(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("extracting")
    return catalog.with_status(table(spark, sf, "orders").select("o_orderkey", state.alias("status")), "completed").select("o_orderkey")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 10")
def limit_offset(spark, sf):
    return catalog.page_of(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 25, 10)


@query(f"WITH {BLOCKS} SELECT doc_id, CASE WHEN kind = 'table' THEN 'tables' ELSE 'text_blocks' END AS bucket, count(*) AS n FROM blocks GROUP BY ALL")
def buckets(spark, sf):
    return blocks(spark, sf).groupBy("doc_id", catalog.bucket(F.col("kind")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_id, count(*) AS n_blocks FROM blocks GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(s.n_blocks, 0) AS n_blocks, l.quality FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def data_response(spark, sf):
    rows = blocks(spark, sf).withColumn("nth", F.col("ord").cast("long"))
    made = catalog.data_of(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), rows, "doc_id", ["id"], ["quality"])
    n = F.size("text_blocks") + F.size("tables") + F.size("images")
    return made.select("doc_id", "source", n.cast("long").alias("n_blocks"), "quality")


@query("SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at FROM events")
def doc_info(spark, sf):
    return table(spark, sf, "events").select("event_id", catalog.iso(F.col("ts")).alias("at"))


@query(f"""WITH {LINES} SELECT 'doc:' || doc_id AS src, line AS text, CAST(ord AS BIGINT) AS place FROM lines UNION ALL SELECT 'conv:' || conv_id, text, turn FROM conversations""")
def union_blocks(spark, sf):
    a = document_lines(table(spark, sf, "documents")).select(F.concat(F.lit("doc:"), "doc_id").alias("src"), F.col("line").alias("text"), F.col("ord").cast("long").alias("place"))
    b = table(spark, sf, "conversations").select(F.concat(F.lit("conv:"), "conv_id").alias("src"), "text", F.col("turn").alias("place"))
    return a.unionByName(b)


@query(f"WITH {BLOCKS} SELECT id, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) - 1 AS INTEGER) AS ordinal FROM blocks")
def running_ordinal(spark, sf):
    return B.running_ordinal(blocks(spark, sf), ["doc_id", "kind"], ["ord"]).select("id", "kind", "ordinal")


POSITIONS = rf"""toks AS (SELECT doc_id, t, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS w FROM documents))),
ents AS (SELECT doc_id, pos, regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}_]+$', '') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM toks WHERE {LABEL} IS NOT NULL)"""


@query(f"WITH {POSITIONS} SELECT a.doc_id, a.t AS entity1, b.t AS entity2, 'proximity' AS type, abs(a.pos - b.pos) AS distance FROM ents a JOIN ents b ON a.doc_id = b.doc_id AND a.i < b.i AND abs(a.pos - b.pos) < 50")
def relations(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", enrich.entities(F.col("text")).alias("ents"))
    return found.select("doc_id", F.explode(enrich.relations(F.col("ents"))).alias("r")).select("doc_id", "r.*")


ENRICHED = rf"""w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents), parts AS (SELECT doc_id, rid, text, string_split_regex(text, '[ \n]') AS p FROM w),
tk AS (SELECT doc_id, rid, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM parts), tp AS (SELECT *, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tk),
en AS (SELECT *, {LABEL} AS label FROM tp)"""


@query(f"""WITH {ENRICHED}, c AS (SELECT rid, count(label) AS n, count(*) FILTER (WHERE label IN ('PERSON', 'DATE')) AS k FROM en GROUP BY rid), s AS (SELECT doc_id, rid, {SPLIT.format("text")} AS tokens FROM w)
SELECT doc_id, n AS entities, CAST(tokens AS INTEGER) AS tokens, 'fr' AS language, round(CAST(CASE WHEN tokens = 0 THEN 0 ELSE least(1.0, 0.5 * n / greatest(tokens, 1) + 0.5 * k / greatest(n, 1)) END AS DOUBLE), 6) AS score FROM s JOIN c USING (rid)""")
def relevance(spark, sf):
    """F20, F21, F23, F24 through the one struct."""
    found = table(spark, sf, "documents").select("doc_id", enrich.enrich(F.coalesce("text", F.lit(""))).alias("e"))
    return found.select("doc_id", F.size("e.entities").cast("long").alias("entities"), F.col("e.token_count").alias("tokens"), "e.language", F.round("e.relevance_score", 6).alias("score"))


@query(f"SELECT doc_id, CAST({SPLIT.format('text')} AS INTEGER) AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("tokens"))


SENTENCES = r"""sents AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '') AS s FROM documents)"""


@query(f"""WITH {SENTENCES}, e AS (SELECT doc_id, unnest(s) AS s FROM sents) SELECT doc_id, CASE WHEN {SPLIT.format("s")} <= 10 AND upper(s) = s AND lower(s) <> s THEN 'heading' ELSE 'paragraph' END AS kind, count(*) AS n
FROM e GROUP BY ALL""")
def text_structure(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(enrich.structure(F.col("text"))).alias("s"))
    return found.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(rf"""WITH {ENRICHED}, cut AS (SELECT rid, string_split(regexp_replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1), 'g'), chr(1)) AS s FROM w),
e AS (SELECT rid, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM cut), o AS (SELECT *, CAST(coalesce(sum(length(s)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM e),
h AS (SELECT rid, i, s, row_number() OVER (PARTITION BY rid ORDER BY i) AS nth FROM o WHERE EXISTS (SELECT 1 FROM en WHERE en.rid = o.rid AND en.label IS NOT NULL AND en.start >= o.at AND en.start < o.at + length(o.s)))
SELECT doc_id, coalesce(p, '') AS phrases FROM w LEFT JOIN (SELECT rid, string_agg(regexp_replace(s, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY i) AS p FROM h WHERE nth <= 5 GROUP BY rid) USING (rid)""")
def key_phrases(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return found.select("doc_id", F.array_join(enrich.key_phrases(F.col("text"), enrich.entities(F.col("text"))), "\n").alias("phrases"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)[^>]*>([^<]*)<', 1) AS tags, regexp_extract_all(html, '<(h1|p|li)[^>]*>([^<]*)<', 2) AS texts FROM pages),
e AS (SELECT page_id, unnest(tags) AS tag, regexp_replace(unnest(texts), '^ +| +$', '', 'g') AS text FROM t) SELECT page_id, text, CASE tag WHEN 'h1' THEN 'heading' ELSE 'paragraph' END AS kind FROM e WHERE text <> ''""")
def span_structure(spark, sf):
    """F26 on the pages' headings (size 20) and paragraphs (size 11)."""
    spans = "<(h1|p|li)[^>]*>([^<]*)<"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(spans), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(spans), F.lit(2)).alias("text"))
    sized = F.transform(both, lambda x: F.struct(x["text"].alias("text"), F.when(x["tag"] == "h1", 20.0).otherwise(11.0).alias("size")))
    return table(spark, sf, "pages").select("page_id", F.explode(enrich.span_structure(sized)).alias("s")).select("page_id", "s.*")


@query()
def correct_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", correct.correct_text(F.col("text")).alias("text"))


@query(f"""WITH {BLOCKS} SELECT doc_id, string_agg(CASE WHEN kind = 'heading' THEN '# ' || line ELSE line END || chr(10), chr(10) ORDER BY page, ord) AS markdown FROM blocks GROUP BY doc_id""")
def markdown_doc(spark, sf):
    level = F.when(F.col("kind") == "heading", 1)
    return markdown.render(blocks(spark, sf).withColumn("line", markdown.text_block(F.col("line"), level)), "doc_id")


@query("""SELECT o_orderkey, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' |  |' AS markdown FROM orders""")
def markdown_table(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", markdown.table_block(F.array(F.lit("a"), F.lit("b")), F.array(F.array("o_orderstatus"))).alias("markdown"))


@query("""SELECT doc_id, '![image - ' || CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END || '](img/' || doc_id || '.png)' || chr(10) || '> ' || text AS markdown FROM documents WHERE text <> ''""")
def markdown_image(spark, sf):
    path = F.concat(F.lit("img/"), "doc_id", F.lit(".png"))
    none = F.lit(None).cast("int")
    return table(spark, sf, "documents").where("text <> ''").select("doc_id", markdown.image_block(path, F.lit("image"), F.col("text"), none, none).alias("markdown"))


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/msword' WHEN 3 THEN 'image/tiff' ELSE 'application/octet-stream' END AS mime,
 CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'word' WHEN 3 THEN 'image' END AS reader FROM pages""")
def mime_dispatch(spark, sf):
    path = F.concat("url", F.get(F.array(*map(F.lit, (".pdf", ".PNG", ".doc", ".tif", ".zip"))), (F.col("page_id") % 5).cast("int")))
    return table(spark, sf, "pages").select("page_id", files.mime(path).alias("mime"), files.reader_of(path).alias("reader"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.upsert(old, old.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_rows(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.delete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@query("""WITH e AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'extracting' WHEN 2 THEN 'completed' ELSE 'failed' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT event_id, status, before, before IS NULL OR (before = 'extracting' AND status IN ('completed','failed')) OR (before <> 'extracting' AND status = 'extracting') AS allowed FROM p""")
def status_machine(spark, sf):
    state = F.get(F.array(*map(F.lit, ("uploaded", "extracting", "completed", "failed"))), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf, "events").select("event_id", "user_id", state.alias("status"))
    return catalog.transitions(rows, "user_id", ["event_id"], "status").select("event_id", "status", "before", "allowed")


@query(f"WITH {PIXELS}, s AS (SELECT vec_id, list_stddev_pop(px) AS sd FROM px) SELECT vec_id, round(CASE WHEN sd < 30 THEN least(2.5, 30 / greatest(sd, 1)) ELSE 1 END, 6) AS factor FROM s")
def contrast_factor(spark, sf):
    return pixels(spark, sf).select("vec_id", F.round(images.contrast_factor(images.deviation(F.col("px"))), 6).alias("factor"))


@query(f"WITH {PIXELS}, e AS (SELECT vec_id, unnest(px) AS v FROM px), m AS (SELECT vec_id, median(v) AS t FROM e GROUP BY vec_id) SELECT vec_id, t AS threshold, count(*) FILTER (WHERE v > t) AS white FROM e JOIN m USING (vec_id) GROUP BY vec_id, t")
def median_threshold(spark, sf):
    each = pixels(spark, sf).select("vec_id", "px", images.median(F.col("px")).alias("threshold"))
    return each.select("vec_id", "threshold", F.size(F.filter("px", lambda x: x > F.col("threshold"))).cast("long").alias("white"))


@query(f"""WITH {PIXELS}, e AS (SELECT vec_id, unnest(px) AS v FROM px), h AS (SELECT vec_id, v, CAST(count(*) AS DOUBLE) AS c FROM e GROUP BY ALL),
k AS (SELECT vec_id, v, sum(c) OVER w AS low, sum(v * c) OVER w AS lev, sum(c) OVER a AS n, sum(v * c) OVER a AS total FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY v), a AS (PARTITION BY vec_id)),
d AS (SELECT vec_id, v, low * (n - low) AS part, CASE WHEN n > low THEN lev / low - (total - lev) / (n - low) ELSE 0 END AS x FROM k), b AS (SELECT vec_id, v, part * (x * x) AS b, max(part * (x * x)) OVER (PARTITION BY vec_id) AS m FROM d)
SELECT vec_id, CAST(CASE WHEN max(m) > 0 THEN min(v) FILTER (WHERE b = m) ELSE 0 END AS INTEGER) AS threshold FROM b GROUP BY vec_id""")
def otsu_threshold(spark, sf):
    """I8: the library's kernel over the stacked histograms of an Arrow batch."""

    @F.pandas_udf("int")
    def threshold(px: pd.Series) -> pd.Series:
        return pd.Series(images.otsu_thresholds([np.asarray(x, np.uint8) for x in px]))

    return pixels(spark, sf).select("vec_id", threshold("px").alias("threshold"))


# 8 x 8 images in SQL: the nine neighbours of pixel i, the edge repeating outwards, and the pixels as text
NEAR = "list_transform(range(9), lambda d: px[1 + 8 * greatest(0, least(7, i // 8 + d // 3 - 1)) + greatest(0, least(7, i % 8 + d % 3 - 1))])"
STEP = "(SELECT vec_id, list_transform(range(64), lambda i: {}) AS px FROM {})"
CROSS = "list_{}([n[2], n[4], n[5], n[6], n[8]])"
SHOWN = "array_to_string(px, ',') AS pixels"
INSIDE = "i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("vec_id", F.col("px").alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.element_at(F.array(*map(F.lit, ("basic", "advanced", "aggressive"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("method"), (F.col("vec_id") % 10).cast("int").alias("orientation"))


def shown(images_: DataFrame) -> DataFrame:
    return images_.select("vec_id", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


@query(f"""WITH {PIXELS}, m AS (SELECT vec_id, px, floor(list_avg(px) + 0.5) AS mean FROM px),
c AS (SELECT vec_id, list_transform(px, lambda v: CAST(floor(greatest(0, least(255, mean + 2 * (v - mean)))) AS BIGINT)) AS px FROM m),
n AS (SELECT vec_id, px, list_transform(range(64), lambda i: (32 * px[i + 1] - 2 * (list_sum({NEAR}) - px[i + 1]) + 8) / 16) AS f FROM c),
s AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN {INSIDE} THEN CAST(greatest(0, least(255, floor(f[i + 1]))) AS BIGINT) ELSE px[i + 1] END) AS px FROM n),
z AS {STEP.format(f"list_sort({NEAR})[5]", "s")} SELECT vec_id, {SHOWN} FROM z""")
def image_basic(spark, sf):
    """Contrast, sharpening, median."""
    basic = sized(spark, sf).withColumn("method", F.lit("basic"))
    return shown(images.filtered(basic, images.preprocess, ("method",)))


def _turned(x: str, y: str) -> str:
    """SQL for the place of the pixel that comes to row y, column x, by orientation tag."""
    back = {2: (y, f"7 - {x}"), 3: (f"7 - {y}", f"7 - {x}"), 4: (f"7 - {y}", x), 5: (x, y), 6: (f"7 - {x}", y), 7: (f"7 - {x}", f"7 - {y}"), 8: (x, f"7 - {y}")}
    return f"CASE vec_id % 10 {' '.join(f'WHEN {k} THEN 8 * ({r}) + {c}' for k, (r, c) in back.items())} ELSE 8 * {y} + {x} END"


@query(f"WITH {PIXELS}, z AS {STEP.format('px[1 + ' + _turned('(i % 8)', '(i // 8)') + ']', 'px')} SELECT vec_id, {SHOWN} FROM z")
def image_rotate(spark, sf):
    return shown(images.filtered(sized(spark, sf), images.rotate, ("orientation",)))


@query(f"""WITH {PIXELS}, m AS {STEP.format(f"list_sort({NEAR})[5]", "px")},
r AS {STEP.format(f"list_transform([{NEAR}], lambda n: (n[4] + 2 * n[5] + n[6] + 2) // 4)[1]", "m")},
z AS {STEP.format(f"list_transform([{NEAR}], lambda n: (n[2] + 2 * n[5] + n[8] + 2) // 4)[1]", "r")} SELECT vec_id, {SHOWN} FROM z""")
def image_denoise(spark, sf):
    return shown(images.filtered(sized(spark, sf), images.denoise))


def _cross(which: str, of: str) -> str:
    return STEP.format(f"list_transform([{NEAR}], lambda n: {CROSS.format(which)})[1]", of)


@query(f"""WITH {PIXELS}, a AS (SELECT vec_id, list_transform(px, lambda v: CASE WHEN v >= 128 THEN 255 ELSE 0 END) AS px FROM px),
b AS {_cross("min", "a")}, c AS {_cross("max", "b")}, d AS {_cross("max", "c")}, z AS {_cross("min", "d")} SELECT vec_id, {SHOWN} FROM z""")
def image_morphology(spark, sf):
    return shown(images.filtered(sized(spark, sf), images.morphology))


@query()
def image_preprocess(spark, sf):
    """Each image by its own method and orientation, resampled to 1 dot an inch; tests compare with loops over pixels."""
    made = images.filtered(sized(spark, sf), lambda p, method, turn: images.preprocess(p, method, turn, 1.0), ("method", "orientation"))
    return made.select("vec_id", "method", "width", "height", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


def _pictures(spark, sf):
    rows, url = table(spark, sf, "pages"), F.col("url")
    words = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), url, F.lit("\n")))
    known = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("width"), F.lit("1"), F.lit("alt"), url))
    form, size = F.lit("PNG"), F.octet_length("html").cast("long")
    wide = (F.col("page_id") % 50 + 1).cast("int")
    made = rows.select("page_id", words.alias("ocr_text"), ((F.col("page_id") % 100) / 100.0).alias("ocr_confidence"), wide.alias("width"), F.lit(10).alias("height"), form.alias("format"), known.alias("known"), size.alias("size"))
    kind = images.image_kind(F.col("width"), F.col("height"), F.lit(60), F.lit(True))
    return made.withColumn("metadata", images.image_metadata(F.col("known"), F.col("width"), F.col("height"), F.col("format"), F.lit("RGB"), F.col("size"), kind))


PICTURES = r"""pics AS (SELECT page_id, CAST(page_id % 50 + 1 AS INTEGER) AS w, CASE page_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || url || chr(10) END AS ocr, CASE page_id % 2 WHEN 0 THEN url END AS alt, CAST(octet_length(encode(html)) AS VARCHAR) AS size, page_id % 100 / 100.0 AS conf FROM pages)"""


@query(f"""WITH {PICTURES} SELECT page_id, CAST(w AS VARCHAR) AS width, alt, 'PNG' AS format, 'RGB' AS mode, coalesce(size, '0') AS size_bytes, CASE WHEN w / 10.0 > 3 OR w / 10.0 < 0.33 THEN 'graphique' ELSE 'image' END AS content_type FROM pics""")
def image_metadata(spark, sf):
    names = ("width", "alt", "format", "mode", "size_bytes", "content_type")
    return _pictures(spark, sf).select("page_id", *(F.col("metadata")[n].alias(n) for n in names))


@query(f"""WITH {PICTURES}, o AS (SELECT *, coalesce(ocr, '') <> '' AS seen FROM pics)
SELECT page_id, 'image' AS kind, ocr AS text, CASE WHEN seen THEN 'ocr' END AS method, CASE WHEN seen THEN CAST(conf AS DOUBLE) END AS confidence, alt, NULL AS source, NULL AS image_width FROM o
UNION ALL SELECT page_id, 'text', trim(replace(ocr, chr(10), ' ')), 'ocr', CAST(conf AS DOUBLE), alt, 'image_ocr', CAST(w AS VARCHAR) FROM o WHERE trim(replace(ocr, chr(10), ' ')) <> ''""")
def image_outputs(spark, sf):
    """Images and the texts read from them, in one pass."""
    both = images.image_outputs(_pictures(spark, sf), ["page_id"])
    return both.select("page_id", "kind", "text", "method", "confidence", *(F.col("metadata")[n].alias(n) for n in ("alt", "source", "image_width")))


@query(f"""WITH t AS (SELECT doc_id, a - 1 AS attempt, CASE WHEN a > 0 AND (doc_id + a) % 3 = 0 OR a > 0 AND doc_id % 7 = 0 OR doc_id % 14 = 0 THEN '' ELSE trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || repeat('.', a % 3)) END AS text,
 (doc_id * 31 + a * 17) % 101 / 100.0 AS confidence FROM documents, (SELECT unnest(range(13)) AS a)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN attempt >= 0 THEN 0 ELSE 1 END, confidence DESC, length(text) DESC, attempt) AS n FROM t WHERE text <> ''),
b AS (SELECT d.doc_id, CAST(attempt AS INTEGER) AS attempt, coalesce(r.text, '') AS before, replace(coalesce(r.text, ''), 'e ', 'e') AS text, confidence AS c FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r ON r.doc_id = d.doc_id AND n = 1)
SELECT doc_id, attempt, text, round(CAST(CASE WHEN c IS NULL THEN 0 WHEN abs({SPLIT.format("before")} - {SPLIT.format("text")}) > {SPLIT.format("before")} * 0.2 THEN c * 0.9 ELSE least(1.0, c * 1.05) END AS DOUBLE), 6) AS confidence FROM b""")
def best_reading(spark, sf):
    """Attempts, mean confidence, the best one, correction and adjustment composed; attempt -1 is the plain image."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("a"), "text")
    blank = F.expr("a > 0 AND (doc_id + a) % 3 = 0 OR a > 0 AND doc_id % 7 = 0 OR doc_id % 14 = 0")
    text_ = F.when(blank, F.lit(" ")).otherwise(F.concat(text.py_strip(F.coalesce("text", F.lit(""))), F.expr("repeat('.', a % 3)")))
    tries = rows.select("doc_id", (F.col("a") - 1).alias("attempt"), text_.alias("text"), F.array(((F.col("doc_id") * 31 + F.col("a") * 17) % 101).cast("int"), F.lit(-1)).alias("confidences"))
    best = images.best_reading(tries, "doc_id", lambda c: F.replace(c, F.lit("e "), F.lit("e")))
    return best.select("doc_id", "attempt", "text", F.round("confidence", 6).alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN w / 11.0 < 300 THEN CAST(floor(w * (300 / (w / 11.0))) AS INTEGER) ELSE w END AS width FROM (SELECT p_partkey, CAST(p_size * 100 AS INTEGER) AS w FROM part)""")
def upscale_plan(spark, sf):
    wide = F.col("p_size") * 100
    return table(spark, sf, "part").select("p_partkey", images.upscale_plan(wide, wide, 300)["width"].alias("width"))


@query("""SELECT p_partkey, CASE WHEN a > 3 OR a < 0.33 THEN 'graphique' WHEN a > 0.8 AND a < 1.2 AND p_partkey % 70 BETWEEN 1 AND 49 THEN 'diagramme' ELSE 'image' END AS kind FROM (SELECT p_partkey, p_size / 10.0 AS a FROM part)""")
def image_kind(spark, sf):
    return table(spark, sf, "part").select("p_partkey", images.image_kind(F.col("p_size"), F.lit(10), F.col("p_partkey") % 70, F.lit(True)).alias("kind"))


STRUCTURED = rf"""{BLOCKS}, linked AS (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, sum(CASE kind WHEN 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s,
  {LABELS} AS found FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT doc_id, string_agg(concat_ws('|', id, kind, page, coalesce(prev_id, '-'), coalesce(next_id, '-')), ',' ORDER BY ord) AS content, count(*) AS n, sum(len(found)) AS e, count(DISTINCT page) AS pages,
  coalesce(string_agg(id, ',' ORDER BY ord) FILTER (WHERE s = 0), '') AS orphans FROM linked GROUP BY doc_id),
sec AS (SELECT doc_id, string_agg(p, ';' ORDER BY s) AS sections FROM (SELECT doc_id, s, max(line) FILTER (WHERE kind = 'heading') || '=' || string_agg(id, ',' ORDER BY ord) AS p FROM linked WHERE s > 0 GROUP BY doc_id, s) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(p, ';' ORDER BY kind) AS types FROM (SELECT doc_id, kind, kind || '=' || string_agg(id, ',' ORDER BY ord) AS p FROM linked GROUP BY doc_id, kind) GROUP BY doc_id),
pg AS (SELECT doc_id, string_agg(p, ';' ORDER BY page) AS by_page FROM (SELECT doc_id, page, page || '=' || string_agg(id, ',' ORDER BY ord) AS p FROM linked GROUP BY doc_id, page) GROUP BY doc_id),
en AS (SELECT doc_id, string_agg(p, ';' ORDER BY label) AS by_entity FROM (SELECT doc_id, label, label || '=' || string_agg(id, ',' ORDER BY ord) AS p FROM
  (SELECT doc_id, ord, id, unnest(found) AS label FROM linked) GROUP BY doc_id, label) GROUP BY doc_id)
SELECT d.doc_id, coalesce(content, '') AS content, coalesce(sections, '') AS sections, coalesce(orphans, '') AS orphans, coalesce(types, '') AS by_type, coalesce(by_page, '') AS by_page, coalesce(by_entity, '') AS by_entity,
  CAST(coalesce(n, 0) AS INTEGER) AS total_blocks, CAST(coalesce(e, 0) AS INTEGER) AS total_entities, CAST(coalesce(pages, 0) AS INTEGER) AS total_pages, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN sec USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN pg USING (doc_id) LEFT JOIN en USING (doc_id)"""


@query(f"WITH {STRUCTURED}")
def doc_structured(spark, sf):
    """A13 flattened for comparison: every part as text."""
    found = structured(table(spark, sf, "documents"))
    block = lambda x: F.concat_ws("|", x["id"], x["kind"], x["page"].cast("string"), F.coalesce(x["prev_id"], F.lit("-")), F.coalesce(x["next_id"], F.lit("-")))
    named = lambda pairs: F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["a"].cast("string"), F.array_join(e["b"], ","))), ";")
    index = lambda m: named(F.transform(F.map_keys(m), lambda k: F.struct(k.alias("a"), F.element_at(m, k).alias("b"))))
    return found.select(
        "doc_id", F.array_join(F.transform("content_blocks", block), ",").alias("content"), named(F.transform("sections", lambda x: F.struct(x["title"].alias("a"), x["block_ids"].alias("b")))).alias("sections"),
        F.array_join("orphan_blocks", ",").alias("orphans"), *(index(F.col(c)).alias(c) for c in ("by_type", "by_page", "by_entity")), "total_blocks", "total_entities", "total_pages", "status",
    )


@query(f"""WITH {BLOCKS}, p AS (SELECT *, ord % 40 // 20 AS leaf, CASE WHEN ord % 3 > 0 THEN kind ELSE '' END AS label FROM blocks)
SELECT doc_id, 'page' AS by, CAST(leaf AS VARCHAR) AS key, count(*) AS n FROM p WHERE leaf <> 0 GROUP BY ALL UNION ALL SELECT doc_id, 'label', label, count(*) FROM p WHERE label <> '' GROUP BY ALL""")
def index_skips(spark, sf):
    """A2, A3: page 0 and empty labels are no keys."""
    rows = blocks(spark, sf).withColumns({"leaf": F.expr("cast(ord % 40 div 20 as int)"), "label": F.when(F.col("ord") % 3 > 0, F.col("kind")).otherwise("")})
    made = [B.inverted_index(rows, "doc_id", key, "ord").select("doc_id", F.lit(by).alias("by"), F.col(key).cast("string").alias("key"), F.size("ids").cast("long").alias("n")) for key, by in (("leaf", "page"), ("label", "label"))]
    return made[0].unionByName(made[1])


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Colonne_1|Colonne_2|Colonne_3' ELSE o_orderstatus || '|' || o_orderpriority END AS headers,
 CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS kept FROM orders""")
def header_edges(spark, sf):
    """an empty first row gives no header, a sparse one numbered columns, a full one itself."""
    none, status = F.array().cast("array<string>"), F.array("o_orderstatus", "o_orderpriority")
    first = F.when(F.col("o_orderkey") % 3 == 0, none).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit(" "), F.lit(None).cast("string"), F.col("o_orderstatus"))).otherwise(status)
    names, rest = C.detect_header(none, F.array(first, status))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(names, "|").alias("headers"), F.size(rest).alias("kept"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS n_entities, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders""")
def block_response(spark, sf):
    """Null entities, and metadata that are no object."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.array("o_orderstatus")).alias("entities"), F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("s")))).otherwise("[1]").alias("metadata"))
    return catalog.response(rows).select("o_orderkey", F.size("entities").alias("n_entities"), F.element_at("metadata", F.lit("s")).alias("status"))


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS total_blocks, CAST(NULL AS BIGINT) AS total_entities, count(DISTINCT page) AS total_pages FROM blocks GROUP BY doc_id")
def statistics_json(spark, sf):
    """Statistics written as JSON and read back; what isn't there is null."""
    stats = B.statistics(blocks(spark, sf), "doc_id").select("doc_id", catalog.to_json(F.struct(F.struct("total_blocks", "total_pages").alias("statistics"))).alias("data"))
    return catalog.statistics_of(stats, "doc_id")


@query("""SELECT event_id, status, 'f' || user_id AS filename FROM (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'completed' ELSE 'failed' END AS status FROM events) WHERE status = 'completed'""")
def completed_status(spark, sf):
    """P14, P17."""
    state = F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed")
    rows = table(spark, sf, "events").select("event_id", state.alias("status"), F.concat(F.lit("f"), "user_id").alias("filename"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return catalog.status_of(catalog.completed(rows), "event_id").select("event_id", "status", "filename")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as texts, lines with a pipe as tables, and each document with a source as an image, in one block schema."""
    rows = blocks(spark, sf_dir)
    level = F.when(F.col("kind") == "heading", 1)
    texts = rows.where("kind <> 'table'").select("doc_id", "ord", "page", F.col("line").alias("text"), level.alias("section_level"), F.lit(None).cast("array<string>").alias("entities"), F.lit(0.5).alias("confidence"))
    cells_ = F.array(F.split("line", "\\|"))
    grids = rows.where("kind = 'table'").select("doc_id", "ord", "page", F.array().cast("array<string>").alias("headers"), cells_.alias("rows"))
    shown = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("ord"), F.lit(0).alias("page"), F.concat(F.lit("img/"), "source").alias("image_path"), F.lit("seen").alias("ocr_text"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return B.union_contents(texts, grids, shown, "doc_id").withColumn("id", B.block_id("doc_id", "ord"))


@query(f"""WITH {BLOCKS}, u AS (SELECT doc_id, ord, kind, page, line, NULL AS image FROM blocks UNION ALL SELECT doc_id, -1, 'image', 0, NULL, 'img/' || source FROM documents),
r AS (SELECT *, doc_id || ':' || ord AS id, CASE WHEN kind IN ('text', 'heading') THEN line END AS text FROM u), h AS (SELECT doc_id, text, arg_min(id, ord) AS parent FROM r WHERE kind = 'heading' GROUP BY doc_id, text)
SELECT id, r.kind AS type, r.text, image, lag(id) OVER w AS previous_block_id, lead(id) OVER w AS next_block_id, h.parent AS parent_block_id FROM r LEFT JOIN h ON h.doc_id = r.doc_id AND h.text IS NOT DISTINCT FROM r.text WINDOW w AS (PARTITION BY r.doc_id ORDER BY ord)""")
def persisted_blocks(spark, sf):
    """Three kinds in one schema, with their neighbours' and parents' real ids."""
    made = contents(spark, sf).withColumn("title", F.col("content.text"))
    related = B.relate(made, "doc_id", None, F.struct(*B.place()), "title", F.col("kind") == "heading")
    return catalog.persisted(related, "doc_id").select("id", "type", "content.text", F.col("content.image_path").alias("image"), "previous_block_id", "next_block_id", "parent_block_id")


@query(f"""WITH {BLOCKS}, l AS (SELECT doc_id, page, ord, CASE kind WHEN 'heading' THEN '# ' || line WHEN 'table' THEN '| ' || replace(line, '|', ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(string_split(line, '|'), lambda x: '---'), ' | ') || ' |' ELSE line END AS md FROM blocks
UNION ALL SELECT doc_id, 0, -1, '![image - seen](img/' || source || ')' || chr(10) || '> seen' FROM documents)
SELECT doc_id, string_agg(md || chr(10), chr(10) ORDER BY page, ord) AS markdown FROM l WHERE md IS NOT NULL GROUP BY doc_id""")
def markdown_mixed(spark, sf):
    """All kinds through their renderer."""
    none = F.lit(None).cast("int")
    made = contents(spark, sf)
    line = markdown.block_line(F.col("kind"), F.col("content.text"), F.when(F.col("kind") == "heading", 1), F.col("content.headers"), F.col("content.rows"), F.col("content.image_path"), F.col("content.ocr_text"), none, none)
    return markdown.render(made.withColumn("line", line), "doc_id")


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Métadonnées' || chr(10) || chr(10) || '- **Type** : part' || chr(10)
 || CASE WHEN p_size % 5 <> 0 THEN '- **Taille** : ' || CAST(p_size % 5 AS VARCHAR) || '.00 MB' || chr(10) ELSE '' END || chr(10) || '## Contenu' || chr(10) AS header FROM part""")
def document_header(spark, sf):
    """M1."""
    size, none = F.col("p_size") % 5 * 1048576, F.lit(None).cast("string")
    return table(spark, sf, "part").select("p_partkey", markdown.document_header(F.col("p_name"), F.lit("part"), size, none, none).alias("header"))


@query("""SELECT 'p' || page_id || '.' || CASE page_id % 2 WHEN 0 THEN 'pdf' ELSE 'png' END AS filename, sha256('f/' || page_id) AS id, CASE page_id % 2 WHEN 0 THEN 'application/pdf' ELSE 'image/png' END AS file_type, CAST(octet_length(encode(html)) AS BIGINT) AS file_size, 'uploaded' AS status FROM pages""")
def uploaded_documents(spark, sf):
    """Files to rows of the documents table."""
    name = F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".png"))
    made = table(spark, sf, "pages").select(F.concat(F.lit("f/"), "page_id").alias("path"), name.alias("filename"), F.octet_length("html").cast("long").alias("length"), files.mime(name).alias("mime"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return catalog.uploaded(made).select("filename", "id", "file_type", "file_size", "status")


TABLES = f"""{CELLS}, rows AS (SELECT row_idx // 50 AS tbl, row_idx, list(trim(raw) ORDER BY col_idx) AS cells FROM cells GROUP BY row_idx)"""
HEADERS = ("clef", "date", "prix", "ok", "ok")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of at most 50 orders each, as arrays of rows in one row."""
    each = cells(spark, sf_dir).groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "raw"))), lambda x: text.clean_cell(x["raw"])).alias("cells"))
    made = each.groupBy(F.expr("row_idx div 50").alias("tbl")).agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("r"))
    return made.select("tbl", F.array(*map(F.lit, HEADERS)).alias("headers"), F.transform("r", lambda x: x["cells"]).alias("rows"))


def _share(test: str) -> str:
    return f"count(*) FILTER (WHERE cell <> '' AND {test}) > 0.7 * count(*) FILTER (WHERE cell <> '')"


@query(f"""WITH {TABLES}, c AS (SELECT tbl, unnest(cells) AS cell, generate_subscripts(cells, 1) AS i FROM rows),
t AS (SELECT tbl, i, CASE WHEN count(*) FILTER (WHERE cell <> '') = 0 THEN 'text' WHEN {_share(DATE_SQL)} THEN 'date' WHEN {_share(NUMBER_SQL)} THEN 'number' WHEN {_share(BOOL_SQL)} THEN 'boolean' ELSE 'text' END AS kind FROM c GROUP BY tbl, i),
s AS (SELECT tbl, string_agg(['clef', 'date', 'prix', 'ok', 'ok'][i] || ':' || kind || ':' || (i - 1), ';' ORDER BY i) AS columns FROM t GROUP BY tbl)
SELECT tbl, CASE WHEN tbl <> 0 THEN CAST(tbl AS VARCHAR) END AS id, columns, CAST(n AS INTEGER) AS row_count, CAST(5 AS INTEGER) AS column_count FROM s JOIN (SELECT tbl, count(*) AS n FROM rows GROUP BY tbl) USING (tbl)""")
def table_projection(spark, sf):
    found = table_rows(spark, sf)
    made = found.select("tbl", tables.project(F.col("tbl"), F.col("headers"), F.col("rows"), tables.column_types(F.col("headers"), F.col("rows"))).alias("t"))
    columns = F.array_join(F.transform("t.schema", lambda c: F.concat_ws(":", c["name"], c["type"], c["position"].cast("string"))), ";")
    return made.select("tbl", "t.id", columns.alias("columns"), "t.row_count", "t.column_count")


@query(f"""WITH {TABLES} SELECT row_idx, cells[1] AS clef, cells[5] AS ok FROM rows""")
def table_row_maps(spark, sf):
    found = table_rows(spark, sf).select(F.explode(tables.row_maps(F.col("headers"), F.col("rows"))).alias("m"))
    return found.select(F.expr("cast(m['clef'] as bigint)").alias("row_idx"), F.expr("m['clef']").alias("clef"), F.expr("m['ok']").alias("ok"))


@query(f"""WITH {TABLES} SELECT CAST(cells[1] AS BIGINT) AS row_idx, CAST(cells[1] AS DOUBLE) AS clef, cells[2] AS date, CAST(replace(cells[3], ',', '.') AS DOUBLE) AS prix, cells[5] AS prio FROM rows""")
def normalized_tables(spark, sf):
    found = table_rows(spark, sf).withColumn("types", tables.column_types(F.col("headers"), F.col("rows")))
    row = found.select(F.explode(tables.convert_rows(F.col("rows"), F.col("types"))).alias("r"))
    return row.select(F.expr("cast(r[0].raw as bigint)").alias("row_idx"), F.expr("r[0].num").alias("clef"), F.expr("r[1].raw").alias("date"), F.expr("r[2].num").alias("prix"), F.expr("r[4].raw").alias("prio"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, ord, list_transform(string_split(line, '|'), lambda x: trim(x)) AS cells FROM lines WHERE contains(line, '|'))
SELECT doc_id, count(*) AS kept FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0 GROUP BY doc_id""")
def drop_blank_rows(spark, sf):
    rows = document_lines(table(spark, sf, "documents")).where(F.contains("line", F.lit("|"))).select("doc_id", F.split("line", "\\|").alias("cells"))
    filled = rows.groupBy("doc_id").agg(F.size(C.filled_rows(F.collect_list("cells"))).cast("long").alias("kept"))
    return filled.where("kept > 0")


@query(f"""WITH {BLOCKS} SELECT id, CAST(page AS VARCHAR) AS page_number, CASE WHEN kind = 'table' THEN 'row ' || ord ELSE CAST(ord AS VARCHAR) END AS place, CASE kind WHEN 'table' THEN 'yes' END AS is_table FROM blocks""")
def block_dict(spark, sf):
    extra = F.when(F.col("kind") == "table", F.create_map(F.lit("order"), F.concat(F.lit("row "), F.col("ord")), F.lit("is_table"), F.lit("yes")))
    made = blocks(spark, sf).select("id", tables.block_dict({"page_number": F.col("page"), "order": F.col("ord")}, extra).alias("m"))
    return made.select("id", F.expr("m['page_number']").alias("page_number"), F.expr("m['order']").alias("place"), F.expr("m['is_table']").alias("is_table"))


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.pdf' OR page_id % 5 = 0")
def filter_mime(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    return pages.where(files.mime(path) == files.TYPES["pdf"]).select("page_id", "url")


@query(f"""WITH {BLOCKS} SELECT doc_id, ord, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, page, CASE kind WHEN 'table' THEN 1 ELSE 0 END) - 1 AS INTEGER) AS place FROM blocks""")
def ordered_scan(spark, sf):
    rank = F.when(F.col("kind") == "table", 1).otherwise(0)
    return B.running_ordinal(blocks(spark, sf), ["doc_id"], ["ord", "page", rank], "place").select("doc_id", "ord", "id", "place")


@query("SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN p_size ELSE 1 END AS INTEGER) AS level FROM part")
def heading_level(spark, sf):
    style = F.when(F.col("p_size") % 3 == 0, "Heading").when(F.col("p_size") % 3 == 1, F.concat(F.lit("Heading "), "p_size")).otherwise(F.concat(F.lit("Heading "), "p_size", F.lit(" Char")))
    return table(spark, sf, "part").select("p_partkey", enrich.heading_level(style).alias("level"))


@query(f"""WITH {LINES} SELECT 'doc:' || doc_id AS src, 'native' AS method, count(*) AS n FROM lines GROUP BY doc_id
UNION ALL SELECT 'page:' || page_id, 'image_ocr', 1 FROM pages WHERE trim(regexp_replace(html, '<[^>]*>', '', 'g')) <> ''""")
def ocr_union(spark, sf):
    native = document_lines(table(spark, sf, "documents")).select(F.concat(F.lit("doc:"), "doc_id").alias("src"), F.col("ord").alias("nth"))
    read = table(spark, sf, "pages").where(F.trim(F.regexp_replace("html", "<[^>]*>", "")) != "").select(F.concat(F.lit("page:"), "page_id").alias("src"), F.lit(0).alias("nth"))
    both = B.append_read(native, read)
    return both.groupBy("src", F.when(F.col("appended"), "image_ocr").otherwise("native").alias("method")).agg(F.count("*").alias("n"))


@query(f"""WITH {TABLES}, c AS (SELECT tbl, unnest(cells) AS cell, generate_subscripts(cells, 1) AS i FROM rows),
t AS (SELECT tbl, i, CASE WHEN count(*) FILTER (WHERE cell <> '') = 0 THEN 'text' WHEN {_share(DATE_SQL)} THEN 'date' WHEN {_share(NUMBER_SQL)} THEN 'number' WHEN {_share(BOOL_SQL)} THEN 'boolean' ELSE 'text' END AS kind FROM c GROUP BY tbl, i)
SELECT tbl, k AS column_types, CAST(n AS VARCHAR) AS row_count, '5' AS column_count, 'true' AS normalized, 'orders' AS source, total FROM (SELECT tbl, string_agg(kind, ',' ORDER BY i) AS k FROM t GROUP BY tbl)
JOIN (SELECT tbl, count(*) AS n, round(sum(CAST(replace(cells[3], ',', '.') AS DOUBLE)), 2) AS total FROM rows GROUP BY tbl) USING (tbl)""")
def normalize_tables(spark, sf):
    """F10 as one function, with what it adds to the metadata."""
    meta = F.create_map(F.lit("source"), F.lit("orders"), F.lit("normalized"), F.lit("no"))
    made = table_rows(spark, sf).select("tbl", tables.normalize(F.col("headers"), F.col("rows"), meta).alias("t"))
    added = [F.element_at("t.metadata", F.lit(k)).alias(k) for k in ("column_types", "row_count", "column_count", "normalized", "source")]
    return made.select("tbl", *added, F.round(F.aggregate("t.rows", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(2))["num"]), 2).alias("total"))


from . import learnt, mixed, stored  # noqa: E402, F401  register queries over mixed blocks, stored data, changes, and what is learnt
