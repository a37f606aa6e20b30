"""Queries over mixed blocks: their order with ties, merged readings, and the whole extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import markdown
from . import extraction
from .queries import BLOCKS, LABEL, SPLIT, blocks, query, table


def ties(spark, sf):
    """Blocks with counters per kind, so that texts, tables and images share orders: lines, two images a document, and the text read from one of them."""
    rows = blocks(spark, sf).withColumn("list", F.when(F.col("kind") == "table", "table").otherwise("text"))
    rows = B.running_ordinal(rows, ["doc_id", "list"], ["ord"], "nth").withColumn("ord", F.expr("cast(nth % 3 as int)")).withColumn("nth", F.col("nth").cast("long"))
    none = F.lit(None)
    texts = rows.where("list = 'text'").select("doc_id", "ord", F.expr("CASE WHEN nth % 2 = 0 THEN page END").alias("page"), "nth", F.col("line").alias("text"), F.when(F.col("kind") == "heading", 1).alias("section_level"), none.cast("array<string>").alias("entities"), F.lit(0.5).alias("confidence"))
    grids = rows.where("list = 'table'").select("doc_id", "ord", "page", "nth", F.array().cast("array<string>").alias("headers"), F.array(F.split("line", "\\|")).alias("rows"))
    seen = table(spark, sf, "documents").select("doc_id", F.posexplode(F.array(F.lit(0), F.lit(1))).alias("nth", "ord"), "source").withColumns({"page": F.expr("CASE WHEN nth = 0 THEN 0 ELSE 1 END"), "image_path": F.concat(F.lit("img/"), "source", F.lit("/"), "nth")})
    seen = seen.withColumns({"ocr_text": F.when(F.col("nth") == 1, F.concat(F.lit("read "), "source")), "metadata": none.cast("map<string,string>"), "nth": F.col("nth").cast("long")})
    read = seen.where("ocr_text IS NOT NULL").select("doc_id", "ord", "page", "nth", F.col("ocr_text").alias("text"), none.cast("int").alias("section_level"), none.cast("array<string>").alias("entities"), F.lit(0.9).alias("confidence"))
    both = B.append_read(texts, read).drop("appended")
    made = B.union_contents(both, grids, seen.drop("source"), "doc_id")
    return made.withColumn("id", F.concat_ws(":", "doc_id", B.kind_rank(F.col("kind")), "nth"))


TIES = BLOCKS + r""", l AS (SELECT *, CASE WHEN kind = 'table' THEN 1 ELSE 0 END AS r, row_number() OVER (PARTITION BY doc_id, kind = 'table' ORDER BY ord) - 1 AS nth FROM blocks),
u AS (SELECT doc_id, CASE WHEN r = 1 THEN 'table' WHEN kind = 'heading' THEN 'heading' ELSE 'text' END AS kind, r, nth, nth % 3 AS o, CASE WHEN r = 1 OR nth % 2 = 0 THEN page END AS p, line, NULL AS path, NULL AS ocr FROM l
UNION ALL SELECT doc_id, 'image', 2, i, i, i, NULL, 'img/' || source || '/' || i, CASE WHEN i = 1 THEN 'read ' || source END FROM documents, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT doc_id, 'text', 0, 1 + 1099511627776, 1, 1, 'read ' || source, NULL, NULL FROM documents WHERE source IS NOT NULL),
ties AS (SELECT *, doc_id || ':' || r || ':' || nth AS id FROM u)"""


@query(f"WITH {TIES} SELECT id, kind, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM ties WINDOW w AS (PARTITION BY doc_id ORDER BY o, coalesce(p, 0), r, nth)")
def mixed_links(spark, sf):
    """The one order of mixed blocks, with ties of every kind and texts appended from images."""
    return B.link(ties(spark, sf), "doc_id").select("id", "kind", "prev_id", "next_id")


@query(f"""WITH {TIES}, m AS (SELECT doc_id, o, coalesce(p, 0) AS p, r, nth, CASE kind WHEN 'heading' THEN '# ' || line WHEN 'text' THEN line
  WHEN 'table' THEN '| ' || replace(line, '|', ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(string_split(line, '|'), lambda x: '---'), ' | ') || ' |'
  ELSE '![image' || CASE WHEN coalesce(ocr, '') <> '' THEN ' - ' || ocr ELSE '' END || ']' || CASE WHEN path IS NULL THEN '' ELSE '(' || path || ')' END || CASE WHEN coalesce(ocr, '') <> '' THEN chr(10) || '> ' || ocr ELSE '' END END AS md FROM ties)
SELECT doc_id, string_agg(md || chr(10), chr(10) ORDER BY p, o, r, nth) AS markdown FROM m WHERE md IS NOT NULL GROUP BY doc_id""")
def mixed_markdown(spark, sf):
    """The same blocks as Markdown, page before order, with the same ties."""
    none = F.lit(None).cast("int")
    made = ties(spark, sf)
    line = markdown.block_line(F.col("kind"), F.col("content.text"), F.when(F.col("kind") == "heading", 1), F.col("content.headers"), F.col("content.rows"), F.col("content.image_path"), F.col("content.ocr_text"), none, none)
    return markdown.render(made.withColumn("line", line), "doc_id")


def _readings(spark, sf):
    """Two readings of each document: the lines of two pages of three each, with tables, images, outline and properties of their own."""
    rows = blocks(spark, sf).select(F.col("doc_id").cast("string").alias("doc"), "kind", "ord", "page", F.col("line").alias("text"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "lang", "source", "n_chars")

    def reading(name, low, places):
        own = rows.where(f"page % 3 <> {low}").select(*extraction.stream(**{c: F.col(c) for c in ("doc", "kind", "ord", "page", "text")}, nth=F.col("ord")))
        image = docs.select(*extraction.stream(doc=F.col("doc"), kind=F.lit("image"), ord=F.lit(0), nth=F.lit(0), text=F.lit(name)))
        outline = docs.select(*extraction.stream(doc=F.col("doc"), kind=F.lit("structure"), ord=F.lit(0), nth=F.lit(0), text=F.concat(F.lit(name), F.lit(" outline"))))
        about = docs.select(*extraction.stream(doc=F.col("doc"), kind=F.lit("properties"), ord=F.lit(0), nth=F.lit(0), properties=places))
        return own.unionByName(image).unionByName(outline).unionByName(about)

    pair = lambda *xs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    first = reading("a", 0, pair("lang", F.col("lang"), "reader", F.lit("first"), "n_chars", F.col("n_chars").cast("string")))
    return first, reading("b", 1, pair("reader", F.lit("second"), "source", F.coalesce("source", F.lit(""))))


@query(f"""WITH {BLOCKS}, a AS (SELECT * FROM blocks WHERE page % 3 <> 0), b AS (SELECT * FROM blocks WHERE page % 3 <> 1),
t AS (SELECT *, 1 AS s FROM a WHERE kind <> 'table' UNION ALL SELECT *, 0 FROM b WHERE kind <> 'table'), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY s, ord) AS n FROM t)
SELECT doc_id, kind, ord, page, line AS text, s AS source_rank, NULL AS properties FROM n WHERE n = 1 UNION ALL SELECT doc_id, kind, ord, page, line, 1, NULL FROM a WHERE kind = 'table'
UNION ALL SELECT doc_id, 'image', 0, NULL, 'b', 0, NULL FROM documents UNION ALL SELECT doc_id, 'structure', 0, NULL, 'b outline', 0, NULL FROM documents
UNION ALL SELECT doc_id, 'properties', 0, NULL, NULL, 1, 'lang=' || lang || ',n_chars=' || n_chars || ',reader=second,source=' || coalesce(source, '') FROM documents""")
def merge_results(spark, sf):
    """Texts by page, tables of one reading, images and outline of the other, metadata of both."""
    made = B.merge_results(*_readings(spark, sf), "doc")
    about = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return made.select(F.col("doc").cast("long").alias("doc_id"), "kind", "ord", "page", "text", "source_rank", about.alias("properties"))


def sources(spark, sf):
    """Texts, pages and images of documents in one stream of blocks."""
    docs = table(spark, sf, "documents")
    shown = F.struct(*(F.lit({"width": 4, "height": 3}.get(n)).cast(k).alias(n) if n not in ("path", "ocr_text") else (F.concat(F.lit("img/"), "source") if n == "path" else F.when(F.col("doc_id") % 2 == 0, " Read Here In 1999 ")).alias(n) for n, k in (x.split(":") for x in extraction.IMAGE[7:-1].split(","))))
    images = docs.select(*extraction.stream(doc=F.concat(F.lit("d"), "doc_id"), kind=F.lit("image"), ord=F.lit(0), page=F.lit(1), nth=F.lit(0), image=shown))
    about = docs.select(*extraction.stream(doc=F.concat(F.lit("d"), "doc_id"), kind=F.lit("properties"), ord=F.lit(0), nth=F.lit(0), properties=F.create_map(F.lit("lang"), F.col("lang"))))
    texts = extraction.text_blocks(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    pages = extraction.page_blocks(table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("page_id"), "html"))
    return texts.unionByName(pages).unionByName(images).unionByName(about)


_T_LABELS = f"list_filter(list_transform(string_split_regex(line, '[ \\n]'), lambda t: {LABEL}), lambda x: x IS NOT NULL)"
EXTRACTED = BLOCKS + rf""", l AS (SELECT 'd' || doc_id AS doc, CASE WHEN kind = 'table' THEN 1 ELSE 0 END AS r, kind, page, line, row_number() OVER (PARTITION BY doc_id, kind = 'table' ORDER BY ord) - 1 AS nth FROM blocks),
h AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g') AS html FROM pages),
s AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>', 1))) AS tag, unnest(regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>', 2)) AS body,
  generate_subscripts(regexp_extract_all(html, '(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</(?:h[1-6]|p|li)>', 1), 1) AS i FROM h),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM s),
u AS (SELECT doc, r, CASE WHEN r = 1 THEN 'table' WHEN kind = 'heading' THEN 'heading' ELSE 'text' END AS kind, nth AS o, page, nth, CASE WHEN r = 0 THEN line ELSE '' END AS line FROM l
UNION ALL SELECT 'p' || page_id, 0, CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 'heading' ELSE 'text' END, row_number() OVER w - 1, NULL, row_number() OVER w - 1, line FROM q WHERE line <> '' WINDOW w AS (PARTITION BY page_id ORDER BY i)
UNION ALL SELECT 'd' || doc_id, 2, 'image', 0, 1, 0, '' FROM documents UNION ALL SELECT 'd' || doc_id, 0, 'text', 0, 1, 1099511627776, 'Read Here In 1999' FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT *, doc || ':' || r || ':' || nth AS id, {_T_LABELS} AS labels, CASE WHEN r = 0 THEN {SPLIT.format("line")} END AS tokens FROM u),
k AS (SELECT *, len(list_filter(labels, lambda x: x IN ('PERSON', 'DATE'))) AS strong, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, sum(CASE kind WHEN 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY o, coalesce(page, 0), r, nth ROWS UNBOUNDED PRECEDING) AS sec
  FROM e WINDOW w AS (PARTITION BY doc ORDER BY o, coalesce(page, 0), r, nth)),
p AS (SELECT doc, line, min(struct_pack(o := o, p := coalesce(page, 0), nth := nth, id := id)).id AS parent_id FROM k WHERE kind = 'heading' GROUP BY doc, line),
c AS (SELECT k.doc, string_agg(concat_ws('|', k.id, kind, coalesce(CAST(page AS VARCHAR), '-'), coalesce(prev_id, '-'), coalesce(next_id, '-'), coalesce(parent_id, '-')), ',' ORDER BY o, coalesce(page, 0), r, nth) AS content, count(*) AS n, sum(len(labels)) AS ents, sum(tokens) AS tokens,
  round(sum(CASE WHEN r = 0 THEN CASE WHEN tokens = 0 THEN 0 ELSE least(1.0, 0.5 * len(labels) / greatest(tokens, 1) + 0.5 * strong / greatest(len(labels), 1)) END END), 4) AS score, count(DISTINCT page) AS pages, coalesce(string_agg(k.id, ',' ORDER BY o, coalesce(page, 0), r, nth) FILTER (WHERE sec = 0), '') AS orphans
  FROM k LEFT JOIN p ON k.doc = p.doc AND kind = 'heading' AND k.line = p.line GROUP BY k.doc),
g AS (SELECT doc, string_agg(x, ';' ORDER BY sec) AS sections FROM (SELECT doc, sec, max(line) FILTER (WHERE kind = 'heading') || '=' || string_agg(id, ',' ORDER BY o, coalesce(page, 0), r, nth) AS x FROM k WHERE sec > 0 GROUP BY doc, sec) GROUP BY doc),
n AS (SELECT doc, string_agg(x, ';' ORDER BY label) AS by_entity FROM (SELECT doc, label, label || '=' || string_agg(id, ',' ORDER BY o, p, r, nth) AS x FROM (SELECT doc, o, coalesce(page, 0) AS p, r, nth, id, unnest(labels) AS label FROM k) GROUP BY doc, label) GROUP BY doc),
d AS (SELECT 'd' || doc_id AS doc, lang FROM documents UNION ALL SELECT 'p' || page_id, NULL FROM pages)
SELECT d.doc AS doc, d.lang AS lang, coalesce(content, '') AS content, coalesce(sections, '') AS sections, coalesce(orphans, '') AS orphans, coalesce(by_entity, '') AS by_entity, CAST(coalesce(n, 0) AS INTEGER) AS total_blocks, CAST(coalesce(ents, 0) AS INTEGER) AS total_entities,
  CAST(coalesce(pages, 0) AS INTEGER) AS total_pages, CAST(coalesce(tokens, 0) AS INTEGER) AS tokens, CAST(coalesce(score, 0) AS DOUBLE) AS score, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status FROM d LEFT JOIN c USING (doc) LEFT JOIN g USING (doc) LEFT JOIN n USING (doc)"""


@query(f"WITH {EXTRACTED}")
def extracted_documents(spark, sf):
    """C6, A13 over texts, pages, tables and images in one stream, flattened for comparison."""
    found = extraction.extract_documents(sources(spark, sf))
    block = lambda x: F.concat_ws("|", x["id"], x["kind"], *(F.coalesce(c.cast("string"), F.lit("-")) for c in (x["page"], x["prev_id"], x["next_id"], x["parent_id"])))
    named = lambda pairs: F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["a"], F.array_join(e["b"], ","))), ";")
    total = lambda f, start: F.aggregate("content_blocks", start, lambda s, x: s + F.coalesce(x[f], start))
    return found.select(
        "doc", F.try_element_at("metadata", F.lit("lang")).alias("lang"), F.array_join(F.transform("content_blocks", block), ",").alias("content"), named(F.transform("sections", lambda x: F.struct(x["title"].alias("a"), x["block_ids"].alias("b")))).alias("sections"),
        F.array_join("orphan_blocks", ",").alias("orphans"), named(F.transform(F.map_keys("by_entity"), lambda k: F.struct(k.alias("a"), F.element_at("by_entity", k).alias("b")))).alias("by_entity"), "total_blocks", "total_entities", "total_pages",
        total("token_count", F.lit(0)).alias("tokens"), F.round(total("relevance_score", F.lit(0.0)), 4).alias("score"), "status",
    )
