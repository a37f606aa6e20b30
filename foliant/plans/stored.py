"""Queries over stored data and changes: JSON by path, replacement by document, pages by key, the life of documents, and office files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.workers import map_arrow
from ..operators import blocks as B
from ..sources import files
from ..streaming import ingest, lifecycle
from . import catalog, extraction
from .queries import BLOCKS, blocks, query, table

META = "CASE WHEN ord % 7 = 0 THEN concat('{\"page_number\": ', page) WHEN ord % 2 = 0 THEN concat('{\"page_number\": ', page, '}') ELSE concat('{\"page_number\": \"', page, '\"}') END"


@query(f"WITH {BLOCKS}, m AS (SELECT id, line, {META} AS meta FROM blocks) SELECT id, line FROM m WHERE json_extract_string(CASE WHEN json_valid(meta) THEN meta END, '$.page_number') = '2'")
def filter_page_path(spark, sf):
    """Pages by JSON path, numbers and texts alike; malformed metadata are on no page."""
    rows = blocks(spark, sf).select("id", "line", catalog.stored(F.expr(META)).alias("metadata"))
    return catalog.on_page(rows, "2").select("id", "line")


@query("""WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 1 THEN '{"k": ' WHEN 2 THEN NULL WHEN 3 THEN '{"k": "no", "s": true}' ELSE props END AS p FROM events), v AS (SELECT event_id, CASE WHEN json_valid(p) THEN p END AS p FROM m)
SELECT event_id, coalesce(json_type(p) = 'OBJECT', false) AS is_object, CASE WHEN json_type(p) = 'OBJECT' THEN TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k, CASE WHEN json_type(p) = 'OBJECT' THEN TRY_CAST(json_extract_string(p, '$.s') AS BOOLEAN) END AS s FROM v""")
def response_fields(spark, sf):
    """Typed fields of stored metadata; what is malformed, missing or no object gives none."""
    made = F.expr("""CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 1 THEN '{"k": ' WHEN 2 THEN NULL WHEN 3 THEN '{"k": "no", "s": true}' ELSE props END""")
    rows = table(spark, sf, "events").select("event_id", catalog.stored(made).alias("m"))
    return rows.select("event_id", catalog.is_object(F.col("m")).alias("is_object"), catalog.described(F.col("m"), {"k": "long", "s": "boolean"}).alias("d")).select("event_id", "is_object", "d.*")


@query(f"""WITH {BLOCKS}, o AS (SELECT nullif(doc_id % 10, 9) AS key, id, line FROM blocks), r AS (SELECT key, id, 'again ' || line AS line, ord FROM (SELECT nullif(doc_id % 10, 9) AS key, id, line, ord FROM blocks) WHERE key IN (4, 5) OR key IS NULL)
SELECT key, id, line FROM o WHERE key NOT IN (4, 5, 6) UNION ALL SELECT key, id, line FROM r WHERE ord < 2""")
def replace_documents(spark, sf):
    """T4: documents 4, 5, 6 and null are done again with fewer blocks, or none; no old ones stay."""
    old = blocks(spark, sf).select(F.expr("nullif(doc_id % 10, 9)").alias("key"), "id", "line", "ord")
    new = old.where("(key IN (4, 5) OR key IS NULL) AND ord < 2").withColumn("line", F.concat(F.lit("again "), "line"))
    redone = old.where("key IN (4, 5, 6) OR key IS NULL").select("key").distinct()
    return catalog.replace(old.drop("ord"), new.drop("ord"), "key", redone)


@query("""WITH o AS (SELECT nullif(o_orderkey, 7) AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey < 400), n AS (SELECT nullif(o_orderkey, 7) AS k, 'X' || o_custkey % 5 AS s, o_custkey AS c FROM orders WHERE o_orderkey < 200 UNION ALL SELECT nullif(o_orderkey, 7), 'A', o_custkey FROM orders WHERE o_orderkey < 300),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, c DESC) AS nth FROM n) SELECT k, s, c FROM r WHERE nth = 1 UNION ALL SELECT k, s, c FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k IS NOT DISTINCT FROM o.k)""")
def upsert_once(spark, sf):
    """Null is a key like any other, and of rows that share a key in one change one stays."""
    rows = table(spark, sf, "orders").select(F.expr("nullif(o_orderkey, 7)").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"), "o_orderkey")
    new = rows.where("o_orderkey < 200").withColumn("s", F.concat(F.lit("X"), F.col("c") % 5)).unionByName(rows.where("o_orderkey < 300").withColumn("s", F.lit("A")))
    return catalog.upsert(rows.where("o_orderkey < 400").drop("o_orderkey"), new.drop("o_orderkey"), "k")


@query("""WITH e AS (SELECT nullif(user_id % 40, 0) AS u, event_id FROM events) SELECT u, event_id, 'inner' AS page FROM (SELECT * FROM e WHERE u > 11 OR u IS NULL OR u = 11 AND event_id > 500 ORDER BY u NULLS LAST, event_id LIMIT 60)
UNION ALL SELECT u, event_id, 'first' FROM (SELECT * FROM e ORDER BY u NULLS LAST, event_id LIMIT 10) UNION ALL SELECT u, event_id, 'last' FROM (SELECT * FROM e WHERE u IS NULL AND event_id > 900 ORDER BY u NULLS LAST, event_id LIMIT 30)""")
def keyset_pages(spark, sf):
    """Pages behind a key, ties of the first key and null keys among them."""
    rows = table(spark, sf, "events").select(F.expr("nullif(user_id % 40, 0)").alias("u"), "event_id")
    page = lambda name, after, limit: catalog.page_after(rows, ["u", "event_id"], after, limit).withColumn("page", F.lit(name))
    return page("inner", (11, 500), 60).unionByName(page("first", None, 10)).unionByName(page("last", (None, 900), 30))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'start' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
p AS (SELECT *, coalesce(lag(action) OVER (PARTITION BY user_id ORDER BY i) = 'start', false) AS is_on FROM e), a AS (SELECT *, (action = 'start') <> is_on AS accepted, CASE action WHEN 'finish' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'extracting' END AS goal FROM p)
SELECT user_id AS document, event_id AS request, action, CASE WHEN accepted THEN goal WHEN is_on THEN 'extracting' ELSE coalesce(last_value(CASE WHEN accepted THEN goal END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'uploaded') END AS status,
 accepted, CASE WHEN accepted THEN NULL WHEN is_on THEN 'already extracting' ELSE 'not extracting' END AS reason FROM a""")
def life_cycle(spark, sf):
    """Events as requests, streamed through one state a document; runs may take as long as they like."""
    path = f"{sf}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", ingest.BYTES_PER_BATCH).parquet(lifecycle.stream_path(spark, path))
    action = F.when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "fail").otherwise("start")
    asked = source.select(F.col("user_id").alias("document"), F.col("event_id").alias("request"), action.alias("action"), F.col("ts").alias("at"))
    folder = lifecycle.shared_folder(spark, "life")
    lifecycle.run(lifecycle.answers(asked, patience=1 << 50), folder)
    return lifecycle.answered(spark, folder)


def office(docs, readers=("word", "excel")):
    """(path, reader, length, content), of the readers asked for: each text as a word document (its first line a heading) and, of lines with a pipe, as a workbook; every 50th is cut short."""

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    def word(lines: list[str]) -> bytes:
        para = lambda i, x: f'<w:p>{"<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>" if i == 0 else ""}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>'
        return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{"".join(para(i, x) for i, x in enumerate(lines))}</w:body></w:document>'})

    def book(rows: list[list[str]]) -> bytes:
        cell = lambda x: f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'
        return zipped({"xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{''.join(f'<row>{"".join(map(cell, r))}</row>' for r in rows)}</sheetData></worksheet>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clean = "".join(c for c in text if c in "\n\t" or c >= " ")
                lines = clean.split("\n")
                if "word" in readers:
                    made = word(lines)
                    out.append((f"{doc}.docx", "word", made[: len(made) // 2] if doc % 50 == 7 else made))
                if "excel" in readers:
                    out.append((f"{doc}.xlsx", "excel", book([x.split("|") for x in lines if "|" in x])))
            yield pa.record_batch([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([len(x[2]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["path", "reader", "length", "content"])

    return map_arrow(docs.select("doc_id", "text").where("text IS NOT NULL"), run, "path string, reader string, length long, content binary")


@query(f"""WITH {BLOCKS}, d AS (SELECT doc_id, i, regexp_replace(regexp_replace(l, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS line, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
w AS (SELECT doc_id || '.docx' AS path, 'text' AS kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, line AS text, CAST(CASE WHEN i = 1 THEN 1 END AS INTEGER) AS level, last_value(CASE WHEN i = 1 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS title, CAST(NULL AS VARCHAR) AS cells FROM d WHERE line <> '' AND doc_id % 50 <> 7),
c AS (SELECT doc_id, i, list_transform(string_split(regexp_replace(l, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS r FROM d WHERE contains(l, '|')),
x AS (SELECT doc_id || '.xlsx', 'table', 0, NULL, NULL, NULL, string_agg(array_to_string(r, '|'), chr(10) ORDER BY i) FROM c WHERE len(list_filter(r, lambda x: x <> '')) > 0 GROUP BY doc_id)
SELECT * FROM w UNION ALL SELECT * FROM x UNION ALL SELECT doc_id || '.docx', 'error', NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 7""")
def office_files(spark, sf):
    """Zipped office files made of the documents, read by the library's parsers; broken ones give a row with their error."""
    found = files.extract(office(table(spark, sf, "documents")))
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n")
    return found.select("path", "kind", "ord", "text", "level", "title", F.when(F.col("kind") == "table", cells).alias("cells"))


@query(f"""WITH {BLOCKS}, b AS (SELECT doc_id, string_agg(id, ',' ORDER BY ord) FILTER (WHERE kind <> 'table') AS text_blocks, string_agg(id, ',' ORDER BY ord) FILTER (WHERE kind = 'table') AS tables FROM blocks GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(text_blocks, '') AS text_blocks, coalesce(tables, '') AS tables, '' AS images, l.quality FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def data_lists(spark, sf):
    """Documents with their data and their blocks in three ordered lists."""
    rows = blocks(spark, sf).withColumn("nth", F.col("ord").cast("long"))
    made = catalog.data_of(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), rows, "doc_id", ["id", "line"], ["quality"])
    return made.select("doc_id", "source", *(F.array_join(F.transform(n, lambda x: x["id"]), ",").alias(n) for n in ("text_blocks", "tables", "images")), "quality")


@query(f"""WITH {BLOCKS}, w AS (SELECT * FROM blocks WHERE doc_id % 50 <> 7) SELECT CAST(doc_id AS VARCHAR) || '.docx' AS doc, CAST(count(*) AS INTEGER) AS total_blocks, 'completed' AS status, false AS broken FROM w GROUP BY doc_id
UNION ALL SELECT doc_id || '.docx', 0, 'failed', doc_id % 50 = 7 FROM documents WHERE doc_id % 50 = 7""")
def extracted_files(spark, sf):
    """C6 from files: word documents through parser, enrichment and structure to one row each; a broken one fails with its error."""
    made = office(table(spark, sf, "documents"), ["word"])
    found = extraction.extract_documents(extraction.file_blocks(files.extract(made)))
    return found.select("doc", "total_blocks", "status", F.col("error").isNotNull().alias("broken"))


@query(f"""WITH {BLOCKS}, b AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(count(DISTINCT page) AS INTEGER) AS pages FROM blocks GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc, coalesce(n, 0) AS total_blocks, coalesce(pages, 0) AS total_pages, CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END AS status FROM documents LEFT JOIN b USING (doc_id)""")
def ingested_documents(spark, sf):
    """Files of documents streamed in bounded batches, each extracted as a whole, the newest state of every document kept."""
    path = f"{sf}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", ingest.BYTES_PER_BATCH).parquet(lifecycle.stream_path(spark, path))
    whole = lambda docs: extraction.extract_documents(extraction.text_blocks(docs)).select("doc", "total_blocks", "total_pages", "status")
    folder = lifecycle.shared_folder(spark, "ingested")
    ingest.ingest(source, f"{folder}/rows", f"{folder}/checkpoint", "doc", whole).awaitTermination()
    return ingest.latest(spark, f"{folder}/rows", "doc")
