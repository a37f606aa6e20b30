"""Order of mixed blocks, merged readings, the whole extraction, the block source, the document sink, and changes to stored data."""

import io
import random
import zipfile

import pytest
from foliant.operators import blocks as B
from foliant.operators import markdown
from foliant.plans import catalog, extraction
from foliant.sources import blob_store, block_source, document_sink, files
from foliant.streaming import ingest, lifecycle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCKS = "doc int, kind string, page int, ord int, nth long, id string"


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def linked(spark, rows):
    random.Random(4).shuffle(rows)
    found = {r["id"]: r for r in B.link(spark.createDataFrame(rows, BLOCKS).repartition(3), "doc").collect()}
    at = next(k for k, r in found.items() if r["prev_id"] is None)
    out = [at]
    while found[at]["next_id"]:
        assert found[found[at]["next_id"]]["prev_id"] == at
        at = found[at]["next_id"]
        out.append(at)
    assert len(out) == len(rows)
    return out


# ---- one order of mixed blocks


def test_mixed_blocks_have_one_order(spark):
    assert linked(spark, [(1, "text", 1, 0, 0, "text0"), (1, "text", 1, 1, 1, "text1"), (1, "table", 1, 0, 0, "table0")]) == ["text0", "table0", "text1"]
    same = [(1, "image", 1, 0, 0, "image"), (1, "text", 1, 0, 0, "text"), (1, "table", 1, 0, 0, "table"), (1, "heading", 1, 0, 1, "heading"), (1, "text", 1, 0, B.APPENDED, "read"), (1, "text", None, 0, 2, "no page"), (1, "table", 2, 0, 1, "page 2"), (1, "image", 1, None, 1, "no order")]
    expected = ["no page", "text", "heading", "read", "table", "image", "no order", "page 2"]
    assert linked(spark, same) == expected  # a missing order is 0, a missing page stands before page 1


def test_markdown_breaks_ties_by_kind_and_place(spark):
    rows = [(1, "image", 1, 0, 0, "a image"), (1, "text", 1, 0, 1, "c text"), (1, "table", 1, 0, 0, "b table"), (1, "text", 1, 0, 0, "d text"), (1, "text", None, 9, 2, "z first")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, BLOCKS).withColumnRenamed("id", "line").repartition(4)
        assert markdown.render(frame, "doc").first()["markdown"] == "z first\n\nd text\n\nc text\n\nb table\n\na image\n"


def test_texts_of_images_stand_behind_own_ones(spark):
    own, read = spark.createDataFrame([(1, 0), (1, 7)], "doc int, nth int"), spark.createDataFrame([(1, 0), (1, 1)], "doc int, nth int")
    both = B.append_read(own, read)
    assert [(r["appended"], r["nth"] % B.APPENDED) for r in both.orderBy("nth").collect()] == [(False, 0), (False, 7), (True, 0), (True, 1)]
    assert "Exchange" not in plan(both)


def test_merged_texts_are_numbered_by_page(spark):
    rows = lambda xs: spark.createDataFrame(xs, "doc int, page int, ord int, line string")
    made = B.merge_sources(rows([(1, 1, 0, "a1"), (1, 2, 1, "a2"), (1, None, 2, "a?"), (2, 0, 0, "x")]), rows([(1, 2, 0, "b2"), (1, 2, 1, "b2bis"), (1, 3, 2, "b3")]), "doc")
    assert [(r["nth"], r["page"], r["line"]) for r in made.orderBy("nth").collect()] == [(0, 1, "a1"), (1, 2, "b2"), (2, 3, "b3")]
    assert plan(made).count("Exchange hashpartitioning") + plan(made).count("Arguments: hashpartitioning") == 1


def test_whole_results_merge(spark):
    def reading(name, about):
        rows = [("d", k, p, i, i, f"{name}{k}{p}{i}", None) for i, (k, p) in enumerate([("text", 1), ("heading", 2), ("text", None), ("table", 1), ("image", 1), ("structure", None)])]
        return spark.createDataFrame([*rows, ("d", "properties", None, 0, 0, None, about)], "doc string, kind string, page int, ord int, nth long, text string, properties map<string,string>")

    second = reading("b", {"x": "2", "z": "3"}).where("NOT (kind = 'heading')")
    made = B.merge_results(reading("a", {"x": "1", "y": "1"}), second, "doc").collect()
    assert sorted(r["text"] for r in made if r["text"]) == ["aheading21", "atable13", "bimage14", "bstructureNone5", "btext10"]
    assert [r["properties"] for r in made if r["kind"] == "properties"] == [{"x": "2", "z": "3", "y": "1"}]
    empty = second.where("false")
    assert B.merge_results(empty, empty, "doc").count() == 0
    assert sorted(r["kind"] for r in B.merge_results(reading("a", None), empty, "doc").collect()) == ["heading", "properties", "table", "text"]


# ---- the whole extraction


def docx(paragraphs, style="Heading1"):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if h else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, h in paragraphs)
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in (["nom", "prix"], ["a", "1,5"], ["b", "2"], ["", ""])) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}{table}</w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:title>Report</d:title><d:creator>M. Dupont</d:creator></c>')
    return out.getvalue()


def test_files_texts_and_pages_in_one_plan(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Intro", True), ("Paul Martin came in 1999.", False), ("Next", True), ("more", False)]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "none.docx").write_bytes(b"")
    block_source.register(spark)
    made = extraction.file_blocks(spark.read.format("blocks").load(str(tmp_path)))
    texts = extraction.text_blocks(spark.createDataFrame([(1, "TITLE\nsome text\na | b"), (2, None), (3, " \n ")], "doc_id long, text string"))
    html = "<h1>Head</h1><script>var x='<p>no</p>'</script><p>One <b>two</b></p><table><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>oui</td></tr></table><img src='i.png' alt='Seen In 1999'><h5>deep</h5>"
    pages = extraction.page_blocks(spark.createDataFrame([(7, html), (8, None)], "page_id long, html string"))
    found = extraction.extract_documents(made.unionByName(texts).unionByName(pages))
    explained = plan(found)
    assert explained.count("Arguments: hashpartitioning(doc") == 1 and explained.count("hashpartitioning") == 1
    rows = {r["doc"].rpartition("/")[2]: r for r in found.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a.docx": "completed", "bad.docx": "failed", "none.docx": "failed", "1": "completed", "2": "failed", "3": "failed", "7": "completed", "8": "failed"}
    a = rows["a.docx"]
    assert a["metadata"] == {"title": "Report", "author": "M. Dupont"} and rows["none.docx"]["error"] == "empty" and rows["bad.docx"]["error"].startswith("BadZipFile")
    assert [(b["kind"], b["text"]) for b in a["content_blocks"]] == [("heading", "Intro"), ("table", ""), ("text", "Paul Martin came in 1999."), ("heading", "Next"), ("text", "more")]
    ids = [b["id"] for b in a["content_blocks"]]
    assert [b["prev_id"] for b in a["content_blocks"]] == [None, *ids[:-1]] and [b["next_id"] for b in a["content_blocks"]] == [*ids[1:], None]
    assert [b["parent_id"] for b in a["content_blocks"]] == [ids[0], None, ids[0], ids[3], ids[3]]  # by the title of the section
    table = a["content_blocks"][1]
    assert table["headers"] == ["nom", "prix"] and table["types"] == ["text", "number"] and [r[1]["num"] for r in table["rows"]] == [1.5, 2.0]
    text = a["content_blocks"][2]
    assert [e["label"] for e in text["entities"]] == ["PERSON", "PERSON", "DATE"] and text["token_count"] == 5 and 0 < text["relevance_score"] <= 1 and a["by_entity"] == {"PERSON": [ids[0], ids[2], ids[2], ids[3]], "DATE": [ids[2]]}
    page = rows["7"]
    assert [(b["kind"], b["text"]) for b in page["content_blocks"]] == [("heading", "Head"), ("text", "Seen In 1999"), ("table", ""), ("image", ""), ("text", "One two"), ("text", "deep")]
    assert page["content_blocks"][2]["types"] == ["text", "boolean"] and page["n_image"] == 1
    assert [s["title"] for s in rows["1"]["sections"]] == ["TITLE"] and rows["1"]["by_page"][1][0] == "1:0:0"


def test_extraction_keeps_very_long_documents_and_repeated_blocks(spark):
    rows = spark.createDataFrame([(1, "Some words here\n" * 3000)], "doc_id long, text string")
    row = extraction.extract_documents(extraction.text_blocks(rows)).first()
    assert row["total_blocks"] == 3000 and row["total_pages"] == 150 and row["content_blocks"][2999]["prev_id"] == "1:0:2998"
    assert extraction.extract_documents(extraction.text_blocks(rows.where("false"))).count() == 0


# ---- the block source


def test_block_source_pushes_filters_and_cuts_by_bytes(spark, tmp_path):
    block_source.register(spark)
    for i in range(40):
        folder = tmp_path / f"part {i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.docx").write_bytes(docx([(f"text {i}", False)]))
    big = tmp_path / "big"
    big.mkdir()
    (big / "large.docx").write_bytes(docx([(f"line {i}", False) for i in range(60_000)]))
    (big / "empty.xlsx").write_bytes(b"")
    (big / "other.zip").write_bytes(b"x")
    (big / "scan.png").write_bytes(b"x")
    read = lambda **o: spark.read.format("blocks").options(**o).load(str(tmp_path))
    frame = read()
    assert [f.name for f in frame.schema.fields[:-2]] == [f.name for f in StructType.fromDDL(files.BLOCKS).fields]
    got = {r["path"].rpartition("/")[2]: r["n"] for r in frame.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 44 and got["large.docx"] == 60_002 and got["empty.xlsx"] == 1
    errors = {r["path"].rpartition("/")[2]: r["error"] for r in frame.where("kind = 'error'").collect()}
    assert errors == {"empty.xlsx": "empty", "other.zip": "not supported", "scan.png": "not supported"}
    cut = read(partitionBytes=str(400_000))  # each file counts 64 KB for its opening
    assert cut.rdd.getNumPartitions() >= 7 and cut.where("kind = 'text'").count() == 60_040
    some = read().where("reader = 'word' AND length < 5000 AND path LIKE '%part 1%' AND kind = 'text'")
    explained = plan(some)
    assert "PushedFilters: [" in explained and all(x in explained.split("PushedFilters")[1][:400] for x in ("reader", "length", "path"))
    assert some.count() == 13
    top = read().filter(F.col("path").startswith(f"file:{tmp_path}/part 2/"))
    assert top.select("path").distinct().count() == 13
    assert read(parse="false").count() == 44 and {r["kind"] for r in read(parse="false").select("kind").distinct().collect()} == {"file"}
    assert spark.read.format("blocks").load(str(big)).where("path = 'nowhere'").count() == 0


class LogSource(block_source.BlockSource):
    parsers = {"log": lambda data: ({"kind": "text", "ord": i, "text": x} for i, x in enumerate(data.decode().split("\n")))}
    readers = {"log": "log"}

    @classmethod
    def name(cls):
        return "logs"


def test_a_format_of_your_own_is_a_subclass(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    block_source.register(spark, LogSource)
    assert sorted(r["text"] for r in spark.read.format("logs").load(str(tmp_path)).collect()) == ["one", "two"]


# ---- the document sink


def test_a_thousand_documents_are_a_thousand_files(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("doc"), F.concat(F.lit("f"), (F.col("id") % 990).cast("string"), F.lit(".v1.pdf")).alias("name"), F.concat(F.lit("# "), "id").alias("markdown")).repartition(7)
    folder = tmp_path / "out"
    for _ in range(2):  # a rerun leaves the same files
        document_sink.save_documents(rows, str(folder), "name", "doc")
        names = {p.name for p in folder.iterdir()}
        assert len(names) == 1000 and {"f3.v1.md", "f3.v1~2.md", "f989.v1.md"} <= names
    assert (folder / "f3.v1~2.md").read_text() == "# 993" and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_a_failed_task_leaves_no_files_and_the_old_ones(spark, tmp_path):
    document_sink.register(spark)
    good = spark.createDataFrame([("old", "text")], "stem string, text string")
    good.write.format("documents").mode("overwrite").save(str(tmp_path / "out"))
    bad = spark.range(200).selectExpr("CASE WHEN id = 150 THEN 'a/b' ELSE concat('s', id) END AS stem", "'x' AS text").repartition(4)
    with pytest.raises(Exception, match="a stem names a file"):
        bad.write.format("documents").mode("overwrite").save(str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and [p.name for p in (tmp_path / "out").iterdir()] == ["old.md"]
    stems = [(None,), ("",), (".pdf",), ("a.b.pdf",), ("dir/x~1.doc",)]
    assert [r["s"] for r in spark.createDataFrame(stems, "n string").select(document_sink.stem(F.col("n")).alias("s")).collect()] == ["document", "document", ".pdf", "a.b", "dir_x_1"]


# ---- the life of documents


def ask(spark, folder, rows):
    spark.createDataFrame(rows, "document long, request long, action string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)


def test_two_requests_at_once_give_one_run_and_one_refusal(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        asked = spark.readStream.schema("document long, request long, action string, at timestamp").parquet(source)
        lifecycle.run(lifecycle.answers(asked, patience=60_000), out)
        return {(r["document"], r["request"], r["action"]): (r["status"], r["accepted"], r["reason"]) for r in lifecycle.answered(spark, out).collect()}

    ask(spark, source, [(1, 10, "start", "2024-01-01 00:00:00"), (1, 11, "start", "2024-01-01 00:00:00"), (2, 20, "finish", "2024-01-01 00:00:00"), (3, 30, "start", "2024-01-01 00:00:00")])
    got = go()
    assert got == {(1, 10, "start"): ("extracting", True, None), (1, 11, "start"): ("extracting", False, "already extracting"), (2, 20, "finish"): ("uploaded", False, "not extracting"), (3, 30, "start"): ("extracting", True, None)}
    # the state outlives the query: a restart refuses a second run, and lets the first one end
    ask(spark, source, [(1, 12, "start", "2024-01-01 00:00:30"), (1, 10, "finish", "2024-01-01 00:00:40"), (1, 13, "start", "2024-01-01 00:00:50")])
    got = go()
    assert got[1, 12, "start"] == ("extracting", False, "already extracting") and got[1, 10, "finish"] == ("completed", True, None) and got[1, 13, "start"] == ("extracting", True, None)
    # time goes on for others: the runs that are stuck fail by their timers, and may begin again
    ask(spark, source, [(9, 90, "start", "2024-01-01 01:00:00")])
    go()
    ask(spark, source, [(3, 31, "start", "2024-01-01 01:00:10"), (9, 90, "fail", "2024-01-01 01:30:00")])
    got = go()
    assert got[3, 30, "fail"] == ("failed", True, "timed out") and got[1, 13, "fail"] == ("failed", True, "timed out") and got[3, 31, "start"] == ("extracting", True, None)
    assert got[9, 90, "fail"] == ("failed", False, "not extracting")  # its run was over its time when the request came
    before = lifecycle.answered(spark, out).count()
    assert go() and lifecycle.answered(spark, out).count() == before


# ---- changes to stored data


def test_a_rerun_with_fewer_blocks_leaves_no_old_ones(spark, tmp_path):
    folder, schema = str(tmp_path / "blocks"), "doc string, ord int, text string"
    rows = lambda xs: spark.createDataFrame(xs, schema)
    docs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "doc string")
    read = lambda: sorted(map(tuple, spark.read.parquet(folder).select("doc", "ord", "text").collect()), key=repr)
    first = [(d, i, f"{d}{i}") for d in ("a", "b", "c") for i in range(3)] + [(None, i, "n") for i in range(2)]
    catalog.reextract(rows(first), docs("a", "b", "c", None), folder, "doc", 4)
    assert read() == sorted(first, key=repr)
    again = [("a", 0, "new"), (None, 0, "new"), (None, 0, "new")]
    expected = sorted([*again, *(x for x in first if x[0] == "c")], key=repr)
    for _ in range(2):  # b was done again and has nothing now
        catalog.reextract(rows(again), docs("a", "b", None, "a"), folder, "doc", 4)
        assert read() == expected
    catalog.reextract(rows([]), docs("a", "c", None), folder, "doc", 4)
    assert spark.read.schema(schema).parquet(folder).count() == 0 and [p.name for p in tmp_path.iterdir()] == ["blocks"]


def test_upsert_takes_null_as_a_key_and_one_row_of_each(spark):
    old = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "k int, v string")
    new = spark.createDataFrame([(None, "b"), (1, "b"), (1, "c"), (3, None)], "k int, v string")
    once = catalog.upsert(old, new, "k")
    assert sorted(map(tuple, catalog.upsert(once, new, "k").collect()), key=repr) == sorted([(None, "b"), (1, "c"), (2, "a"), (3, None)], key=repr)


def test_pages_by_key_seek_and_cover_all(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(6)]), i) for i in range(500)]
    spark.createDataFrame(rows, "a int, b int").repartition(3).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    out, after = [], None
    while page := catalog.page_after(frame, ["a", "b"], after, 37).collect():
        out += [(r["a"], r["b"]) for r in page]
        after = out[-1]
    assert out == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    explained = plan(catalog.page_after(frame, ["a", "b"], (3, 200), 10))
    assert "TakeOrderedAndProject" in explained and "rangepartitioning" not in explained and "GreaterThanOrEqual(a,3)" in explained


def test_stored_json_by_path(spark):
    texts = ['{"page_number": 2, "ok": true}', '{"page_number": "2"}', '{"page_number": 2', "[2]", "", None, '{"page_number": {"x": 1}}', '{"page_number": null}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, m string").select("i", catalog.stored(F.col("m")).alias("metadata"))
    assert sorted(r["i"] for r in catalog.on_page(rows, "2").collect()) == [0, 1]
    got = {r["i"]: r["d"] for r in rows.select("i", catalog.described(F.col("metadata"), {"page_number": "int", "ok": "boolean"}).alias("d")).collect()}
    assert (got[0]["page_number"], got[0]["ok"]) == (2, True) and got[1]["page_number"] == 2 and all(got[i]["page_number"] is None for i in range(2, 8))


def test_a_relational_table_goes_round(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("id AS ID", "id * 2.5D AS PRICE", "concat('n', id) AS NAME")
    rows.where("ID < 600").write.format("jdbc").options(url=url, dbtable="docs", createTableColumnTypes="NAME VARCHAR(40)", **driver).mode("overwrite").save()
    # columns keep their case in quotes; a write that runs again changes nothing
    for _ in range(2):
        catalog.merge_into(rows.where("ID >= 400").withColumn("PRICE", F.lit(0.5)), url, "docs", "ID", 3, **driver)
    frame = catalog.partitioned_source(spark, url, "docs", "ID", 4, **driver)
    assert frame.rdd.getNumPartitions() == 4 and frame.count() == 1000 and frame.where("PRICE = 0.5").count() == 600
    some = frame.where("ID >= 990 AND NAME = 'n995'").select("ID")
    assert "PushedFilters: [*" in plan(some) and "ReadSchema: struct<ID:bigint>" in plan(some) and [r["ID"] for r in some.collect()] == [995]


def test_documents_with_their_data_and_lists(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc int, name string")
    blocks = spark.createDataFrame([(1, "image", 1, 0, 0, "i"), (1, "heading", 1, 1, 1, "h"), (1, "text", 1, 0, 0, "t"), (1, "table", 2, 0, 0, "g"), (1, "list", 1, 0, 0, "l")], BLOCKS)
    data = spark.createDataFrame([(1, "{}")], "doc int, data string")
    got = {r["doc"]: r for r in catalog.data_of(docs, data, blocks, "doc", ["id"], ["data"]).collect()}
    assert [[x["id"] for x in got[1][n]] for n in ("text_blocks", "tables", "images")] == [["t", "h"], ["g"], ["i"]] and got[1]["data"] == "{}"
    assert got[2]["text_blocks"] == [] and got[2]["data"] is None


# ---- files by content, and files that keep coming


def test_files_are_kept_by_content_and_deleted(spark, tmp_path):
    folder = tmp_path / "kept"
    rows = [("a.PDF", b"one"), ("b.pdf", b"one"), ("c", b"one"), ("d.docx", b"two"), ("e.docx", None), (None, b"three")] + [(f"{i}.pdf", b"many") for i in range(50)]
    frame = spark.createDataFrame(rows, "filename string, content binary").repartition(4)
    for _ in range(2):  # saving again changes nothing
        placed = {r["filename"]: (r["place"], r["size"]) for r in blob_store.save(frame, str(folder)).collect()}
        assert sorted(p.read_bytes() for p in folder.rglob("*") if p.is_file()) == sorted([b"one", b"one", b"two", b"", b"three", b"many"])
    assert placed["a.PDF"] == placed["b.pdf"] and placed["a.PDF"][0].endswith(".pdf") and placed["c"] != placed["a.PDF"] and placed["e.docx"][1] == 0
    assert (folder / placed["d.docx"][0]).read_bytes() == b"two"
    gone = spark.createDataFrame([(placed["d.docx"][0],), ("no/where",), (None,), (placed["d.docx"][0],)], "place string")
    blob_store.delete(gone, str(folder))
    left = {r["place"]: bytes(r["content"]) for r in blob_store.load(spark, str(folder)).collect()}
    assert placed["d.docx"][0] not in left and left[placed["b.pdf"][0]] == b"one" and len(left) == 4  # the reader skips the empty one


def test_new_files_are_extracted_once_and_bad_ones_fail(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = "path string, modificationTime timestamp, length long, content binary"

    def go():
        stream = ingest.watch(spark, str(source), schema, "binaryFile", most=2)
        whole = lambda found: extraction.extract_documents(extraction.file_blocks(files.extract(found.withColumn("reader", files.reader_of(F.col("path")))))).select("doc", "total_blocks", "status", "error")
        ingest.ingest(stream, str(out / "rows"), str(out / "checkpoint"), "doc", whole).awaitTermination()
        return {r["doc"].rpartition("/")[2]: (r["total_blocks"], r["status"]) for r in ingest.latest(spark, str(out / "rows"), "doc").collect()}

    for i in range(5):
        (source / f"{i}.docx").write_bytes(docx([("Title", True), *((f"line {k}", False) for k in range(i))]))
    assert go() == {f"{i}.docx": (2 + i, "completed") for i in range(5)}
    (source / "bad.docx").write_bytes(b"x")
    got = go()
    assert got["bad.docx"] == (0, "failed") and got["4.docx"] == (6, "completed") and go() == got
