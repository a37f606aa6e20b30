"""Golden rows of the reference's behaviour, and whole queries against their SQL twins."""

import io
import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import cells as C
from foliant.functions import correct
from foliant.functions.text import py_strip
from foliant.operators import blocks as B
from foliant.operators import enrich, images, markdown, tables
from foliant.plans import catalog, extraction, queries
from foliant.sources import files
from foliant.streaming import ingest

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("cudi 2 mbre 2025", "Jeudi 2 décembre 2025"),
        ("le 25 décembre et 2 mbre 2025", "le 25 décembre et 25 décembre 2025"),
        ("plus d'fos", "plus d'infos"),
        ("JOURNAL OFFICIEL\nREPUBLIQUE DEMOCRATIQUE DU CONGO", "JOURNAL OFFICIEL\nDE LA\nREPUBLIQUE DEMOCRATIQUE DU CONGO"),
        ("B Pérode 1", "BB Période 1"),
        ("tol N° 3/20", "LOI N° 3/20"),
        ("ou 16 mars", "DU 16 mars"),
        ("1 2 2025", "122025"),
        ("   ", "   "),
    ],
)
def test_correct(spark, text, expected):
    assert one(spark, correct.correct_text(F.lit(text))) == expected


@pytest.mark.parametrize(("n", "m", "conf", "expected"), [(10, 10, 0.8, 0.84), (10, 12, 0.8, 0.84), (10, 13, 0.8, 0.72), (5, 5, 0.99, 1.0)])
def test_confidence(spark, n, m, conf, expected):
    made = correct.adjust_confidence(F.lit("w " * n), F.lit("w " * m), F.lit(conf))
    assert one(spark, made) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["2024-01-05", "2024-1-5", "05/01/2024", "x"], "date"),
        (["1 234,5", "7"], "number"),
        (["1"] * 7 + ["w"] * 3, "text"),
        (["1", "0", "1"], "number"),
        (["oui", "non", "Yes"], "boolean"),
        (["1,234.56", "2"], "text"),
        (["", " "], "text"),
        (["2023-02-29", "2024-001-05", "0000-01-01"], "text"),
    ],
)
def test_column_type(spark, values, expected):
    rows = spark.createDataFrame([(v,) for v in values], "raw string")
    assert rows.agg(C.column_type(F.col("raw")).alias("k")).first()["k"] == expected


def test_convert_and_headers(spark):
    assert tuple(one(spark, C.convert(F.lit("1 234,5"), F.lit("number")))) == ("1 234,5", 1234.5, None)
    assert tuple(one(spark, C.convert(F.lit("oui"), F.lit("boolean")))) == ("oui", None, True)
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))
    names, rest = C.detect_header(F.array().cast("array<string>"), rows)
    assert one(spark, names) == ["a", "b"] and one(spark, rest) == [["1", "2"]]
    names, rest = C.detect_header(F.array().cast("array<string>"), F.array(F.array(F.lit(""), F.lit("")), F.array(F.lit("1"), F.lit("2"))))
    assert one(spark, names) == ["Colonne_1", "Colonne_2"] and one(spark, rest) == [["1", "2"]]


def test_strip(spark):
    assert one(spark, py_strip(F.lit(" \t\n \x1ca b\u0085 "))) == "a b"


def test_merge_keeps_second_reader_first(spark):
    a = spark.createDataFrame([(1, 1, 0, "a1"), (1, 2, 1, "a2"), (1, None, 2, "a?")], "doc long, page int, ord int, t string")
    b = spark.createDataFrame([(1, 2, 0, "b2"), (1, 2, 1, "b2bis"), (1, 3, 2, "b3")], "doc long, page int, ord int, t string")
    assert [r["t"] for r in B.merge_sources(a, b, "doc").orderBy("page").collect()] == ["a1", "b2", "b3"]


def test_best_attempt_ties(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, "abc"), (1, 1, 0.5, "abcd"), (1, 2, 0.5, "wxyz"), (1, 3, 0.4, "z")], "i long, attempt int, confidence double, text string")
    assert B.best_attempt(rows, "i").first()["text"] == "abcd"


def test_sections_and_orphans(spark):
    rows = spark.createDataFrame([(1, i, h, str(i)) for i, h in enumerate((False, True, False, True))], "d long, o int, h boolean, id string")
    got = B.sections(B.number_sections(rows, "d", ["o"], F.col("h")), "d", "o", F.col("h"), "id").orderBy("section_no").collect()
    assert [r["block_ids"] for r in got] == [["0"], ["1", "2"], ["3"]]


def test_relations_relevance_levels(spark):
    ents = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(p).alias("pos")) for t, p in (("a", 0), ("b", 30), ("c", 90))))
    assert [tuple(r) for r in one(spark, enrich.relations(ents))] == [("a", "b", "proximity", 30)]
    assert one(spark, enrich.relevance(F.lit(10), F.lit(2), F.lit(1))) == pytest.approx(0.35)
    assert [one(spark, enrich.heading_level(F.lit(s))) for s in ("Heading 2", "Heading", "Heading 1 Char")] == [2, 1, 1]


def test_markdown(spark):
    assert one(spark, markdown.text_block(F.lit(" t "), F.lit(9))) == "###### t"
    assert one(spark, markdown.table_block(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit(""))))).endswith("|  |  |")
    head = one(spark, markdown.document_header(F.lit("f"), F.lit("pdf"), F.lit(1048576), F.lit(""), F.lit(None)))
    assert "1.00 MB" in head and "Statut" not in head


def test_images(spark):
    plan = one(spark, images.upscale_plan(F.lit(850), F.lit(1100)))
    assert (plan["width"], plan["height"]) == (2550, 3300)
    assert [one(spark, images.contrast_factor(F.lit(float(s)))) for s in (20, 5, 0, 40)] == [1.5, 2.5, 2.5, 1.0]
    kinds = [(400, 100, 1, True), (300, 100, 1, True), (100, 100, 10, True), (100, 100, 10, False)]
    assert [one(spark, images.image_kind(*map(F.lit, k))) for k in kinds] == ["graphique", "image", "diagramme", "image"]
    px = np.array([[10] * 8] * 4 + [[200] * 8] * 4, np.uint8)
    assert (images.binarize(px) == np.where(px > 100, 255, 0)).all() and (images.binarize(px, "median") == images.binarize(px)).all()
    assert all(images.preprocess(px, m).shape == px.shape for m in ("basic", "advanced", "aggressive", "?"))
    assert (images.rotate(images.rotate(px, 6), 8) == px).all()


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    sheet = '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v> 2 </v></c></row><row><c r="A2"/></row></sheetData></worksheet>'
    (tmp_path / "t.xlsx").write_bytes(zipped({"xl/sharedStrings.xml": '<sst xmlns="x"><si><t>h</t></si></sst>', "xl/worksheets/sheet1.xml": sheet}))
    body = '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "d.docx").write_bytes(zipped({"word/document.xml": body}))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "none.zip").write_bytes(b"x")
    (tmp_path / "empty.pdf").write_bytes(b"")
    found = files.read_files(spark, str(tmp_path))
    got = {(r["path"].split("/")[-1], r["kind"]): r for r in files.extract(found).collect()}
    assert got["t.xlsx", "table"]["cells"] == [["h", "", "2"]]
    assert got["d.docx", "text"]["level"] == 2 and got["d.docx", "table"]["cells"] == [["c"]]
    assert got["bad.docx", "error"]["error"].startswith("BadZipFile")
    assert {r["filename"]: r["reason"] for r in files.rejects(found).collect()} == {"none.zip": "not supported", "empty.pdf": "empty"}


def test_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "id long, v long")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.ingest(ingest.watch(spark, str(tmp_path / "in"), "id long, v long"), str(tmp_path / "out"), str(tmp_path / "check"), "id").awaitTermination()
    go()
    go()
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 2
    assert ingest.latest(spark, str(tmp_path / "out"), "id").count() == 20


def test_catalog_guards(spark):
    with pytest.raises(ValueError, match="content_type"):
        catalog.blocks_of(spark.range(1), "nonsense")
    rows = spark.createDataFrame([(1, 1, "uploaded"), (1, 2, "completed"), (1, 3, "extracting")], "d long, o int, s string")
    assert [r["allowed"] for r in catalog.transitions(rows, "d", ["o"], "s").orderBy("o").collect()] == [True, False, True]


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    made = queries.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    got = sorted(tuple(map(norm, r)) for r in made.select(*columns).collect())
    if name not in queries.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_tables_in_rows(spark):
    text = "array<string>"
    rows = spark.createDataFrame([(0, ["a", "b", "a"], [["1", " x ", "2"], ["2", None], []]), (1, [], []), (2, [], [["7", "oui"], ["8", "non", "z"]])], f"o int, h {text}, r array<{text}>")
    types = tables.column_types(F.col("h"), F.col("r"))
    got = rows.select("o", types.alias("t"), tables.row_maps(F.col("h"), F.col("r")).alias("m"), tables.convert_rows(F.col("r"), types).alias("c"), tables.project(F.col("o"), F.col("h"), F.col("r"), types).alias("p"))
    first, empty, bare = got.orderBy("o").collect()
    assert first["t"] == ["number", "text", "number"] and empty["t"] == [] and bare["t"] == ["number", "boolean"]
    assert first["m"] == [{"b": " x ", "a": "2"}, {"b": None, "a": None}, {"b": None, "a": None}]
    assert first["p"]["id"] is None and bare["p"]["id"] == "2" and first["p"]["column_count"] == 3 and empty["p"]["row_count"] == 0
    assert tuple(bare["c"][1][2]) == ("z", None, None) and bare["c"][0][1]["bool"] is True and first["c"][1][1]["raw"] is None


def test_block_dict_extra_wins(spark):
    base = {"order": F.lit(1), "page": F.lit(None).cast("int")}
    assert one(spark, tables.block_dict(base, F.create_map(F.lit("order"), F.lit("x")))) == {"order": "x", "page": None}
    assert one(spark, tables.block_dict(base, F.lit(None).cast("map<string,string>"))) == {"order": "1", "page": None}


def test_structured_has_all_parts(spark):
    docs = spark.createDataFrame([(1, "INTRO\nHello World 42\na | b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    row = extraction.structured(docs).first()
    assert [b["kind"] for b in row["content_blocks"]] == ["heading", "text", "table"] and row["content_blocks"][1]["prev_id"] == "1:0"
    assert row["by_entity"] == {"PERSON": ["1:1", "1:1"], "CARDINAL": ["1:1"]} and row["total_entities"] == 3 and row["metadata"]["lang"] == "en"
