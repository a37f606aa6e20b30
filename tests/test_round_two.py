"""Edges of headers, indexes, relations and phrases, and what is stored and read back."""

from foliant.functions import cells as C
from foliant.functions import correct
from foliant.operators import blocks as B
from foliant.operators import enrich, images
from foliant.plans import catalog, extraction
from foliant.sources import document_sink
from pyspark.sql import functions as F

import numpy as np
import pytest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_an_empty_first_row_gives_no_header(spark):
    none = F.array().cast("array<string>")
    names, rest = C.detect_header(none, F.array(none, F.array(F.lit("a"), F.lit("b"))))
    assert one(spark, names) == [] and one(spark, rest) == [["a", "b"]]


def test_indexes_skip_page_zero_and_empty_labels(spark):
    rows = spark.createDataFrame([(1, 0, "", 0, "a"), (1, None, None, 1, "b"), (1, 2, "X", 2, "c"), (1, 2, "X", 3, "d")], "doc int, page int, label string, ord int, id string")
    assert [tuple(r) for r in B.inverted_index(rows, "doc", "page", "ord").collect()] == [(1, 2, ["c", "d"])]
    assert [tuple(r) for r in B.inverted_index(rows, "doc", "label", "ord").collect()] == [(1, "X", ["c", "d"])]


def test_relations_of_unsorted_and_shared_positions(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        ents = [(f"e{i}", int(p)) for i, p in enumerate(rng.integers(0, 120, 90))]
        frame = spark.createDataFrame([(ents,)], "e array<struct<text:string,pos:int>>")
        got = sorted((r["entity1"], r["entity2"], r["distance"]) for r in frame.select(enrich.relations(F.col("e")).alias("r")).first()["r"])
        assert got == sorted((a, b, abs(p - q)) for i, (a, p) in enumerate(ents) for b, q in ents[i + 1 :] if abs(p - q) < 50)


def test_phrases_go_by_place_not_by_substring(spark):
    text = F.lit("The Maximum is high. Then came Maxi. Nothing here.\nSeen in 1999!")
    ents = one(spark, enrich.entities(text))
    assert [(e["text"], e["label"], e["start"], e["end"]) for e in ents] == [("Maximum", "PERSON", 4, 11), ("Then", "PERSON", 21, 25), ("Maxi", "PERSON", 31, 35), ("Nothing", "PERSON", 37, 44), ("Seen", "PERSON", 51, 55), ("1999", "DATE", 59, 63)]
    only = F.filter(enrich.entities(text), lambda e: e["text"] == "Maxi")
    assert one(spark, enrich.key_phrases(text, only)) == ["Then came Maxi."]
    row = one(spark, enrich.enrich(F.lit("")))
    assert row["entities"] == [] and row["relevance_score"] == 0.0 and row["language"] == "fr"


def test_the_trigger_changes_no_correction(spark):
    texts = ["le  24   décembre", "2 mbre 2020 décembre", "ou  16 octobre", "Republique\n democratique du congo", "1 2 2020", "lus  d'infos", "plain  text\twith  spaces", "", None, "cudi M Période tol N°", "ou   16 fois"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")

    def whole(c):
        month = "\\b(\\d{1,2})\\s+mbre\\s+(\\d{4})\\b"
        dated = F.when(F.lower(c).contains("décembre"), correct.fold(correct.fold(c, [("\\b2\\s+mbre\\s+(\\d{4})\\b", "25 décembre $1")]), [(month, "$1 décembre $2")])).otherwise(correct.fold(c, [(month, "$1 décembre $2")]))
        text = correct.fold(correct.fold(correct.fold(dated, correct.FIRST_RULES), correct.WORD_RULES), correct.DATE_RULES)
        text = correct.fold(text, [("\\b(\\d)\\s+(\\d)\\s+(\\d{4})\\b", "$1$2$3")], "(?U)")
        return F.when(correct.py_strip(c) == "", c).otherwise(correct.tidy(correct.fold(text, correct.FRENCH_RULES)))

    for r in frame.select("t", correct.correct_text(F.col("t")).alias("a"), whole(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_structured_keeps_documents_without_blocks(spark):
    docs = spark.createDataFrame([(1, None, "s", "en", 0), (2, " \n", "s", "en", 2), (3, "TITLE\nBody Text 12\n" + "x\n" * 25, "s", "en", 9)], "doc_id long, text string, source string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in extraction.structured(docs).collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["failed", "failed", "completed"] and got[1]["content_blocks"] == []
    assert got[3]["sections"][0]["title"] == "TITLE" and got[3]["orphan_blocks"] == [] and sorted(got[3]["by_page"]) == [1, 2] and got[3]["by_entity"]["CARDINAL"] == ["3:1"]


def test_stored_tables_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("a", "# A"), ("b", "# B\n\ntext")], "doc string, markdown string")
    catalog.save(rows, str(tmp_path), "docs", by="doc")
    assert sorted(map(tuple, catalog.load(spark, str(tmp_path), "docs").select("doc", "markdown").collect())) == [("a", "# A"), ("b", "# B\n\ntext")]
    document_sink.save_documents(rows, str(tmp_path / "md"), "doc", "doc")
    assert sorted(p.name for p in (tmp_path / "md").iterdir()) == ["a.md", "b.md"] and (tmp_path / "md" / "b.md").read_text() == "# B\n\ntext"


def test_image_measures_in_one_row(spark):
    rng = np.random.default_rng(2)
    batch = [rng.integers(0, 256, n).astype(np.uint8) for n in (64, 9, 1)]
    assert images.otsu_thresholds(batch).tolist() == [images.otsu_threshold(x) for x in batch]
    for x in batch:
        pixels = F.array(*(F.lit(int(v)) for v in x))
        assert one(spark, images.median(pixels)) == np.median(x) and one(spark, images.deviation(pixels)) == pytest.approx(x.std())
