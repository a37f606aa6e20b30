"""What the findings of round four asked for: places as the SQL has them, and all abbreviations, however many."""

import random

import duckdb
import pytest
from foliant.operators import enrich, sentences
from foliant.plans import learnt, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["Customer#000001999", "Élan#1999 5", "Customer#000000007"])
def test_places_are_those_of_the_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("nation", "region", "supplier", "customer"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "customer":
            rows = rows.limit(3).withColumn("c_name", F.lit(name))
        rows.write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(queries.SQL["dictionary_entities"])
    columns = [d[0] for d in want.description]
    got = learnt.dictionary_entities(spark, str(tmp_path)).select(*columns).collect()
    assert len(got) == 15 and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_more_abbreviations_than_a_list_holds_are_all_kept(spark, tmp_path):
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xE0, 0xF7), *range(0x3B1, 0x3C2), *range(0x430, 0x450)]]
    words = [a + b for a in letters for b in letters][: sentences.MOST]
    assert len(words) < sentences.MOST  # so words of three letters, twice each, make it full
    more = [a + b + c for a in letters[:16] for b in letters[-16:] for c in letters[-16:]]
    texts = [f"house {w}. garden {w}. river" + " field" * 7 for w in [*words, *more]]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "house aa. Bread.", texts[0]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(queries.SQL["learnt_sentences"]).fetchall())
    got = {r["doc_id"]: r["sentences"] for r in learnt.learnt_sentences(spark, str(tmp_path)).collect()}
    assert got == want and list(got.values()).count(1) >= len(texts) > sentences.MOST


def test_a_join_cuts_as_a_list_does(spark):
    rng = random.Random(4)
    parts = ["M. Dupont", "Dr. House", "e.g. bread", "Mme. Curie", "xe.g. y", "house", "garden.", "river!", "\n", "winter.\n", "MARKET"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)] + [None, "", " ", "M.", "M. ", ".\nM.", "abcdefghijklmnop.q. r", "M. A house. " * 2000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50], *["Dr. House."] * 200])], "id int, text string").withColumn("goes_on", F.lit("other"))
    kept, known = sentences.learn(docs)
    assert {"m", "dr", "e.g", "mme"} <= set(known) and kept is docs and set(known) == set(sentences.abbreviations(docs))
    assert sentences.learn(docs, most=len(known))[1] == known
    made = lambda df, k: {r["id"]: tuple(r) for r in df.select("id", sentences.pieces(F.col("text"), k), enrich.structure(F.col("text"), k), enrich.enrich(F.col("text"), known=k)).collect()}
    by_list = made(kept, known)
    for few in (len(known), len(known) - 1):  # with a broadcast table, and with one that is dealt out
        joined, column = sentences.learn(docs, out="places", most=len(known) - 1, few=few)
        assert joined.columns == [*docs.columns, "places"]
        assert made(joined, column) == by_list and len(by_list) == docs.count()
    assert max(len(r[1] or ()) for r in by_list.values()) == 2001
