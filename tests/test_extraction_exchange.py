"""What goes through the one exchange of the extraction, and what is found behind it."""

from foliant.operators import enrich
from foliant.plans import extraction
from pyspark.sql import functions as F


def test_findings_do_not_go_through_the_exchange(spark):
    text = "Paris and London met in 1999. Berlin came later, in 2004.\nTITLE\na|1\n   \nno names here"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    blocks = extraction.text_blocks(docs)
    made = extraction.extract_documents(blocks)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    over, below = plan.split("Aggregate [doc", 1)
    assert "proximity" in over and "proximity" not in below

    found = {r["doc"]: r for r in made.collect()}
    parts = {b["text"]: b for b in found["1"]["content_blocks"] if b["kind"] != "table"}
    fields = ["entities", "relations", "key_phrases", "language", "token_count", "relevance_score"]
    alone = spark.createDataFrame([(t,) for t in parts], "text string").select("text", enrich.enrich(F.col("text")).alias("e")).collect()
    assert len(parts) == 3 and len(parts[text.split("\n")[0]]["relations"]) > 3
    assert all(parts[r["text"]][f] == r["e"][f] for r in alone for f in fields)
    table = next(b for b in found["1"]["content_blocks"] if b["kind"] == "table")
    assert table["entities"] is None and table["relations"] is None and dict(table["properties"])["normalized"] == "true"
    assert [found[d]["status"] for d in "123"] == ["completed", "failed", "failed"]
