"""What the findings of round three asked for: work that grows with the input, and the same results."""

import time

from foliant.functions import text
from foliant.operators import enrich, sentences
from foliant.sources import files
from foliant.streaming import lifecycle
from pyspark.sql import Row
from pyspark.sql import functions as F


def test_white_space_is_that_of_python(spark):
    rows = [(i, f"{chr(c)}{chr(c)}x{chr(c)} y{chr(c)}") for i, c in enumerate([*range(1, 0x3100), 0xFEFF])]
    found = spark.createDataFrame(rows, "i int, t string").select("t", text.py_strip(F.col("t")).alias("s"), text.word_count(F.col("t")).alias("n")).collect()
    assert all(r["s"] == r["t"].strip() and r["n"] == len(r["t"].split()) for r in found)
    # the two patterns stood here before: each was looked for at every character
    assert "trim" in str(text.py_strip(F.col("t")))


def test_ends_of_long_runs_take_no_square(spark):
    runs = spark.createDataFrame([(1, "ab." * 30_000 + " Then etc. it ends."), (2, "See b.c. it. xb.c. it"), (3, "a b. c")], "doc_id int, text string").repartition(1)
    began = time.perf_counter()
    found = {r["doc_id"]: r["p"] for r in runs.select("doc_id", sentences.pieces(F.col("text"), ["etc", "b.c", "ab"]).alias("p")).collect()}
    assert time.perf_counter() - began < 30
    assert [len(p) for p in found[1]] == [90_000, 19]
    assert found[2] == ["See b.c. it.", " xb.c.", " it"] and found[3] == ["a b.", " c"]


def test_each_different_token_is_read_once(spark):
    docs = spark.createDataFrame([("Dr. Who, dr. who (Dr. x) etc.",), (None,), ("",)], "text string")
    found = {r["word"]: (r["dotted"], r["plain"]) for r in sentences.counts(docs).collect()}
    assert found == {"dr": (3, 0), "who": (0, 2), "x": (0, 1), "etc": (1, 0)}
    plan = sentences.counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # tokens are counted before patterns are tried


def test_entities_are_found_without_a_look_at_each_token(spark):
    rows = [("Paris,  in 1999\nNo Name  12é x", [("Paris", "PERSON", 0, 5, 0), ("1999", "DATE", 11, 15, 3), ("Name", "PERSON", 19, 23, 5), ("12é", "CARDINAL", 25, 28, 7)]), ("", []), (" ", []), ("x", []), (None, None)]
    got = spark.createDataFrame(rows, "text string, e array<struct<text:string,label:string,start:int,end:int,pos:int>>").select("text", "e", enrich.entities(F.col("text")).alias("g")).collect()
    assert [None if r["g"] is None else [tuple(x)[:5] for x in r["g"]] for r in got] == [r[1] for r in rows]
    pieces = str(enrich.entities(F.col("text")))
    assert "?<=[ \n]" in pieces


def test_relations_look_no_further_than_they_reach(spark):
    places = [0, 3, 49, 50, 51, 52, 99, *range(200, 280), 280, 280, 280, 281]
    frame = spark.createDataFrame([([(f"e{i}", p) for i, p in enumerate(places)],)], "e array<struct<text:string,pos:int>>")
    found = sorted((r["entity1"], r["entity2"], r["distance"]) for r in frame.select(F.explode(enrich.relations(F.col("e"))).alias("r")).select("r.*").collect())
    assert found == sorted((f"e{i}", f"e{j}", places[j] - places[i]) for i in range(len(places)) for j in range(i + 1, len(places)) if places[j] - places[i] < enrich.NEAR)


def test_blocks_of_small_files_go_on_together(spark, monkeypatch):
    some = spark.createDataFrame([(f"{i}.x", "lines", 3, b"a b" if i % 7 else b"") for i in range(50)], "path string, reader string, length long, content binary").repartition(2)
    parser = {"lines": lambda data: ({"kind": "text", "ord": i, "text": w} for i, w in enumerate(data.decode().split() if data else 1 / 0))}
    for most in (1, 3, 1000):
        monkeypatch.setattr(files, "BATCH_ROWS", most)
        got = files.extract(some, parser).groupBy("kind").count().collect()
        assert {r["kind"]: r["count"] for r in got} == {"text": 84, "error": 8}


class Held:
    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value
        self.calls.append("update")

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls.append("register")

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)
        self.calls.append("delete")


def test_state_is_written_once_for_many_requests():
    held, life = Held(), lifecycle.LifeCycle(100)
    life.init(held)
    asked = lambda *xs: iter([Row(document=1, request=i, action=a, at=None, millis=m) for i, a, m in xs])
    said = list(life.handleInputRows((1,), asked((2, "finish", 5), (1, "start", 0), (3, "start", 10), (4, "start", 20), (5, "start", 200)), None))
    assert [(r["request"], r["status"], r["accepted"]) for r in said] == [(1, "extracting", True), (2, "completed", True), (3, "extracting", True), (4, "extracting", False), (3, "failed", True), (5, "extracting", True)]
    assert held.calls == ["register", "update"] and held.timers == {300} and held.value == ("extracting", 5, 200)
    assert [r["accepted"] for r in life.handleInputRows((1,), asked((6, "start", 210)), None)] == [False] and len(held.calls) == 2
    assert [r["reason"] for r in life.handleExpiredTimer((1,), None, None)] == ["timed out"] and held.timers == set() and held.value[0] == "failed"
