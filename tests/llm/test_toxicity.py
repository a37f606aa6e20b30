"""The folded machine against the kernel's own sums, held-out accuracy, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import toxicity

SF = "/root/testdata/sf0.01"


def subsequences(text):
    """Weights of all hashed subsequences of a sentence between its two spaces, by plain loops."""
    data = [32, *(32 if b in (32, 9, 10, 11, 12, 13) else b for b in text.encode()), 32]
    made = {}
    for i in range(len(data)):
        for k in range(i + 2, min(len(data), i + toxicity.WINDOW)):
            for j in range(i + 1, k):
                code = int(toxicity._code(*(np.array([data[x]], np.uint32) for x in (i, j, k)))[0])
                made[code] = made.get(code, 0.0) + toxicity.DECAY ** (k - i - 2)
    return made


def kernel(a, b):
    x, y = subsequences(a), subsequences(b)
    norm = [float(toxicity._norms(np.array([0, len(t.encode()) + 1]))[0]) for t in (a, b)]
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / norm[0] / norm[1]


TOXIC, CLEAN = ["you idiot there", "what a moron", "idiot and moron"], ["the green table", "a river of paper", "carpet in there", "window and door", "you and what"]
MARKS = ["idiot", "moron", "table", "green", "there", "what"]


def test_folded_function_is_the_kernel_sum():
    space = toxicity.Nystroem(MARKS)
    gram = np.array([[kernel(a, b) for b in MARKS] for a in MARKS])
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    features = space.features([*TOXIC, *CLEAN])
    assert features == pytest.approx(np.array([[kernel(m, s) for m in MARKS] for s in [*TOXIC, *CLEAN]]) @ root, abs=1e-4)
    w = np.random.default_rng(1).standard_normal(len(MARKS))
    alpha = root @ w
    for sentence in (*TOXIC, *CLEAN, "i d i o t", "id.iot", "é", ""):
        data, edges = toxicity._whole([sentence])
        got = toxicity.margins(data, edges, space.fold(w), 0.25)[0]
        assert got == pytest.approx(0.25 + sum(a * kernel(m, sentence) for a, m in zip(alpha, MARKS, strict=True)), abs=1e-3)


def test_gaps_and_inserted_characters():
    weights, bias = toxicity.fit_sentences(toxicity.Nystroem(MARKS), TOXIC, CLEAN)

    def value(sentence):
        data, edges = toxicity._whole([sentence])
        return toxicity.margins(data, edges, weights, bias)[0]

    assert min(map(value, ("i d i o t", "idi.ot", "idiiot", "id-iot you", "mo ron"))) > max(map(value, ("carpet", "a window", "the door")))


def test_sentences_are_cut_alike_alone_and_together():
    texts = [b"One two three four. five! six seven\neight nine ten eleven twelve thirteen", b"", b"  ", b"a b c d e f g h i j k l m n o p", b"x" * 50]
    data, edges, owner = toxicity.flatten(texts)
    together = [(int(o), data[a:b].tobytes()) for a, b, o in zip(edges[:-1], edges[1:], owner, strict=True)]
    alone = []
    for i, t in enumerate(texts):
        d, e, _ = toxicity.flatten([t])
        alone += [(i, d[a:b].tobytes()) for a, b in zip(e[:-1], e[1:], strict=True)]
    assert together == alone
    assert [x.strip() for o, x in together if o == 0] == [b"One two three", b"four.", b"five!", b"six seven", b"eight nine ten", b"eleven twelve thirteen"]
    assert [x.strip() for o, x in together if o == 3] == [b"a b c d e f g h i j k l", b"m n o p"]
    long = b"word and more " * 200_000
    parts = list(toxicity._parts(long))
    assert b"".join(parts) == long and max(map(len, parts)) <= toxicity.CHUNK


def test_held_out_accuracy(spark):
    scored = toxicity.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in scored)
    assert caught >= 0.8 * sum(r["toxic"] for r in scored) and caught >= 0.9 * sum(r["predicted"] for r in scored)
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_odd_rows(spark):
    rows = [(i, f"you worthless idiot number {i}, a fool at best", 1) for i in range(40)] + [(100 + i, f"the green table number {i} in a quiet room", 0) for i in range(40)]
    rows += [(7, "you worthless idiot number 7, a fool at best", 1)] * 3  # repeated rows
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = [(1, None, 0), (2, "", 1), (2, "", 1), (None, "a worthless idiot here", 2), (4, "the quiet room " * 200_000, 3), (5, "\n\t ", 4)]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, score int"), model).collect()
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and by_id[1] == by_id[2] == by_id[5] and by_id[None] > 0.7 > max(by_id[1], by_id[4])
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None and toxicity.fit(docs.where("false"), labels) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_one_repeated_id_trains_once(spark):
    same = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("you idiot").alias("text"))
    labels = spark.range(5000).select((F.col("id") % 2).alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.fit(same, labels) is None  # one document, one label
