"""The pipeline's stages, each on what the one before it kept, against plain loops; and run() against the chain."""

from collections import Counter

import numpy as np
from foliant.llm import language_id, line_dedup, mixing
from pyspark.sql import functions as F

import corpus_pipeline

from .test_llm import DOCS, SF, brute_lines, brute_near, check_packing

SHARED = "One long line of words that more than one document of this test shares with the others."


def corpus(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select(*(f.split()[0] for f in DOCS.split(", ")))
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in found.where("doc_id < 120").collect()]
    long = next(t for _, t, *_ in base if len(t.split()) > 150 and "\n" not in t[:400])
    words = long.split()
    more = [(1000, long, "en", "a", 1), (1001, " ".join(words[:-3]), "en", "a", 1), (1002, " ".join(["different", *words[: len(words) // 2]]), "en", "b", 1), (1003, "12 34 ... 56", "en", "a", 1), (1004, "", "en", "a", 0), (1005, None, None, None, None)]
    more += [(1100 + i, f"{SHARED}\nand a tail of its own number {i} which nobody else has got", "en", f"s{i % 2}", 1) for i in range(6)]
    return spark.createDataFrame(base + more, DOCS).repartition(5)


def rows(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_each_stage_equals_loops_on_its_input(spark, tmp_path):
    docs = corpus(spark)
    before = rows(docs)

    model = language_id.train(docs)
    stage = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    kept = []
    for r in before:
        codes = np.concatenate([np.empty(0, np.intp), *language_id.trigrams((r[1] or "").encode())])
        means = model.table[codes].mean(0, dtype=float) if len(codes) else None
        if means is not None and means.max() >= -np.log(language_id.BUCKETS):
            kept.append(r)
    assert Counter(rows(stage)) == Counter(kept) and not {1003, 1004, 1005} & {r[0] for r in kept} and len(kept) > 100

    docs = spark.createDataFrame(kept, DOCS).repartition(3)
    gone = brute_lines(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), line_dedup.MIN_WORDS)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    stage = rows(corpus_pipeline.STAGES[1][1](spark, docs, SF))
    expected = []
    for r in kept:
        lost = set(gone.get((r[0], hashes[r[0]]), ()))
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in lost)
        if not lost:
            expected.append(r)
        elif text.strip():
            expected.append((r[0], text, r[2], r[3], len(text)))
    assert Counter(stage) == Counter(expected) and len({r[0] for r in kept}) > len({r[0] for r in stage}) and sum(SHARED in r[1] for r in stage) == 1

    stage2 = spark.createDataFrame(stage, DOCS).repartition(4)
    stage = rows(corpus_pipeline.STAGES[2][1](spark, stage2, SF))
    left = brute_near([(r[0], r[1]) for r in expected])
    assert Counter(stage) == Counter(r for r in expected if r[0] in left) and len(stage) < len(expected)

    near = spark.createDataFrame(stage, DOCS).repartition(2)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(near).collect()}
    mixed = rows(corpus_pipeline.STAGES[3][1](spark, near, SF))
    assert Counter(mixed) == Counter({r: copies[r[0]] for r in stage if copies[r[0]]})
    assert all(n in (0, 1, 2) for n in copies.values()) and 0.9 < sum(len(r[1].split()) for r in mixed) / (1.5 * sum(len(r[1].split()) for r in stage)) < 1.1

    last = spark.createDataFrame(mixed, DOCS).repartition(3)
    packed = corpus_pipeline.STAGES[4][1](spark, last, SF).collect()
    used, bound = check_packing(packed, [(r[0], r[1]) for r in mixed])
    assert used <= bound + 1

    # run() writes and reads again between the stages, from other partitions
    before_run = corpus(spark)
    before_run.write.parquet(str(tmp_path / "documents.parquet"))
    place = lambda x: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in x)
    assert place(corpus_pipeline.run(spark, str(tmp_path)).collect()) == place(packed)
