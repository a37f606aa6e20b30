"""Hot keys and repeated rows: salted ranks, chained lookups, one survivor of each group, mixes by source, and many languages."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from foliant.llm import common, embed_dedup, language_id, mixing, packing, simhash
from pyspark.sql import functions as F


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_equal_pieces_are_ranked_by_many_tasks(spark):
    pieces = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc", "0 AS piece", "0L AS start", "CASE WHEN id % 3 = 0 THEN 300L ELSE 1 + id % 2048 END AS length", "CASE WHEN id % 3 = 0 THEN 5L ELSE id END AS crc").repartition(6)
    placed = packing.pack(pieces)
    rows = placed.collect()
    assert len(rows) == 20_000 and len({(r["sequence"], r["offset"]) for r in rows}) == 20_000
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    import glob

    import pyarrow.parquet as pq

    folder = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/pieces-*"), key=lambda p: __import__("os").path.getmtime(p))
    hot = Counter(x["salt"] for x in pq.read_table(folder).select(["length", "salt"]).to_pylist() if x["length"] == 300)
    assert max(hot.values()) < 2 * statistics.median(hot.values())


def test_filling_is_least_waste_by_branches():
    rng = random.Random(5)
    for _ in range(400):
        space, lengths = rng.randint(1, 60), sorted(rng.sample(range(1, 40), rng.randint(1, 8)), reverse=True)
        counts = {x: rng.randint(0, 3) for x in lengths}
        sums = {0}
        for x in lengths:
            sums = {s + x * k for s in sums for k in range(counts[x] + 1) if s + x * k <= space}
        made = packing._filling(space, lengths, counts)
        assert sum(made) == max(sums) and all(made.count(x) <= counts[x] for x in lengths) and made == sorted(made, reverse=True)


def test_chained_lookups_read_the_rows_once(spark):
    rows = common.materialize(spark.range(3000).selectExpr("id AS i", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 500) END AS k", "concat('m', id % 11) AS m"), "rows")
    tables = {c: common.materialize(rows.where(f"{c} IS NOT NULL").groupBy(c).agg(F.count("*").alias(f"{c}_n"), F.max("i").alias(f"{c}_v")), "table") for c in ("k", "m")}
    for how in ("left", "inner"):
        out = rows
        for c in ("k", "m"):
            out = common.lookup(out, tables[c], [c], f"{c}_n", how, most=0)
        assert plan(out).count(f"{'i'}#") and plan(out).count("Relation [i#") == 1
        got = sorted((r["i"], r["k_v"], r["m_v"]) for r in out.where("k IS NOT NULL").collect())
        most = {c: {r[c]: r[f"{c}_v"] for r in t.collect()} for c, t in tables.items()}
        assert got == sorted((r["i"], most["k"][r["k"]], most["m"][r["m"]]) for r in rows.where("k IS NOT NULL").collect())
        assert out.count() == (3000 if how == "left" else len(got))


def test_the_same_one_of_equal_rows_stays(spark):
    rows = [(1, "same text of one document", f"s{i}") for i in range(50)] + [(1, "same text of one document", "s7")] * 200 + [(2, None, "x"), (None, None, "y"), (None, None, "y")]
    kept = set()
    for n in (1, 3, 5):
        random.Random(n).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        kept.add(tuple(sorted(map(tuple, simhash.dedup(docs).collect()), key=repr)))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_applied_words_by_source_are_the_mix_s(spark):
    rows = [(1, "twelve words " * 6, "x")] * 2 + [(1, "twelve words " * 6, "y")] * 25 + [(i, f"own words {i} here", "y") for i in range(2, 40)] + [(1, "twelve words " * 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix_sources(docs)
    wanted = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect() if r["w"]}
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    assert {r["source"]: r["w"] for r in mixing.apply_mix(docs, mixed).groupBy("source").agg(F.sum(words).alias("w")).collect()} == wanted


def test_every_common_label_is_learnt(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(sorted(words) * 4)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    model = language_id.train(docs)
    assert len(model.languages) == 70
    found = language_id.identify(language_id.document_rows(docs), model, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("language = lang").count() == 280


@pytest.mark.parametrize("level", range(len(embed_dedup.LEVELS)))
def test_every_level_finds_pairs_at_the_least_cosine(level):
    rng = np.random.default_rng(5)
    for dims in (8, 64):
        u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 1500, dims)))
        w -= (w * u).sum(1, keepdims=True) * u
        a, b = (embed_dedup.cells(x, level) for x in (u, 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)))
        assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.985


def test_many_near_vectors_link_exactly(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.standard_normal(64) * (0.2 if i % 5 else 2.0)], i % 40 // 20 if i % 11 else None) for i in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    v = np.array([r["embedding"] for r in frame.orderBy("vec_id").collect()], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked = (v @ v.T >= 0.93) & (labels[:, None] == labels[None, :]) & (labels[:, None] >= 0) & ~np.eye(len(v), dtype=bool)
    got = {r["vec"]: r for r in embed_dedup.near_vectors(frame).collect()}
    found, wanted = sum(r["n_links"] for r in got.values()), int(linked.sum())
    assert wanted > 10_000 and 0.985 * wanted <= found <= wanted and all(got[i]["n_links"] <= linked[i].sum() for i in range(1200))
