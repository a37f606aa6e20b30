"""Ranked lexical search, sharding along a curve, and the filter audit, against plain loops and on odd inputs."""

import glob
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import filter_audit, lexical, sharding

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


# ---- ranked lexical search


def python_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def python_rank(docs, items, top):
    """docs: (id, text); items: (item, text)."""
    each = [(d, python_terms(t)) for d, t in docs if t is not None]
    each = [(d, Counter(ts), len(ts)) for d, ts in each if ts]
    n_docs, words = len(each), sum(n for _, _, n in each)
    df = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        scored = []
        for d, c, n in each:
            m = 100 - 50 + (50 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(python_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "東京", "x_y", "A-b", "co.uk"]
    text = lambda: rng.choice([" ", ",", "\n", "--"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 60)))
    docs = [(i, text()) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(120)] + [(7, docs[7][1])] * 3 + [(None, docs[5][1]), (900, None), (901, ""), (902, " .,_ \n"), (903, "w1 " * 30_000)]
    items = [(i, text()) for i in range(25)] + [(3, "w1 w2 w1"), (4, None), (5, ""), (6, "absent words only"), (None, "w3"), (20, docs[5][1]), (20, docs[5][1])]
    return docs, items


def test_search_equals_all_scores(spark, corpus, monkeypatch):
    docs, items = corpus
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).withColumns({"item": F.lit("i"), "score": F.lit(1), "rank": F.lit("r"), "n": F.lit(2)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = python_rank(docs, items, 50)
    made = lambda: sorted(map(tuple, lexical.rank(frame, asked).collect()), key=repr)
    assert made() == expected
    monkeypatch.setattr(lexical, "QUERY_BYTES", 2500)  # items in several passes
    monkeypatch.setattr(lexical, "MERGED", 2)
    assert made() == expected
    assert sorted(map(tuple, lexical.rank(frame, asked, top=3).collect()), key=repr) == python_rank(docs, items, 3)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "x", "y"), (2, "a", "x", "y")], DOCS)
    no_items, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert lexical.rank(none, items).count() == 0 and lexical.rank(some, no_items).count() == 0
    assert lexical.rank(some, items).columns == ["item", "rank", "doc", "score"]
    assert lexical.rank(some.where("doc_id = 1"), items).first()["score"] > 0  # ln(4 / 3)


def _segment(lists, rows):
    """lists: {term: {doc: times}}."""
    by_doc = [[(t, d[i]) for t, d in lists.items() if i in d] for i in range(rows)]
    flat = [x for xs in by_doc for x in xs]
    term, times = (np.array([x[k] for x in flat], np.int32) for k in (0, 1))
    return lexical.Segment(np.full(rows, 20), np.array([len(x) for x in by_doc]), term, times, rows, rows * 20)


def test_best_positions_stop_before_last_read_positions(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_READ", 4)
    rng, rows = np.random.default_rng(3), 4000
    # two lists in nearly the same order: direct accesses fill places ahead of those read
    times = {int(d): int(c) for d, c in zip(rng.permutation(rows), np.arange(rows) + 1, strict=True)}
    segment, best, asked = _segment({0: times, 1: {d: c + (d % 3) for d, c in times.items()}}, rows), lexical.Best(10), [(0, 500), (1, 400)]
    read, met = lexical.search(segment, asked, np.arange(rows), np.zeros(rows, bool), best)
    every = np.zeros(rows, np.int64)
    for t, w in asked:
        a, b = segment.bounds[t]
        np.add.at(every, segment.doc[a:b], w * segment.impact[a:b])
    order = np.lexsort((np.arange(rows), -every))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert read < rows // 10 and met < rows // 10


def test_equal_scores_at_the_bound_are_all_met(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_READ", 1)
    rows = 50  # every document scores the same: only ids tell, so reading must go on while the bound equals the kth score
    ids = np.arange(rows)[::-1].copy()
    segment, best = _segment({0: {i: 2 for i in range(rows)}}, rows), lexical.Best(5)
    lexical.search(segment, [(0, 9)], ids, np.zeros(rows, bool), best)
    assert best.id.tolist() == [0, 1, 2, 3, 4]


def test_segments_and_tasks_agree_with_one(corpus, monkeypatch):
    docs, items = corpus
    texts = [(d, t.encode()) for d, t in docs if t is not None]
    vocabulary = {t: i for i, t in enumerate(sorted({x for _, t in items if t for x in lexical.terms(t.encode())}))}
    batch = pa.record_batch([pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.binary())], ["doc", "text"])
    forward = list(lexical._forward(vocabulary)(iter([batch])))
    asked = [(repr(i).encode(), [(vocabulary[x], 700 + vocabulary[x]) for x in sorted(set(lexical.terms(t.encode())))]) for i, t in items if t]
    rows = lambda: [b.to_pydict() for b in lexical._ranked(asked, 300, 9000, 20)(iter(forward))]
    whole = rows()
    monkeypatch.setattr(lexical, "SEGMENT_ROWS", 1)  # a segment for each slice of the batch
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    assert rows() == whole


# ---- sharding


def test_consecutive_cells_of_the_curve_touch(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = spark.range((1 << bits) ** n).select(*(F.expr(f"cast(shiftright(id, {bits * i}) & {(1 << bits) - 1} as int)").alias(f"c{i}") for i in range(n)))
        rows = cells.select("*", sharding.hilbert([F.col(f"c{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(rows)))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.fixture(scope="module")
def metadata(spark):
    rows = [(i, "t" * (i * 37 % 400), ("en", "fr", "de", None)[i % 4], f"s{i * i % 11}") for i in range(600)]
    rows += [(5000, "one text of a third of all rows", "en", "hot")] * 400 + [(None, None, None, None)] * 5 + [(9000, "long " * 40_000, "fr", "s1")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("size", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"))
    return frame.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("curve", "salt", "place", "first", "_part", "before_")}).repartition(4)


def ties():
    return [F.asc_nulls_first("doc_id")]


def test_shards_keep_their_law(spark, metadata):
    for law, shards in (("rows", 16), ("rows", 7), ("bytes", 5)):
        rows = sharding.shard(metadata, ["source", "lang", "size"], ties(), F.col("size"), law, shards).collect()
        held = defaultdict(list)
        for r in rows:
            held[r["shard"]].append(r)
            assert r["curve"] == (None if r["doc_id"] is None else f"curve{r['doc_id']}")
        assert len(rows) == 1006 and all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in held.values())
        if law == "rows":
            counts = [len(held[k]) for k in range(shards)]
            assert max(counts) - min(counts) <= 1 and sum(counts) == 1006
        else:
            sizes = [sum(r["size"] for r in held[k]) for k in range(shards)]
            assert all(abs(s - sum(sizes) / shards) <= 200_001 for s in sizes)
        if shards != 16:
            continue
        again = sharding.shard(metadata.repartition(3), ["source", "lang", "size"], ties(), F.col("size"), law, shards).collect()
        assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in rows) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_repeated_rows_are_dealt_over_tasks(spark, metadata):
    placed = sharding.curve_order(metadata, ["source", "lang", "size"], ties(), F.col("size"), ("h", "wide", "nth", ""))
    assert sorted(r["nth"] for r in placed.collect()) == list(range(1006))
    ordered = max(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/ordered-*"), key=lambda p: pq.read_metadata(glob.glob(p + "/part-*")[0]).num_row_groups and len(pq.read_table(p)) == 1006)
    parts = pq.read_table(ordered).column("__part").to_pylist()
    assert max(Counter(parts).values()) < 400  # the row that repeats 400 times does not lie in one task


def test_few_rows_nothing_and_bad_laws(spark):
    three = spark.createDataFrame([(i, "x" * i, "en", "a") for i in range(3)], DOCS).withColumn("size", F.length("text") + 1)
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(three, ["source", "size"], ties(), F.col("size")).collect()) == [(0, 0), (1, 0), (2, 0)]
    for law in ("rows", "bytes"):
        assert sharding.shard(three.where("false"), ["source", "size"], ties(), F.col("size"), law).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(three, ["size"], ties(), F.col("size"), "key")


def test_files_of_the_curve_are_skipped_by_their_footers(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', cast(pmod(xxhash64(id), 900) as int)) AS text", "concat('l', pmod(xxhash64(id, 1), 8)) AS lang", "concat('s', pmod(xxhash64(id, 2), 30)) AS source")
    rows = rows.withColumn("size", F.length("text") + 1)
    sharding.write_shards(rows, str(tmp_path / "c"), ["source", "lang", "size"], ties(), F.col("size"))
    rows.repartition(16).write.parquet(str(tmp_path / "r"))

    def read(folder, name, low, high):
        """Part of all files whose footer leaves room for a value."""
        files = glob.glob(f"{folder}/**/*.parquet", recursive=True)
        kept = 0
        for f in files:
            meta = pq.read_metadata(f)
            column = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == name)
            stats = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
            kept += any(s.min <= high and s.max >= low for s in stats)
        return kept / len(files)

    for name, low, high in (("source", "s12", "s12"), ("lang", "l3", "l3"), ("size", 100, 120)):
        assert read(tmp_path / "r", name, low, high) == 1 and read(tmp_path / "c", name, low, high) <= 0.6
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6000


def test_op12_digest(spark):
    rows = sharding.op12_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1


# ---- filter audit


def python_audit(docs, labels):
    """docs: (id, text, lang); labels: {id: (quality, toxic)}."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and d > least[t] else set()
        rows.append((lang or "", fails, labels.get(d, (0, 0)) if d is not None else (0, 0)))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed, lines = Counter(), []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                removed[f] += len(here)
                kept = sum(not r[1] & (before | {f}) for r in own)
                gone = sum(f in r[1] and bool(r[1] & before) for r in own)
                lines.append((part, "".join(order), step, kept, len(here), gone, sum(r[1] == {f} for r in own), sum(r[2][0] == 1 for r in here), sum(r[2][1] == 1 for r in here), f))
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


WORDS = [f"word{i}" for i in range(120)]
ODD_DOCS = [
    (40, " ".join(WORDS), "en"), (30, " ".join(WORDS), "fr"), (20, " ".join(WORDS), "en"), (20, " ".join(WORDS), "en"), (10, " ".join(WORDS), None),
    (11, "LOUD TEXT", "en"), (5, "LOUD TEXT", "en"), (6, None, "en"), (4, "", ""), (None, "", "de"), (None, " ".join(WORDS), "en"), (50, "a " * 200, "en"), (51, "a # b " * 60, "fr"),
    (60, " ".join(WORDS) + " x", "en"), (61, "\n".join(WORDS * 300), "en"), (62, "\n".join(WORDS * 300), "en"), (1, "\n".join(WORDS * 300), "en"),
]
ODD_LABELS = [(40, 1, 0), (20, 1, 1), (20, 0, 0), (10, None, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (1, 1, 1)]


def write(spark, folder, docs):
    spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, digest string").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, filter_audit.orders_table(filter_audit.counters(spark, folder)).select(*columns).collect()))


def flags(labels):
    out = {}
    for d, q, t in labels:
        old = out.get(d, (0, 0))
        out[d] = (int(old[0] or q == 1), int(old[1] or t == 1))
    return out


def test_audit_takes_files_one_by_one_and_retracts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "BATCH_BYTES", 1)
    labels, files, out = spark.createDataFrame(ODD_LABELS, LABELS), str(tmp_path / "docs"), str(tmp_path / "audit")
    for d in ODD_DOCS[:8]:  # a file each, mostly in falling order of the copies' ids
        write(spark, files, [d])
    filter_audit.audit_files(spark, files, labels, out, batches=8)
    counts = spark.read.schema(filter_audit.COUNTS).parquet(out + "/counts")
    assert counts.select("batch").distinct().count() >= 6 and counts.where("n < 0").count() >= 3  # earlier masks were taken back
    assert read(spark, out) == python_audit(ODD_DOCS[:8], flags(ODD_LABELS))
    write(spark, files, ODD_DOCS[8:])  # what comes later is taken into the same state
    filter_audit.audit_files(spark, files, labels, out)
    assert read(spark, out) == python_audit(ODD_DOCS, flags(ODD_LABELS))


def test_audit_batch_that_runs_again_counts_once(spark, tmp_path):
    labels, out = filter_audit._least_labels(spark.createDataFrame(ODD_LABELS, LABELS)), str(tmp_path / "audit")
    parts = [ODD_DOCS[:6], ODD_DOCS[6:10], ODD_DOCS[10:]]
    for number, docs in enumerate(parts):
        frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
        for _ in range(2):
            filter_audit.take_batch(frame, labels, out, number)
    assert read(spark, out) == python_audit(ODD_DOCS, flags(ODD_LABELS))


def test_audit_of_a_hot_text_folds_it(spark, tmp_path):
    rng, hot = random.Random(1), " ".join(WORDS)
    docs = [(i, hot if i % 3 == 0 else f"{hot} {i}", ("en", "fr")[i % 2]) for i in rng.sample(range(3000), 3000)]
    folder = str(tmp_path / "audit")
    for number in range(3):
        frame = spark.createDataFrame(docs[number * 1000 : number * 1000 + 1000], "doc_id long, text string, lang string").repartition(4)
        filter_audit.take_batch(frame, filter_audit._least_labels(spark.createDataFrame([], LABELS)), folder, number)
    state = spark.read.schema(filter_audit.STATE).parquet(folder + "/state")
    assert state.groupBy("digest").count().agg(F.max("count")).first()[0] <= 6
    assert read(spark, folder) == python_audit(docs, {})


def test_audit_of_nothing(spark, tmp_path):
    files, out = str(tmp_path / "docs"), str(tmp_path / "audit")
    write(spark, files, [])
    filter_audit.audit_files(spark, files, spark.createDataFrame([], LABELS), out)
    assert filter_audit.orders_table(filter_audit.counters(spark, out)).count() == 0
