"""Abbreviations from the corpus, names by dictionary, pictures in colour, and the cheap test for corrections."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from foliant.functions import correct
from foliant.operators import enrich, images, names, sentences
from foliant.sources import pictures
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- sentences


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    nouns = ["house", "garden", "river", "letter", "winter", "doctor", "market", "bridge", "window", "table"]
    lines = []
    for i in range(400):
        words = [rng.choice(nouns) for _ in range(rng.randint(4, 9))]
        words[1] = rng.choice(["M. Dupont", "Dr. House", "e.g. bread", "Mme. Curie", words[1], words[1]])
        lines.append((i, (" ".join(words) + ".").capitalize() if i % 9 else None))
    return spark.createDataFrame(lines, "doc_id int, text string")


def test_counts_and_scores_equal_plain_loops(spark, corpus):
    dotted, plain = Counter(), Counter()
    for r in corpus.where("text IS NOT NULL").collect():
        for t in r["text"].lower().split():
            t = re.sub(r"^[^a-z]+|[^a-z.]+$", "", t)
            if re.fullmatch(r"[a-z]+(\.[a-z]+)*\.?", t):
                (dotted if t.endswith(".") else plain)[t.removesuffix(".")] += 1
    n, d = sum(dotted.values()) + sum(plain.values()), sum(dotted.values())
    got = {r["word"]: r for r in sentences.scores(sentences.counts(corpus)).collect()}
    assert set(got) == set(dotted)
    for word, r in got.items():
        k, p, letters = dotted[word], plain[word], len(word.replace(".", ""))
        ratio = 2 * (k * math.log(0.99 / (d / n)) + p * math.log(0.01 / (1 - d / n)))
        assert (r["dotted"], r["plain"]) == (k, p) and r["score"] == pytest.approx(ratio * math.exp(-letters) * (len(word) - letters + 1) * letters ** -float(p))
    known = sentences.abbreviations(corpus)
    assert {"m", "dr", "e.g", "mme"} <= set(known) and not {"house", "garden", "doctor"} & set(known)


def test_abbreviations_end_no_sentence(spark, corpus):
    known = sentences.abbreviations(corpus)
    text = F.lit("M. Dupont came. Dr. House left!  He saw e.g. bread? Yes.\nM.\nNEXT PART\n \nlast M. ")
    assert one(spark, sentences.sentences(text, known)) == ["M. Dupont came.", "Dr. House left!", "He saw e.g. bread?", "Yes.", "M.", "NEXT PART", "last M."]
    assert "".join(one(spark, sentences.pieces(text, known))) == one(spark, text)
    assert [s["kind"] for s in one(spark, enrich.structure(F.lit("M. Dupont is here. ALL OF IT."), known))] == ["paragraph", "heading"]
    assert one(spark, enrich.structure(F.lit("M. Dupont"), ()))[0]["kind"] == "heading"  # what the plain pattern makes of it
    assert one(spark, enrich.key_phrases(text, enrich.entities(text), known=known))[:2] == ["M. Dupont came.", "Dr. House left!"]
    row = one(spark, enrich.enrich(text, known=known))
    assert row["sentence_count"] == 7


def test_sentences_of_nothing(spark):
    assert sentences.abbreviations(spark.createDataFrame([(None,), ("",), ("no periods here",)], "text string")) == []
    assert one(spark, sentences.sentences(F.lit(""), ["m"])) == [] and one(spark, sentences.sentences(F.lit(None).cast("string"), ["m"])) is None
    long = one(spark, sentences.sentences(F.lit("M. A came. " * 3000), ["m"]))
    assert len(long) == 3000 and long[1] == "M. A came."


# ---- names


def python_names(text, named):
    found = []
    for name, label in named:
        for m in re.finditer(f"(?={re.escape(name)})", text):
            a, b = m.start(), m.start() + len(name)
            word = lambda c: c.isalnum() or c == "_"
            if (a == 0 or not (word(text[a - 1]) and word(text[a]))) and (b == len(text) or not (word(text[b]) and word(text[b - 1]))):
                found.append((a, b, label))
    out = []
    for s in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def test_names_equal_plain_search_in_one_part_or_many(spark):
    rng = random.Random(6)
    bits = ["North", "South", "Sea", "of", "Été", "New", "York", "_x", "#1"]
    named = sorted({(" ".join(rng.choices(bits, k=rng.randint(1, 3))), rng.choice(["LOC", "ORG"])) for _ in range(60)})
    named = [(n, next(label for m, label in named if m == n)) for n in sorted({n for n, _ in named})]
    texts = [(i, rng.choice([" ", "  ", ", ", ""]).join(rng.choices([*bits, "word"], k=30))) for i in range(80)] + [(100, None), (101, ""), (102, "New York " * 5000)]
    frame = spark.createDataFrame(texts, "i int, text string").withColumn("label", F.lit("other")).repartition(3)
    table = spark.createDataFrame([*named, ("", "LOC"), (None, "LOC")], "name string, label string")
    expected = {i: python_names(t or "", named) for i, t in texts}
    for size in (names.PART_BYTES, 300):
        got = {r["i"]: [tuple(s) for s in r["names"]] for r in names.find_names(frame, table, part_bytes=size).collect()}
        assert got == expected
    assert all(r["names"] == [] for r in names.find_names(frame, table.where("false")).collect())


def test_names_stand_before_the_rule_and_reach_relevance(spark):
    frame = spark.createDataFrame([("Paris Bank met Anna in New York\nin 1999.",)], "text string")
    found = names.find_names(frame, spark.createDataFrame([("Paris Bank", "ORG"), ("New York", "LOC")], "name string, label string"))
    row = found.select(enrich.enrich(F.col("text"), F.col("names")).alias("e")).first()["e"]
    assert [(e["text"], e["label"], e["start"], e["pos"]) for e in row["entities"]] == [("Paris Bank", "ORG", 0, 0), ("Anna", "PERSON", 15, 3), ("New York", "LOC", 23, 5), ("1999", "DATE", 35, 8)]
    assert row["relevance_score"] == pytest.approx(0.5 * 4 / 9 + 0.5) and len(row["relations"]) == 6


# ---- pictures


def png(pixels):
    """An encoded picture: rows of red, green, blue (opacity), or of grey."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_encoded_pictures_come_back_as_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    shown = {"rgb": rng.integers(0, 256, (9, 10, 3)), "flat": np.full((8, 8, 3), 77), "alpha": rng.integers(0, 256, (5, 4, 4)), "grey": rng.integers(0, 256, (6, 7)), "wide": rng.integers(0, 256, (2, 40, 3))}
    (tmp_path / "in").mkdir()
    for name, pixels in shown.items():
        (tmp_path / f"{'in/' if name == 'wide' else ''}{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    frame = pictures.read_pictures(spark, str(tmp_path))
    rows = {r["path"].rpartition("/")[2].removesuffix(".png"): r for r in frame.collect()}
    assert set(rows) == {*shown, "broken"} and rows["broken"]["pixels"] is None and rows["broken"]["width"] is None
    for name, pixels in shown.items():
        r = rows[name]
        assert (r["height"], r["width"]) == pixels.shape[:2]
        flat = pixels.reshape(-1, 1 if pixels.ndim == 2 else pixels.shape[2])
        if pixels.ndim == 2:
            assert r["mode"] == "L" and r["colours"] is None and r["pixels"] == flat[:, 0].tolist()
        else:
            assert r["pixels"] == [(int(x[0]) * 19595 + int(x[1]) * 38470 + int(x[2]) * 7471 + 32768) >> 16 for x in flat]
            assert r["colours"] == min(50, len({tuple(x) for x in flat.tolist()}))
    kind = images.image_kind(F.col("width"), F.col("height"), F.coalesce("colours", F.lit(0)), F.col("mode") == "RGB")
    kinds = {r["path"].rpartition("/")[2].removesuffix(".png"): r["k"] for r in frame.select("path", kind.alias("k")).collect()}
    assert kinds["flat"] == "diagramme" and kinds["rgb"] == "image" and kinds["wide"] == "graphique" and kinds["grey"] == "image"
    # the filters take what was colour
    for method in ("basic", "advanced", "aggressive"):
        made = images.filtered(frame.withColumn("method", F.lit(method)), lambda p, m: images.preprocess(p, m), ("method",))
        for r in made.where("pixels IS NOT NULL").collect():
            before = rows[r["path"].rpartition("/")[2].removesuffix(".png")]
            assert r["pixels"] == images.preprocess(np.array(before["pixels"], np.uint8).reshape(before["height"], before["width"]), method).ravel().tolist()


def test_colours_are_counted_across_chunks(monkeypatch):
    monkeypatch.setattr(pictures, "CHUNK", 8)
    pixels = np.repeat(np.arange(45, dtype=np.uint8)[:, None], 3, axis=1)
    assert pictures.colours(np.concatenate([pixels, pixels[::-1]])) == 45 and pictures.colours(np.arange(300).reshape(-1, 3).astype(np.uint8), 7) == 7


# ---- corrections


def test_whatever_a_rule_changes_is_seen_by_the_cheap_test(spark):
    rng = random.Random(9)
    parts = ["cudi", "CUDL", "eudi", "lus  d'infos", "d'fos", "tol N°", "ou 16 OCTOBRE", "ou  3 janvier", "Pérode", "b Période", "REPUBLIQUE  DEMOCRATIQUE", "mbre", "congo", "24 décembre", "ou\t16", "5  mbre  2020", "JOURNAL  OFFICIEL REPUBLIQUE", "1 2 2025", "d’infos", "cudı", "word", "12", "ou", "M Per"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(300)] + parts
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rules = [*correct.FIRST_RULES[:-1], *correct.WORD_RULES, *correct.DATE_RULES, *correct.FRENCH_RULES]
    changed = correct.fold(correct.fold(c, [("\\s+", " ")]), rules)
    for r in frame.select("t", correct.may_change(c).alias("may"), (changed != correct.fold(c, [("\\s+", " ")])).alias("changed")).collect():
        assert r["may"] or not r["changed"], r["t"]
    assert not one(spark, correct.may_change(F.lit("nothing here to be put right in 1999, or ever")))
