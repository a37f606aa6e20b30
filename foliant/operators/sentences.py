"""Sentence boundaries (F22, A10) with abbreviations learnt from the corpus.

A word is an abbreviation if it stands with a period behind it much more often than chance has it: the log-likelihood
ratio of that collocation, against a word that nearly always has one, weighed by three factors: short words count more,
inner periods count more, and each occurrence without a period counts against it. All counts are grouped aggregates over all texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, py_strip

#: From this score on a word is an abbreviation, and how sure a period behind one is (fixed values of the method).
LEAST, SURE = 0.3, 0.99
#: Up to so many abbreviations are sent to tasks as a list; any number beyond is found by a join, up to FEW of them with a broadcast table.
MOST, FEW = 10_000, 200_000
#: Over so many tasks the ends of pieces with one word are dealt where the table is larger, and the copies of a text that more than this part of all rows hold.
SALTS, HEAVY = 32, 1000
#: Longer words are none.
LETTERS = 12
#: What texts are cut with: abbreviations, or the column that ``learn`` has made of them.
Known = list[str] | tuple[str, ...] | Column


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, dotted, plain): how often each lower-cased word of letters (and inner periods) stands with and without a period behind it."""
    tokens = docs.select(F.explode(F.split(F.lower(F.col(text)), "\\s+")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))  # each different token is looked at once
    bare = F.regexp_replace("t", "^[^\\p{L}]+|[^\\p{L}.]+$", "")
    words = tokens.select(bare.alias("t"), "n").where(F.col("t").rlike("^\\p{L}+(\\.\\p{L}+)*\\.?$"))
    dotted = F.col("t").endswith(".")
    word = F.when(dotted, F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.col("t"))
    return words.groupBy(word.alias("word")).agg(F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("dotted"), F.sum(F.when(dotted, 0).otherwise(F.col("n"))).alias("plain"))


def scores(counted: DataFrame) -> DataFrame:
    """counted with the score of each word that ever has a period."""
    total = counted.agg(F.sum("dotted").alias("d"), F.sum(F.col("dotted") + F.col("plain")).alias("n")).first()
    share = (total["d"] or 0) / total["n"] if total["n"] else 0.0
    if not 0 < share < 1:
        return counted.where("dotted > 0").withColumn("score", F.lit(0.0))
    k, plain = F.col("dotted"), F.col("plain")
    ratio = 2 * (k * F.lit(math.log(SURE / share)) + plain * F.lit(math.log((1 - SURE) / (1 - share))))
    letters = F.length(F.regexp_replace("word", "\\.", ""))
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -plain.cast("double"))
    return counted.where("dotted > 0").withColumn("score", score)


def learnt(counted: DataFrame) -> DataFrame:
    """(word): all abbreviations among the words counted, without their last period."""
    return scores(counted).where((F.col("score") >= LEAST) & (F.length("word") <= LETTERS)).select("word")


def abbreviations(docs: DataFrame, text: str = "text") -> list[str]:
    """The corpus's abbreviations, lower-cased, without their last period: all of them, so for as many as the driver holds; ``learn`` takes any number."""
    counted = counts(docs, text).persist()  # two jobs read the words, one the texts
    try:
        return sorted(r["word"] for r in learnt(counted).collect())
    finally:
        counted.unpersist()


def learn(docs: DataFrame, text: str = "text", out: str = "goes_on", most: int = MOST, few: int = FEW) -> tuple[DataFrame, Known]:
    """docs, and what the functions here take as ``known`` for their texts.

    Up to ``most`` abbreviations that is their list. Beyond, docs get the column ``out``, the places of those pieces of
    a text that end with one: no more than ``most`` + 1 words come to the driver, and none is left out.
    """
    counted = counts(docs, text).persist()
    try:
        found = learnt(counted)
        some = found.limit(most + 1).collect()
        if len(some) <= most:
            return docs, sorted(r["word"] for r in some)
        found = found.persist()  # the words alone stay, so that texts aren't counted again
        return going_on(docs, found, text, out, found.count() <= few), F.col(out)
    finally:
        counted.unpersist()


def going_on(docs: DataFrame, found: DataFrame, text: str = "text", out: str = "goes_on", small: bool = False) -> DataFrame:
    """docs with ``out``: the places, from 0, of the pieces of a text that end with a found word (each once) and its period; null: none. small: found is broadcast."""
    own = docs.drop(out).withColumn("_digest", F.unhex(F.sha2(text, 256)))
    ends = F.transform(_cut(F.col(text)), lambda s: F.when(F.endswith(s, F.lit(".")), _last(s, LETTERS)))
    rows = own.select("_digest", F.posexplode(ends).alias("_place", "word")).where("word <> ''")
    if small:
        hits = rows.join(F.broadcast(found), "word", "left_semi")
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, ["word", "_salt"], "left_semi")
    places = hits.groupBy("_digest").agg(F.sort_array(F.collect_set("_place")).alias(out))  # equal texts have equal places
    copies = own.groupBy("_digest").agg(F.count("*").alias("_n")).where("_digest IS NOT NULL").persist()
    try:
        total = copies.agg(F.sum("_n")).first()[0] or 0
        often = [(r["_digest"], -(-r["_n"] * HEAVY // total)) for r in copies.where(F.col("_n") * HEAVY > total).collect()]  # fewer than HEAVY texts
    finally:
        copies.unpersist()
    salts = F.broadcast(docs.sparkSession.createDataFrame(often, "_digest binary, _salts long"))
    dealt = own.join(salts, "_digest", "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.when(F.col("_digest").isNull(), HEAVY).otherwise(F.coalesce("_salts", F.lit(1)))))
    places = places.join(salts, "_digest", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.drop("_salts").join(places.drop("_salts"), ["_digest", "_salt"], "left").drop("_digest", "_salt")


def _cut(text: Column) -> Column:
    marked = F.replace(F.regexp_replace(text, "([.!?])(\\s)", "$1\u0001$2"), F.lit("\n"), F.lit("\n\u0001"))
    return F.split(marked, "\u0001")


def _last(s: Column, most: int) -> Column:
    """The lower-cased word before a piece's last period, if it has ``most`` characters at most; else nothing or what is longer."""
    # only as much of a piece's end is read as such a word, its period and two characters before it take
    return F.lower(F.regexp_extract(F.right(s, F.lit(most + 3)), "(?<!\\p{L})(?<!\\p{L}\\.)(\\p{L}+(?:\\.\\p{L}+)*)\\.\\z", 1))


def _marks(places: Column) -> Column:
    """For each place up to the last one of an ascending array: whether it is there."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1)
    return F.flatten(F.transform(places, lambda x, i: F.concat(F.array_repeat(F.lit(False), x - before(i)), F.array(F.lit(True)))))


def pieces(text: Column, known: Known = ()) -> Column:
    """A text cut at line ends and at white space behind ``.``, ``!`` or ``?``, but not behind an abbreviation's period; put together the pieces are the text."""
    cut = _cut(text)
    if isinstance(known, Column):
        return let(F.struct(cut.alias("cut"), _marks(known).alias("marks")), lambda x: _joined(x["cut"], lambda s, i: F.coalesce(F.get(x["marks"], i), F.lit(False))))
    if not known:
        return cut
    return _joined(cut, lambda s, i: F.endswith(s, F.lit(".")) & _last(s, max(map(len, known))).isin(list(known)))


def _joined(cut: Column, goes_on: Callable[[Column, Column], Column]) -> Column:
    joined = F.array_join(F.transform(cut, lambda s, i: F.when(goes_on(s, i), s).otherwise(F.concat(s, F.lit("\u0001")))), "")
    # behind the last mark stands a piece that goes on but ends the text, or nothing
    return let(F.split(joined, "\u0001"), lambda out: F.slice(out, F.lit(1), F.size(out) - F.when(F.element_at(out, -1) == "", 1).otherwise(0)))


def sentences(text: Column, known: Known = ()) -> Column:
    """Stripped sentences that aren't blank."""
    return stripped(pieces(text, known))


def stripped(cut: Column) -> Column:
    return F.filter(F.transform(cut, py_strip), lambda s: s != "")
