"""Line dedup over a suffix array of line ids, by DataFrame functions only.

A text is the sequence of its lines that are not blank. A line is deleted if a run of consecutive
lines that contains it and has at least ``min_words`` words stands earlier, in the order of
(document id, text hash, line); a run may end in the middle of neither line. Blank lines stay.

Prefix doubling: the rank of a position at depth 2**k is the place, in the order of repeated suffixes, of
the first suffix with the same 2**k lines, so equal ranks are exactly the longest-common-prefix
intervals of that depth. Depth 1 ranks come from sorting the repeated lines by their 128-bit ids,
and depth 2**(k+1) ranks from sorting, within an interval, the ranks 2**k further on. Positions that
are alone in their interval leave at once, so unique lines cost one aggregate.

Maximal repeated runs: from each position the shortest run that reaches ``min_words`` forward, and
the one that reaches it backward, have lengths that their content fixes. A maximal run with enough
words is the union of these shortest runs inside it, so it suffices to ask of each shortest run,
of l lines, for its interval: the ranks, at depth 2**floor(log2 l), of its start and of the last
such block in it. The earliest member of the interval stays, all later copies are deleted.

Hot lines: intervals are counted by partial aggregates and ordered by ranges, as distinct (rank, next
rank) pairs, and joined back by lookups that broadcast the few intervals that hold many positions.

Defined results: null texts stay null; empty texts stay; rows equal in id and text (null ids are the
same id, and sort first) are one document, and each keeps what that document keeps; a document of
which nothing but blank lines is left after deletions is dropped by ``drop_emptied``; extra columns
stay; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, spare, with_offsets

MIN_WORDS = 8
POSITION = ["id", "h", "n"]


def _line_table(docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """(id, h, n, at, words, a, b): lines that aren't blank, once for each (id, text); id is a struct, so null ids join too."""
    words = lambda x: F.least(F.lit(least), F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+", least + 1), lambda w: w != "")))
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: s["line"].rlike("[^\\x20\\x09-\\x0D]"))
    flat = docs.where(F.col(text).isNotNull()).select(F.struct(F.col(doc).alias("id")).alias("id"), F.xxhash64(text).alias("h"), F.posexplode(lines).alias("n", "s"))
    table = flat.select("id", "h", "n", "s.at", words(F.col("s.line")).alias("words"), F.xxhash64(F.lit(1), "s.line").alias("a"), F.xxhash64(F.lit(2), "s.line").alias("b"))
    return table.dropDuplicates(POSITION)


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals with two members at least: keys, members, first (the earliest position)."""
    return df.groupBy(*keys).agg(F.count("*").alias("members"), F.min(F.struct(*POSITION)).alias("first")).where("members > 1")


def _ranks(lines: DataFrame, least: int) -> list[DataFrame]:
    """For each depth 2**k up to ``least`` lines: (id, h, n, rank), of repeated prefixes only."""
    groups = materialize(with_offsets(_first(lines, ["a", "b"]).drop("first"), [F.col("a"), F.col("b")], F.col("members"), "rank"), "groups")
    at_depth = [materialize(lookup(lines, groups, ["a", "b"], "members", "inner").select(*POSITION, "words", "at", "rank"), "ranks")]
    k = 0
    while 2 ** (k + 1) <= least:
        step = 2**k
        along = Window.partitionBy("id", "h").orderBy("n")
        near = at_depth[-1].select(*POSITION, "rank", F.lead("rank", step).over(along).alias("then"), F.lead("n", step).over(along).alias("m"))
        pairs = materialize(near.where(F.col("m") == F.col("n") + step).drop("m"), "pairs")
        counted = pairs.groupBy("rank", "then").agg(F.count("*").alias("members")).where("members > 1")
        counted = materialize(with_offsets(counted, [F.col("rank"), F.col("then")], F.col("members"), "deeper"), "counted")
        at_depth.append(materialize(lookup(pairs, counted, ["rank", "then"], "members", "inner").select(*POSITION, F.col("deeper").alias("rank")), "ranks"))
        k += 1
    return at_depth


def _shortest(frame: Column, start: Column, sign: int, least: int) -> Column:
    """Lines that the frame (structs n, words; in order) needs from ``start`` on to reach ``least`` words, or null."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len"), F.lit(True).alias("on"))

    def step(acc: Column, x: Column) -> Column:
        go = acc["on"] & (acc["sum"] < least) & (x["n"] == start + sign * acc["len"])
        return F.struct(
            F.when(go, acc["sum"] + x["words"]).otherwise(acc["sum"]).alias("sum"), F.when(go, acc["len"] + 1).otherwise(acc["len"]).alias("len"), (go | (acc["sum"] >= least)).alias("on")
        )

    return F.aggregate(frame, zero, step, lambda acc: F.when(acc["sum"] >= least, acc["len"]))


def repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, h, at array<int>) of documents with lines to delete, and the line table."""
    lines = materialize(_line_table(docs, doc, text, min_words), "lines")
    at_depth = _ranks(lines, min_words)
    along = Window.partitionBy("id", "h").orderBy("n")
    one = F.struct("n", "words")
    runs = at_depth[0].select(
        *POSITION,
        _shortest(F.collect_list(one).over(along.rowsBetween(0, min_words - 1)), F.col("n"), 1, min_words).alias("ahead"),
        _shortest(F.reverse(F.collect_list(one).over(along.rowsBetween(1 - min_words, 0))), F.col("n"), -1, min_words).alias("back"),
    )
    spans = F.array(F.struct(F.col("n"), F.col("ahead").alias("len")), F.struct((F.col("n") - F.col("back") + 1).alias("n"), F.col("back").alias("len")))
    runs = runs.select("id", "h", F.explode(F.array_distinct(F.filter(spans, lambda s: s["len"].isNotNull()))).alias("s")).select("id", "h", "s.n", "s.len").distinct()
    runs, parts = materialize(runs, "runs"), []
    for k, ranks in enumerate(at_depth):
        size = 2**k
        own = runs.where((F.col("len") >= size) & (F.col("len") < 2 * size))
        named = own.join(ranks.select(*POSITION, "rank"), POSITION)
        if size > 1:
            last = ranks.select("id", "h", F.col("n").alias("m"), F.col("rank").alias("end_rank"))
            named = named.withColumn("m", F.col("n") + F.col("len") - size).join(last, ["id", "h", "m"]).drop("m")
        else:
            named = named.withColumn("end_rank", F.col("rank"))
        parts.append(named)
    named = materialize(reduce(DataFrame.unionByName, parts), "named")
    keys = ["len", "rank", "end_rank"]
    later = lookup(named, materialize(_first(named, keys), "first"), keys, "members", "inner").where(F.struct(*POSITION) > F.col("first"))
    gone = later.select("id", "h", F.explode(F.expr("sequence(n, n + len - 1)")).alias("n")).distinct()
    gone = gone.join(at_depth[0].select(*POSITION, "at"), POSITION)
    return gone.groupBy("id", "h").agg(F.collect_list("at").alias("gone")).select("id.id", "h", "gone"), lines.withColumn("id", F.col("id.id"))


def _without(lines: Column, lost: str) -> Column:
    """The lines between those whose ascending positions are in ``lost``."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(lost, i - 1) + 1)
    between = lambda x, i: F.slice(x, begin(i) + 1, F.coalesce(F.get(lost, i), F.size(x)) - begin(i))
    # the outer transform names the split lines once for all slices
    return F.transform(F.array(lines), lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), lambda i: between(x, i))))[0]


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = True, deleted: str | None = None) -> DataFrame:
    """docs with later copies of repeated line runs deleted; ``deleted`` names a new column with the number of deleted lines."""
    gone, _ = repeated_lines(docs, doc, text, min_words)
    own, h, lost = spare(docs, "own", "h", "lost")
    keyed = docs.withColumns({own: F.struct(F.col(doc).alias("id")), h: F.xxhash64(F.col(text))})
    gone = gone.select(F.struct("id").alias(own), F.col("h").alias(h), F.array_sort("gone").alias(lost))
    joined = keyed.join(gone, [own, h], "left")
    kept = F.array_join(_without(F.split(F.col(text), "\n"), lost), "\n")
    out = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept))
    if drop_emptied:
        out = out.where(F.col(lost).isNull() | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    return out.select(*docs.columns, *([] if deleted is None else [F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(deleted)]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its deleted lines and what is left of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, drop_emptied=False, deleted="n_deleted")
    return out.select("doc_id", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")
