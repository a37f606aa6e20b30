"""Filter interaction audit by a stream of files with retractions.

A stream takes all files as available-now micro-batches of bounded bytes. Each batch is folded, by columns only, to one row a text, part and
pair of labels: the text's SHA-256, the mask of the filters it fails by itself, its least id, and how many rows have
that id or any. A keyed text state, a log on the shared folder to which every batch adds, holds for
each text its least id so far and what was counted under it. A batch meets only the state of its own texts: its rows
beyond the least id fail the filter for copies; and where a smaller id arrives, the rows counted before under the former least id
are retracted from the counter of their old mask and counted under the mask with the copy filter added. The counters of a part
(masks and labels, at most 128) are sums of what batches counted, and any order of filters is read off them.

The log only grows and a text's state is its least id, so a batch that runs again after a failure writes its own folder
anew from the batches before it: every row counts once. Copies are folded before they are shuffled, so a text that a third of all rows
share is one row from each task. Batches hold a ``1 / BATCHES`` part of the bytes, or more where files are larger, so the
state is read a bounded number of times; ``audit_files`` takes new files into the same folder later.

Defined results: null text counts as empty; empty texts fail the first filter, and the second and third not; a row without an id
is no copy and has no labels, nor does it make others copies; repeated rows count each, and are no copies of one another; null
language is the part of the empty string; labels of an id with several rows hold if one of them says so; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

FILTERS = "ABCDE"
#: The bit of a filter in a mask: A is 1, E is 16.
COPY = 1 << FILTERS.index("E")
#: Micro-batches that one call makes of its files, and the least bytes of one.
BATCHES, BATCH_BYTES = 4, 1 << 20
STATE = "batch int, digest binary, mask int, part string, good boolean, toxic boolean, id long, n long"
COUNTS = "batch int, part string, mask int, good boolean, toxic boolean, n long"
KEY = ["digest", "mask", "part", "good", "toxic"]


def own_mask(text: Column) -> Column:
    """The filters A to D that a text fails by itself."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def tests(x: Column) -> Column:
        few = x["n"] < 100
        same = 100 * x["distinct"] < 80 * x["n"]
        loud = 100 * capitals > 10 * F.length(text)
        marked = text.rlike("[#$%&*|]")
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, same, loud, marked))), F.lit(0))

    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return F.get(F.transform(counted, tests), F.lit(0))


def _least_labels(labels: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def fold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a text, part and labels: its least id, the rows with that id, and all rows; rows without an id have their own.

    labels: (id, good, toxic), one row an id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask(F.col("text")).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    known = rows.where("id IS NOT NULL").join(labels, "id", "left").select("id", "n", "digest", "mask", "part", flag("good"), flag("toxic"))
    known = known.groupBy(*KEY).agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("rows"))
    unknown = rows.where("id IS NULL").groupBy("digest", "mask", "part").agg(F.sum("n").alias("n"))
    unknown = unknown.select("digest", "mask", "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.struct(F.lit(None).cast("long").alias("id"), "n").alias("least"), F.col("n").alias("rows"))
    return known.unionByName(unknown).select(*KEY, "least.id", "least.n", "rows")


def _settle(batch: DataFrame, state: DataFrame) -> DataFrame:
    """The batch's folded rows beside the state of their texts, each with the text's least id before and now."""
    own = batch.where("id IS NOT NULL").withColumn("before", F.lit(False))
    texts = own.select("digest").distinct()
    held = state.join(texts, "digest", "left_semi").select(*KEY, "id", "n", F.lit(0).cast("long").alias("rows"), F.lit(True).alias("before"))
    w = Window.partitionBy("digest")
    return own.unionByName(held).withColumns({"was": F.min(F.when(F.col("before"), F.col("id"))).over(w), "now": F.min("id").over(w)})


def _changes(met: DataFrame, batch: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): what a batch adds to the counters, and takes from them."""
    copied = F.col("mask").bitwiseOR(F.lit(COPY))
    entry = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    first = F.col("id") == F.col("now")
    fresh = F.array(entry(F.col("mask"), F.when(first, F.col("n")).otherwise(F.lit(0))), entry(copied, F.col("rows") - F.when(first, F.col("n")).otherwise(F.lit(0))))
    retracted = F.array(entry(F.col("mask"), -F.col("n")), entry(copied, F.col("n")))
    none = F.array().cast("array<struct<mask:int,n:bigint>>")
    each = F.when(~F.col("before"), fresh).when((F.col("id") == F.col("was")) & (F.col("now") < F.col("was")), retracted).otherwise(none)
    known = met.select("part", "good", "toxic", F.explode(each).alias("e")).select("part", "e.mask", "good", "toxic", "e.n")
    unknown = batch.where("id IS NULL").select("part", "mask", "good", "toxic", "n")
    return known.unionByName(unknown).where("n <> 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def take_batch(docs: DataFrame, labels: DataFrame, folder: str, number: int) -> None:
    """Count one micro-batch: write its part of the state and of the counters, from those of the batches before it."""
    spark = docs.sparkSession
    batch = materialize(fold(docs, labels), "folded")
    state = _earlier(spark, f"{folder}/state", STATE, number)
    met = materialize(_settle(batch, state), "met")
    kept = met.where("NOT before AND id = now").select(*KEY, "id", "n")
    kept.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
    _changes(met, batch).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")


def _earlier(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """What the batches before ``number`` wrote; nothing where there was none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if number is None else rows.where(F.col("batch") < number)


def _input(spark: SparkSession, path: str) -> tuple[str, int]:
    """The path as a stream takes it, and all bytes below it, by two calls of the file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # a stream takes folders or patterns, so one file is a pattern that only it fits
    named = path if store.getFileStatus(where).isDirectory() else f"{path[:-1]}[{path[-1]}]"
    return named, store.getContentSummary(where).getLength()


def audit_files(spark: SparkSession, path: str, labels: DataFrame, folder: str, batches: int = BATCHES) -> None:
    """Take all Parquet files below path that ``folder`` has not seen yet, in micro-batches, and stop."""
    known = materialize(_least_labels(labels), "labels")
    named, size = _input(spark, path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", max(BATCH_BYTES, -(-size // batches))).parquet(named)
    run = stream.select("doc_id", "lang", "text").writeStream.foreachBatch(lambda docs, number: take_batch(docs, known, folder, number))
    run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """(part, mask, good, toxic, n) over all batches so far; every part that was ever seen has its rows."""
    return _earlier(spark, f"{folder}/counts", COUNTS).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders_table(counts: DataFrame) -> DataFrame:
    """The counters read in all 120 orders: 600 rows a part, of at most 128 counters each; no row is joined with another."""
    sums = F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))
    held = counts.groupBy("part", "mask").agg(*sums).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            steps.append(("".join(order), step, own, before))
            before |= own
    columns = (F.array(*map(F.lit, x)).alias(name) for name, x in zip(("order", "step", "own", "before"), zip(*steps, strict=True), strict=True))
    rows = held.select("part", "c", F.explode(F.arrays_zip(*columns)).alias("x"))
    own, before, shares = F.col("x.own"), F.col("x.before"), F.array(*(F.lit(120 // k if k else 0) for k in range(6)))
    fails, gone = (lambda e: e["mask"].bitwiseAND(own) != 0), (lambda e: e["mask"].bitwiseAND(before) != 0)

    def total(test, value=lambda e: e["n"]) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda s, e: s + F.when(test(e), value(e)).otherwise(F.lit(0).cast("long")))

    removed = lambda e: fails(e) & ~gone(e)
    return rows.select(
        "part", F.col("x.order").alias("filter_order"), F.col("x.step").alias("step"),
        total(lambda e: ~fails(e) & ~gone(e)).alias("kept"), total(removed).alias("removed"), total(lambda e: fails(e) & gone(e)).alias("redundant"),
        total(lambda e: e["mask"] == own).alias("unique_fails"), total(removed, lambda e: e["good"]).alias("good_lost"), total(removed, lambda e: e["toxic"]).alias("toxic_lost"),
        # in 120 orders a filter removes 120 / k times what k filters fail
        total(fails, lambda e: e["n"] * F.get(shares, F.bit_count(e["mask"]))).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream all files of ``documents`` and read the counters in all orders."""
    folder = f"{scratch_dir(spark)}/audit-{uuid.uuid4().hex}"
    audit_files(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"), folder)
    return orders_table(counters(spark, folder))




def _sum(value: str, test: str) -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {test}), 0) AS BIGINT)"


_ORDERS = " || ".join(f"{c}.f" for c in "abcde")
_APART = " AND ".join(f"{x}.f <> {y}.f" for i, x in enumerate("abcde") for y in "abcde"[i + 1 :])
ORACLE_SQL = f"""
WITH least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY ALL),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(d.text, '') AS text, list_filter(string_split_regex(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(d.doc_id > least, false) AS copy,
  coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN least ON coalesce(d.text, '') = least.text LEFT JOIN said ON d.doc_id = said.doc_id),
m AS (SELECT part, good, toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT {_ORDERS} AS filter_order FROM l a, l b, l c, l d, l e WHERE {_APART}),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS before FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, own, before, mask, n, good, toxic, (mask & own) <> 0 AS fails, (mask & CAST(before AS INTEGER)) <> 0 AS gone FROM s, c)
SELECT part, filter_order, step, {_sum("n", "NOT fails AND NOT gone")} AS kept, {_sum("n", "fails AND NOT gone")} AS removed, {_sum("n", "fails AND gone")} AS redundant, {_sum("n", "mask = own")} AS unique_fails,
  {_sum("good", "fails AND NOT gone")} AS good_lost, {_sum("toxic", "fails AND NOT gone")} AS toxic_lost, {_sum("n * 120 // greatest(bit_count(CAST(mask AS INTEGER)), 1)", "fails")} AS shapley FROM x GROUP BY part, filter_order, step
"""
