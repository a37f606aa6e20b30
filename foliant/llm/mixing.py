"""Mixing sources to target weights by pivotal dependent rounding, by DataFrame functions only.

Targets come from water-filling over one row per source. Every document then wants
target / source size copies: the whole part is sure, the fraction is a probability. Fractions are
rounded pairwise: a pair moves mass at random until one of the two is 0 or 1, so the sum of copies
is kept and only one fraction is left over. Groups of about ``BLOCK`` documents of one source and
similar size are rounded first; their single residuals meet in groups of the next level, a
reduction tree of depth log(n) / log(BLOCK), and at last the few residuals of a source, in the order
of size, so that mass moves between documents of almost equal size.

Probabilities are integers in units of 2**-40, and random draws are hashes of the documents, so
reruns agree exactly. Rows equal in id, text and source are folded into one unit first, which gets
the whole part of its rows' copies and one fraction. Groups are dealt by a hash of the document within its source and size class,
with as many groups as the class needs: a source with a third of all rows is many groups.

Defined results: null text has size 0; null sources form one source, sorted last; repeated rows share
their unit's copies evenly; a source without words has target 0; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small_side, spare, with_offsets

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 64
ONE = 1 << 40


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) per document to (source, source_size, target) per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_offsets(sources, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("double")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("source_size") * cap
        got = ranked.agg(
            F.sum(F.when(over, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")
        ).first()
        if got["n"] == capped or not got["open"]:
            break
        level, capped = (share * total - (got["full"] or 0.0)) / got["open"], got["n"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, F.col("source_size") * cap).alias("target"))


#: Rounds one sorted group: the accumulator holds the open unit, its probability and all decisions.
ROUND = f"""
aggregate(sequence(0, size(units) - 1), named_struct('at', -1, 'p', 0L, 'out', cast(array() as array<struct<i:int,d:int>>)), (a, x) ->
  CASE
  WHEN a.at < 0 THEN named_struct('at', x, 'p', units[x].p, 'out', a.out)
  WHEN a.p + units[x].p < {ONE}L THEN
    CASE WHEN pmod(xxhash64(units[x].key, units[a.at].key, x), a.p + units[x].p) < units[x].p
      THEN named_struct('at', x, 'p', a.p + units[x].p, 'out', concat(a.out, array(named_struct('i', a.at, 'd', 0))))
      ELSE named_struct('at', a.at, 'p', a.p + units[x].p, 'out', concat(a.out, array(named_struct('i', x, 'd', 0)))) END
  WHEN pmod(xxhash64(units[x].key, units[a.at].key, x), 2 * {ONE}L - a.p - units[x].p) < {ONE}L - a.p
    THEN named_struct('at', a.at, 'p', a.p + units[x].p - {ONE}L, 'out', concat(a.out, array(named_struct('i', x, 'd', 1))))
    ELSE named_struct('at', x, 'p', a.p + units[x].p - {ONE}L, 'out', concat(a.out, array(named_struct('i', a.at, 'd', 1)))) END)
"""


def mix_sources(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, key (a hash of id and text), source, size, source_size, target, copies."""
    sizes = materialize(
        docs.select(
            F.col(doc).alias("doc_id"),
            F.xxhash64(F.col(doc), F.col(text)).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(sizes).withColumn("s", F.struct("source"))
    units = sizes.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("rows"))
    rows = units.withColumn("s", F.struct("source")).join(targets.drop("source"), "s").drop("s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("rows")).otherwise(0.0)
    rows = rows.withColumn("sure", F.floor(wanted).cast("long")).withColumn("p", F.round((wanted - F.col("sure")) * ONE).cast("long"))
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
    classes = rows.groupBy("source", "class").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("groups")).withColumn("c", F.struct("source", "class"))
    most = classes.agg(F.max("groups")).first()[0] or 1
    rows = rows.withColumn("c", F.struct("source", "class")).join(classes.select("c", "groups"), "c").drop("c")
    rows = materialize(rows.withColumn("g", F.expr("pmod(xxhash64(key, 17), groups)")).drop("groups"), "units")
    kept = ["doc_id", "key", "source", "size", "source_size", "target", "rows", "sure"]
    settled = lambda df, d: df.select(*kept, (F.col("sure") + d).alias("total"))
    done, open_units = [], rows
    depth = 1 + math.ceil(math.log(most, BLOCK)) if most > 1 else 1
    for level in range(depth + 1):
        done.append(settled(open_units.where(f"p <= 0 OR p >= {ONE}L"), F.when(F.col("p") >= ONE, 1).otherwise(0)))
        by = ["source", "class", "g"] if level < depth else ["source"]
        unit = F.struct("size", "key", "p", "doc_id", "source_size", "target", "rows", "sure", "class", "g")
        groups = open_units.where(f"p > 0 AND p < {ONE}L").groupBy(*by).agg(F.array_sort(F.collect_list(unit)).alias("units"))
        rounded = groups.select("source", "units", F.expr(ROUND).alias("r"))
        every = F.concat(
            F.transform("r.out", lambda o: F.struct(o["i"].alias("i"), (o["d"].cast("long") * ONE).alias("q"))),
            F.array(F.struct(F.col("r.at").alias("i"), F.col("r.p").alias("q"))),
        )
        flat = rounded.select("source", F.explode(F.transform(every, lambda e: F.struct(F.get("units", e["i"]).alias("unit"), e["q"].alias("q")))).alias("e"))
        flat = flat.select("source", "e.unit.*", "e.q").drop("p").withColumnRenamed("q", "p")
        flat = materialize(flat.withColumn("g", F.floor(F.col("g") / BLOCK)), "rounded")
        done.append(settled(flat.where(f"p <= 0 OR p >= {ONE}L"), F.when(F.col("p") >= ONE, 1).otherwise(0)))
        open_units = flat.where(f"p > 0 AND p < {ONE}L")
    done.append(settled(open_units, F.when(F.expr(f"pmod(xxhash64(key, 29), {ONE}L) < p"), 1).otherwise(0)))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    out = out.withColumn("nth", F.explode(F.expr("sequence(1L, rows)")))
    copies = F.floor(F.col("total") / F.col("rows")) + (F.col("nth") <= F.col("total") % F.col("rows")).cast("long")
    return out.withColumn("copies", copies).drop("nth", "total", "rows", "sure")


#: Copies that one task writes of one row.
COPIES = 4096


def apply_mix(docs: DataFrame, mixed: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows taken 0 times go.

    Rows that are equal in id, text and source share their copies: each gets the whole part of the mean, and
    some get one more. Those rows are folded, by a hash of all their columns, and dealt out again in
    portions, so a row that a third of all rows repeat is written by many tasks; all others stay where they are.
    """
    key, copies, rows, row, share = spare(docs, "key", "copies", "rows", "row", "share")
    per = materialize(mixed.groupBy(F.xxhash64("key", "source").alias(key)).agg(F.sum("copies").cast("long").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0), "per")
    keyed = docs.withColumn(key, F.xxhash64(F.xxhash64(F.col(doc), F.col(text)), F.col(source).cast("string")))
    again = lambda df, times: df.withColumn(share, F.explode(F.expr(f"sequence(1L, {times})"))).select(*docs.columns)
    single = again(keyed.join(small_side(per.where(F.col(rows) == 1)), key), copies)

    repeated = keyed.join(small_side(per.where(F.col(rows) > 1)), key).withColumn(row, F.xxhash64(F.to_json(F.struct(*docs.columns))))
    kinds = repeated.groupBy(key, row).agg(F.any_value(F.struct(*docs.columns)).alias("one"), F.first(copies).alias("copies"), F.first(rows).alias("rows"), F.count("*").alias("n"))
    kinds = materialize(kinds, "kinds")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = kinds.select(key, row, "copies", "rows", "n", before.alias("before"))
    more = F.least(F.col("n"), F.greatest(F.lit(0), F.col("copies") % F.col("rows") - F.col("before")))
    counted = counted.select(key, row, (F.col("n") * F.floor(F.col("copies") / F.col("rows")) + more).alias("times")).where("times > 0")
    portions = F.explode(F.expr(f"transform(sequence(0L, (times - 1) div {COPIES}), i -> least({COPIES}L, times - i * {COPIES}))"))
    dealt = kinds.join(counted, [key, row]).select("one", key, row, portions.alias(share)).withColumn(key, F.xxhash64(key, row, F.monotonically_increasing_id()))
    return single.unionByName(again(dealt.repartition(key).select("one.*", share), share))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
