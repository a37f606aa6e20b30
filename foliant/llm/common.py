"""Shared helpers of the training-data operators: scratch tables, ordered offsets, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import map_arrow as map_arrow

#: Word separators of every contract here (fixed values): space and the characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A key that holds more than this part of all rows is looked up in a broadcast table.
HEAVY = 1000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where all tasks run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared scratch folder and read it again.

    All executors see the files, so a lost executor costs a re-read and never a recomputation.
    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_offsets(df: DataFrame, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows that sort before this one, across the table.

    The rows are dealt by ranges of the order; only one total per partition (a bounded number
    of rows) is brought together. Rows must be unique in the order.
    """
    n = shuffle_partitions(df.sparkSession)
    part, size, near, total, base = spare(df, "_part", "_weight", "_local", "_total", "_base")
    dealt = materialize(df.repartitionByRange(n, *order).withColumns({part: F.spark_partition_id(), size: weight.cast("long")}), "ordered")
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(F.sum(size).alias(total))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, F.coalesce(F.sum(total).over(running), F.lit(0)).alias(base))
    local = dealt.withColumn(near, F.coalesce(F.sum(size).over(before), F.lit(0)))
    # one row for each partition, so at most as many as there are shuffle partitions
    return local.join(F.broadcast(bases), part).withColumn(out, F.col(base) + F.col(near)).drop(part, size, near, base)


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, which is materialized and narrow, to be broadcast if it has at most ``most`` rows; beyond that it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str, how: str = "left", most: int = 200_000) -> DataFrame:
    """rows joined with table: materialized, one row for each key, ``size`` rows of which have that key. Rows are read once.

    Up to ``most`` rows the table is broadcast. Beyond, rows whose key holds over 1 / HEAVY of the sizes are dealt over as many
    salts as it has such parts, and the table's row is repeated for each: at most 2 * HEAVY rows, whatever the table, so
    how many salts a key has is broadcast. Rows without a key match nothing and are dealt alike. So no key brings more than about 1 / HEAVY of the rows into one task.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    total = table.agg(F.sum(size)).first()[0] or 0
    known = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
    salts, salt = spare(rows.join(table.limit(0), keys), "salts", "salt")
    parts = F.when(F.col(size) * HEAVY > total, F.ceil(F.col(size) * HEAVY / total)).otherwise(1).cast("long")
    counted = materialize(table.select(*keys, parts.alias(salts)).where(F.col(salts) > 1), "salts")
    own = rows if how == "left" else rows.where(known)
    own = own.join(F.broadcast(counted), keys, "left")
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.when(known, F.coalesce(salts, F.lit(1))).otherwise(HEAVY))
    own = own.withColumn(salt, spread.cast("long")).drop(salts)
    given = table.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return own.join(given, [*keys, salt], how).drop(salt)


def first_by_hash(df: DataFrame, key: str, most: int, by: str) -> DataFrame:
    """The first ``most`` rows of df for each value of ``by`` (few), in the order of a hash of their key: a bounded, repeatable sample.

    Ties go by the other columns. Counts by ranges of the hash give the range that just suffices, so tasks sort
    few rows, and none falls short, however often a key repeats.
    """
    order = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 31))
    part, own = F.shiftright(order, 17), df.columns
    counts = df.groupBy(F.col(by).alias("by"), part.alias("part")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("by").orderBy("part"))
    cuts = counts.withColumn("sum", running).groupBy("by").agg(F.coalesce(F.min(F.when(F.col("sum") >= most, F.col("part"))), F.lit(1 << 31)).alias("cut"))
    by_name, cut, nth = spare(df, "by", "cut", "nth")
    cuts = materialize(cuts, "cuts").toDF(by_name, cut)
    near = df.join(F.broadcast(cuts), F.col(by) == F.col(by_name)).where(part <= F.col(cut))
    first = Window.partitionBy(by).orderBy(order, key, F.xxhash64(*own))
    return near.withColumn(nth, F.row_number().over(first)).where(F.col(nth) <= most).select(*own)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (a, b) long pairs: returns (node, component).

    component is the smallest node reachable. Alternating large-star and small-star steps: every
    node's edges are re-hung on the smallest neighbour, so hubs shrink to stars. Each step is a
    partial aggregate and an equi-join, and each round is written to the shared scratch folder.
    Nodes without an edge to another node are not returned.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = materialize(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
