"""Sharding along a Hilbert curve: runs of documents that lie close in several metadata dimensions.

Each dimension is quantised to ``2 ** BITS`` codes of nearly equal mass: its values (numbers by their 4,096 equal steps
between least and most, texts as they are) are counted over all rows, put in order, and cut
where the running count passes a code's share; a table of at most ``2 ** BITS`` bounds a dimension is all that the driver sees.
Rows are sorted by the index of their codes on the Hilbert curve, then by the values, and the order is cut into runs: by
``rows`` (counts at most one apart) or by ``bytes`` (each cut falls within one document of its share). As the curve
never leaves a cell before it is full, a run, and each file written of it, covers a small box in every dimension, and least and most values in the
Parquet footers let a filter on any of them skip most files.

Rows that are equal in every column are told apart by a number before they are sorted, so that a row which a
third of the table repeats is dealt over many tasks. Only ids, sizes and checks are moved for a digest; ``write_shards`` moves whole rows, once.

Defined results: a null text has size 1, as an empty one; a null value lies before all others of its dimension; ties are
in the order of text checks, ids and then all columns; repeated rows get places of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import materialize, spare, with_offsets

SHARDS, BITS = 16, 5
#: Equal steps into which numbers are sorted before their codes are cut.
STEPS = 4096
#: The dimensions of ``documents``; "size" is the text's.
DIMENSIONS = ("source", "lang", "size")


def hilbert(codes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve through the cube of codes below ``2 ** bits``.

    From the highest bit down, one fold undoes the turns that the curve takes in each half: where a
    dimension's bit is set the first one's lower bits are flipped, else they change places with its own.
    The Gray code of what is left, read bit by bit over the dimensions, is the index.
    """
    n = len(codes)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))
    start = F.struct(*(c.cast("int").alias(f"x{i}") for i, c in enumerate(codes)))

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.get(F.array(*(x[f"x{i}"] for i in range(n))), s["i"])
        swap = x["x0"].bitwiseXOR(own).bitwiseAND(low)
        flipped = own.bitwiseAND(s["q"]) != 0
        first = F.when(flipped, x["x0"].bitwiseXOR(low)).otherwise(x["x0"].bitwiseXOR(swap))
        other = lambda i: F.when(~flipped & (s["i"] == i), x[f"x{i}"].bitwiseXOR(swap)).otherwise(x[f"x{i}"])
        return F.struct(first.alias("x0"), *(other(i).alias(f"x{i}") for i in range(1, n)))

    def index(x: Column) -> Column:
        gray = [x["x0"]]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(x[f"x{i}"]))
        # the last dimension's bits, each summed (by parity) with all higher ones, turn the lower bits of all
        last = gray[-1]
        parity = F.lit(0)
        for b in range(bits - 1, 0, -1):
            parity = parity.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for g in gray:
                out = out * 2 + F.shiftright(g.bitwiseXOR(parity), b).bitwiseAND(F.lit(1)).cast("long")
        return out

    return F.aggregate(steps, start, turn, index)


def _level(df: DataFrame, name: str) -> Column:
    """A dimension's value as it is counted: a number's step between the least and the most, else text."""
    if not isinstance(df.schema[name].dataType, NumericType):
        return F.col(name).cast("string")
    least, most = df.agg(F.min(F.col(name).cast("double")), F.max(F.col(name).cast("double"))).first()
    wide = (most - least) if least is not None and most > least else 1.0
    return F.least(F.floor((F.col(name).cast("double") - F.lit(least or 0.0)) / wide * STEPS), F.lit(STEPS - 1)).cast("long")


def bounds(df: DataFrame, level: Column, bits: int = BITS) -> list[tuple]:
    """(least level, code) of each code in use, in order: at most ``2 ** bits``, of nearly equal mass; a value's code is where the middle of its rows lies."""
    counts = df.groupBy(level.alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    placed = with_offsets(counts, [F.col("v")], F.col("n"), "before")
    code = F.expr(f"(before * 2 + n) * {1 << bits} div (2 * {total}L)")
    cut = placed.groupBy(code.cast("int").alias("code")).agg(F.min("v").alias("v"))
    return [(r["v"], r["code"]) for r in cut.orderBy("code").collect()]


def code(level: Column, cuts: list[tuple]) -> Column:
    """The code of the last bound at or below the level; 0 for null."""
    if not cuts:
        return F.lit(0)
    at, codes = F.array(*(F.lit(v) for v, _ in cuts)), F.array(*(F.lit(c) for _, c in cuts))
    return F.coalesce(F.get(codes, F.size(F.filter(at, lambda v: v <= level)) - 1), F.lit(0))


def curve_order(docs: DataFrame, dimensions: list[str], ties: list[Column], size: Column, out: tuple[str, str, str, str], bits: int = BITS) -> DataFrame:
    """docs with out: its index on the curve, its size, the rows before it and the bytes before it."""
    h, wide, place, before = out
    (salt,) = spare(docs, "salt")
    levels = [_level(docs, d) for d in dimensions]
    codes = [code(x, bounds(docs, x, bits)) for x in levels]
    made = docs.withColumns({h: hilbert(codes, bits), wide: size, salt: F.xxhash64(F.monotonically_increasing_id())})
    order = [F.col(h), *(F.col(d) for d in dimensions), *ties, F.col(salt)]
    placed = with_offsets(materialize(made, "curve"), order, F.lit(1), place)
    return (with_offsets(placed, [F.col(place)], F.col(wide), before) if before else placed).drop(salt)


def shard(docs: DataFrame, dimensions: list[str], ties: list[Column], size: Column, law: str = "rows", shards: int = SHARDS, names: tuple[str, str] = ("shard", "slot"), bits: int = BITS) -> DataFrame:
    """docs with their shard and their place in it. ``law``: "rows" or "bytes" are near equal."""
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    h, wide, place, before, first = spare(docs, "curve", "wide", "place", "before", "first")
    placed = materialize(curve_order(docs, dimensions, ties, size, (h, wide, place, before if law == "bytes" else ""), bits), "placed")
    rows, total = placed.agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    if law == "rows":
        each, more = divmod(rows, shards)  # the first ``more`` shards have one row more
        long = F.lit(more * (each + 1))
        number = F.when(F.col(place) < long, F.expr(f"{place} div {each + 1}")).otherwise(F.expr(f"{more} + ({place} - {more * (each + 1)}) div {max(each, 1)}"))
    else:
        number = F.expr(f"cast(least({shards - 1}, (cast({before} as decimal(38,0)) * 2 + {wide}) * {shards} div {max(2 * total, 1)}) as bigint)")
    made = placed.withColumn(names[0], number.cast("int"))
    firsts = made.groupBy(names[0]).agg(F.min(place).alias(place))  # one row for each shard
    made = made.join(F.broadcast(firsts.withColumnRenamed(place, first)), names[0])
    return made.withColumn(names[1], F.col(place) - F.col(first)).select(*docs.columns, *names)


def write_shards(docs: DataFrame, folder: str, dimensions: list[str], ties: list[Column], size: Column, law: str = "rows", shards: int = SHARDS, bits: int = BITS) -> None:
    """Whole rows as Parquet, a folder a shard; every file is a run of the curve, so footers tell small boxes.

    Rows are moved once, by ranges of the curve; a task holds a run of one or two shards and writes it in order.
    """
    number, slot = spare(docs, "shard", "slot")
    made = shard(docs, dimensions, ties, size, law, shards, (number, slot), bits)
    made.repartitionByRange(number, slot).sortWithinPartitions(number, slot).write.mode("overwrite").partitionBy(number).parquet(folder)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs of the curve through source, language and size, row counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("check"))
    ties = [F.col("check"), F.asc_nulls_first("doc_id")]
    made = shard(materialize(narrow, "narrow"), list(DIMENSIONS), ties, F.col("size"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "lang")
