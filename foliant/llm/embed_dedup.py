"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to twice 8 dimensions, scaled, shifted and decoded to the nearest
points of the E8 lattice; both points together are a cell, in each of several tables. Vectors are stored
under their own cell and look up the nearest neighbouring cells too (those that change either point, or
both, by a shortest lattice vector). Cells get finer, and tables more, as the largest label grows: see ``LEVELS``.
Members of a cell with equal labels are compared by cosine in double precision, in blocks; only cells in which
somebody can meet somebody else get their vectors, and a cell beyond ``CELL_ROWS`` members is dealt,
in pairs of blocks, over several tasks.

A pair of near vectors may meet in many cells. It counts in the first table where it meets only, which a task
knows from the two vectors' own cells, so tasks hand on one sum of links for each vector and a spanning
forest of the links, never the pairs: what leaves a task is linear in what it reads. Equal vectors of a label are folded to
one class first, whose members are counted, so copies are never expanded.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors with
a null label, link with nothing; so do vectors of different length; a null id is the smallest of its group only
where no other is there; repeated rows are vectors of their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, materialize, shuffle_partitions, small_side
from .vectors import matrix, usable

COSINE = 0.93
NEIGHBOURS, SEED = 4, 20
#: Classes of the largest label up to which a level holds, lattice units per unit of projected distance, and tables.
#: Tables are as many as keep the recall of pairs at cosine 0.93 over 0.99; the share of unrelated pairs that meet falls
#: about fourfold from level to level, from 0.0003 at the first (measured on random 64-dimensional vectors, as in the tests).
LEVELS = ((250_000, 0.55, 12), (1_000_000, 0.6, 15), (4_000_000, 0.65, 20), (16_000_000, 0.7, 26), (64_000_000, 0.75, 34), (2**63, 0.8, 45))
#: Shortest lattice vectors that are tried for each of the two points.
NEAR = 8
BLOCK = 1024
#: Members of a cell that one task compares at once.
CELL_ROWS = 8192


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) and (+-1/2)^8 with an even number of minus signs."""
    eye, out = np.eye(8), []
    for i in range(8):
        for j in range(i):
            out += [a * eye[i] + b * eye[j] for a in (-1, 1) for b in (-1, 1)]
    for bits in range(256):
        signs = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if bits.bit_count() % 2 == 0:
            out.append(signs)
    return np.array(out)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer components of even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.nonzero(near.sum(1) % 2)[0]
    w = worst[rows]
    near[rows, w] += np.where(off[rows, w] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: the nearer one of D8 and D8 shifted by one half."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _keys(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit key of (table, lattice point); doubled points are integers."""
    key = np.full(points.shape[:-1], (table + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for d in range(8):
        key = (key ^ (2 * points[..., d]).astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


def cells(vectors: np.ndarray, level: int = 0, neighbours: int = NEIGHBOURS, seed: int = SEED) -> np.ndarray:
    """(row, table, 1 + neighbours) keys of unit vectors: the own cell first, then neighbouring cells by distance."""
    roots, out = _roots(), []
    _, scale, tables = LEVELS[level]
    rng = np.random.default_rng([seed, vectors.shape[1]])
    for t in range(tables):
        halves = []
        for half in range(2):
            project, shift = rng.standard_normal((vectors.shape[1], 8)), rng.uniform(0, 1, 8)
            x = vectors @ project * scale + shift
            own = decode_e8(x)
            further = 2 - 2 * (x - own) @ roots.T  # how much further away, squared, the own point moved by a root is
            best = np.argpartition(further, NEAR, axis=1)[:, :NEAR]
            points = np.concatenate([own[:, None], own[:, None] + roots[best]], axis=1)
            halves.append((_keys(points, 2 * t + half), np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(further, best, 1)], axis=1)))
        (a, more_a), (b, more_b) = halves
        both = ((a * np.uint64(0x9E3779B97F4A7C15))[:, :, None] ^ b[:, None, :]).reshape(len(vectors), -1)
        order = np.argsort((more_a[:, :, None] + more_b[:, None, :]).reshape(len(vectors), -1), axis=1, kind="stable")
        out.append(np.take_along_axis(both, order[:, : neighbours + 1], axis=1))
    return np.stack(out, axis=1)


def _units(column) -> np.ndarray:
    v = matrix(column)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hash(level: int):
    """(rep, v, ...) with the keys of each vector, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                same = batch.take(pa.array(np.nonzero(sizes == size)[0]))
                for i in range(0, same.num_rows, 2048):
                    part = same.slice(i, 2048)
                    keys = cells(_units(part.column(1)), level)
                    flat = pa.array(keys.reshape(-1).view(np.int64))
                    ends = pa.array(np.arange(len(keys) + 1) * keys.shape[1] * keys.shape[2], pa.int32())
                    yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(ends, flat)], [*part.schema.names, "keys"])

    return run


def _first_meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, cell: np.ndarray) -> np.ndarray:
    """Is this table the first in which vectors a and b (rows of keys) meet, and this cell the least of those where they do?"""
    own_a, own_b = keys[a, : table + 1, :1], keys[b, : table + 1, :1]
    at_a, at_b = (own_a == keys[b, : table + 1]).any(2), (own_b == keys[a, : table + 1]).any(2)
    none = np.uint64(2**64 - 1)
    least = np.minimum(np.where(at_a[:, -1], own_a[:, -1, 0], none), np.where(at_b[:, -1], own_b[:, -1, 0], none))
    return ~(at_a | at_b)[:, :-1].any(1) & (least == cell)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of linked rows in ``root``; returns the links (2, n) that did, a forest."""
    used = [np.empty((2, 0), np.int64)]
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return np.concatenate(used, axis=1)
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], np.diff(high[order]) != 0))]  # each higher root joins its lowest neighbour
        used.append(np.stack([a[first], b[first]]))
        up = np.arange(len(root))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        root[:] = up[root]


def _verify(least: float):
    def piece(table: int, side: np.ndarray, own: np.ndarray, rep: np.ndarray, members: np.ndarray, v: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One cell, or the two blocks of a crowded one: links per vector, and a forest."""
        mine, every = np.nonzero(own)[0], np.arange(len(own))
        counts, root, forest = np.zeros(len(own), np.int64), np.arange(len(own)), []
        for i in range(0, len(mine), BLOCK):
            for j in range(0, len(every), BLOCK):
                x, y = mine[i : i + BLOCK], every[j : j + BLOCK]
                near = (v[x] @ v[y].T >= least) & (~own[y][None, :] | (x[:, None] < y[None, :])) & (rep[x][:, None] != rep[y][None, :])
                near &= (side[x][:, None] < 0) | (side[x][:, None] != side[y][None, :])
                a, b = np.nonzero(near)
                a, b = x[a], y[b]
                once = _first_meeting(keys, a, b, table, keys[a, table, 0])
                a, b = a[once], b[once]
                counts += np.bincount(a, members[b], len(own)).astype(np.int64) + np.bincount(b, members[a], len(own)).astype(np.int64)
                forest.append(_merge(root, a, b))
        linked = np.nonzero(counts)[0]
        if len(linked):
            a, b = np.concatenate(forest, axis=1)
            ends = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(rep[b])])
            yield pa.record_batch([pa.array(np.concatenate([rep[linked], rep[a]])), ends, pa.array(np.concatenate([counts[linked], np.zeros(len(a), np.int64)]))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            read = lambda name: rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)
            keys = rows.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, -1, NEIGHBOURS + 1)
            yield from piece(int(read("tab")[0]), read("side"), read("own"), read("rep"), read("members"), _units(rows.column("v").combine_chunks()), keys)

        for batch in batches:
            cell, tab = batch.column("cell").to_numpy(), batch.column("tab").to_numpy()
            cuts = [0, *(np.nonzero((np.diff(cell) != 0) | (np.diff(tab) != 0))[0] + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and (held[0].column("cell")[0].as_py(), held[0].column("tab")[0].as_py()) != (int(cell[a]), int(tab[a])):
                        yield from close()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return run


def deal(hashed: DataFrame) -> DataFrame:
    """(cell, tab, own, rep), cheap to read twice, to (cell, tab, side, own, rep): without cells where nobody meets, and with cells beyond
    CELL_ROWS members cut, so that any two members meet in one piece: of one block (side -1), or of two (sides 0 and 1)."""
    sizes = hashed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("some AND n > 1")
    blocks = F.when(F.col("n") > CELL_ROWS, F.ceil(F.col("n") / (CELL_ROWS // 2))).otherwise(1).cast("int")
    sizes = materialize(sizes.select("cell", blocks.alias("blocks")), "sizes")
    met = hashed.join(small_side(sizes), "cell").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    both = lambda j: F.xxhash64("cell", F.least(F.col("k"), j), F.greatest(F.col("k"), j))
    side = lambda j: F.when(F.col("k") == j, -1).when(F.col("k") < j, 0).otherwise(1)
    pieces = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(both(j).alias("cell"), side(j).alias("side")))
    return met.select(F.explode(pieces).alias("p"), "tab", "own", "rep").select("p.cell", "tab", "p.side", "own", "rep")


def near_vectors(df: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE) -> DataFrame:
    """(vec, n_links, component) per row of df."""
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(vec).alias("vec"), F.col(vector).alias("v"), F.col(label).alias("label"))
    alone = rows.where(~usable("v") | F.col("label").isNull()).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    good = rows.where(usable("v") & F.col("label").isNotNull())
    classes = good.groupBy("label", "v").agg(F.count("*").alias("members"), F.min("vec").alias("least"))
    classes = materialize(classes.withColumn("rep", F.xxhash64("label", "v", "least")), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    level = next(i for i, (limit, _, _) in enumerate(LEVELS) if most <= limit)
    # a cell holds the label, so only equal labels meet, and the length
    own = classes.select("rep", "v", "members", F.xxhash64("label", F.size("v")).alias("kind"))
    kind = own.schema["v"].dataType.simpleString()
    hashed = materialize(map_arrow(own, _hash(level), f"rep long, v {kind}, members long, kind long, keys array<long>"), "keys")
    each = hashed.select("rep", "kind", F.posexplode("keys").alias("at", "key"))
    tab, first = (F.col("at") / (NEIGHBOURS + 1)).cast("int"), F.col("at") % (NEIGHBOURS + 1) == 0
    met = deal(each.select(F.xxhash64("key", "kind").alias("cell"), tab.alias("tab"), first.alias("own"), "rep"))
    # whether a pair has met before is told by the keys of the tables up to the cell's own
    upto = F.slice("keys", F.lit(1), (F.col("tab") + 1) * (NEIGHBOURS + 1))
    dealt = met.join(hashed.select("rep", "v", "members", "keys"), "rep").select("cell", "tab", "side", "own", "rep", "members", "v", upto.alias("keys"))
    found = materialize(map_arrow(dealt.repartition(n, "cell").sortWithinPartitions("cell", "tab"), _verify(least), "a long, b long, n long"), "links")
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    labelled = classes.join(parts, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep")).select("rep", "label", "v", "members", "least", "root")
    roots = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.join(roots, "root").join(counts, F.col("rep") == F.col("a"), "left")
    named = named.select("label", "v", "component", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    return good.join(named, ["label", "v"]).select("vec", "n_links", "component").union(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("vec").eqNullSafe(F.col("component"))).alias("kept"))
