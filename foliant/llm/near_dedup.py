"""Near-dedup of documents by SimHash, and by the similarity of their word shingles.

Two documents are near copies if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more. Candidates come in two ways. SimHash fingerprints of the same shingles are linked at 4 bits
by the multi-index hashing of ``simhash``, and all members of a component are candidates of one another.
Copies at 0.8 differ in more bits than that, so texts that share a band are candidates too: 25 bands of 5 minimum
hashes miss a pair at 0.8 with probability (1 - 0.8**5)**25, or 0.00005, and fewer above. Each candidate is
then compared by its whole shingle set, so every link is a real one. Equal sets are folded first, bands (or components)
whose members are the same are compared once, and only texts that share one with another are read again.

In what follows a component of fingerprints is one more band. A band of up to ``CELL_ROWS`` members is compared in one task, which hands on a spanning forest.
A larger one is dealt over several tasks, its smallest member into each; then only members that
are not yet in that member's component meet the rest, in pairs of blocks.

Defined results: texts of less than five words are one shingle; null and empty texts are near copies
of each other; a row without an id stays only where its group has no row with one; rows equal in id
(null too) and text become one row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, map_arrow, materialize, shuffle_partitions, small_side
from .simhash import folded, one_of_each, shingle_hashes

SHINGLE, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS = 25, 5
#: Members, and their shingles, that one task compares at once (a single text may be longer).
CELL_ROWS, CELL_SHINGLES = 1_000, 4_000_000


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minimum hashes; factors are odd."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (factors[:, None] * hashes[None, i : i + 1024]).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        nodes, sizes, prints, bands = [], [], [], [np.empty(0, np.int64)]
        for text in batch.column(2):
            all_ = shingle_hashes(text.as_buffer().to_pybytes(), SHINGLE)
            prints.append(folded(all_))
            hashes = np.unique(all_)
            nodes.append(_node(hashes))
            sizes.append(len(hashes))
            bands.append(band_keys(hashes, factors))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists], ["id", "h", "node", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingles(text.as_buffer().to_pybytes()).tobytes() for text in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["node", "shingles"])


def forest(nodes: np.ndarray, own: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links (a, b) that span the components of all similar pairs with at least one end ``own``."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    order = order[[len(sets[i]) > 0 for i in order]]
    if len(order) < 2 or not own[order].any():
        return np.empty((2, 0), np.int64)
    nodes, own, sets = nodes[order], own[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, left, links = np.zeros(len(names), bool), np.ones(len(sets), bool), [np.empty((2, 0), np.int64)]
    for first in range(len(sets)):  # each walk gathers one component
        todo, left[first] = [first] if left[first] else [], False
        while todo:
            x = todo.pop()
            lo, hi = np.searchsorted(sizes, (np.floor(sizes[x] * least), np.ceil(sizes[x] / least) + 1))
            if not (left[lo:hi] & (own[x] | own[lo:hi])).any():
                continue
            mine = flat[starts[x] : starts[x + 1]]
            held[mine] = True
            both = np.add.reduceat(held[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            held[mine] = False
            near = (both / (sizes[x] + sizes[lo:hi] - both) >= least) & left[lo:hi] & (own[x] | own[lo:hi])
            hit = np.nonzero(near)[0] + lo
            left[hit] = False
            links.append(np.stack([np.full(len(hit), nodes[x]), nodes[hit]]))
            todo.extend(hit.tolist())
    return np.concatenate(links, axis=1)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            links = forest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], least)
            return pa.record_batch([pa.array(links[0]), pa.array(links[1])], ["a", "b"])

        cell, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for at, node, own, hashes in zip(*columns, batch.column(3), strict=True):
                if at != cell and rows:
                    yield found(rows)
                    rows = []
                cell = at
                rows.append((node, own, np.frombuffer(hashes.as_buffer().to_pybytes(), np.uint64)))
        if rows:
            yield found(rows)

    return run


def _blocks(rows: Column, size: Column) -> Column:
    return F.greatest(F.ceil(rows / CELL_ROWS), F.ceil(size / CELL_SHINGLES)).cast("int")


def _members(prints: DataFrame) -> DataFrame:
    """(node, size, key): a key for each band of a shingle set, and one for the SimHash component of each of its fingerprints."""
    bands = prints.select("node", "size", "bands").dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("key"))
    # texts of one set may repeat their shingles differently, so a node may have several fingerprints
    own = materialize(prints.select("node", "size", "fp").distinct(), "fingerprints")
    near = materialize(connected_components(simhash.links(materialize(own.select("fp").distinct(), "fps"))).toDF("fp", "root"), "roots")
    rooted = own.join(small_side(near), "fp", "left").select("node", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))
    return bands.union(materialize(rooted.distinct(), "rooted"))


def _pairs(keyed: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """(a, b) long: real links whose components are those of all similar candidates."""
    n = shuffle_partitions(keyed.sparkSession)
    members = _members(prints)
    buckets = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("total"), F.min("node").alias("hub"), F.bit_xor(F.xxhash64("node")).alias("who")).where("m > 1")
    buckets = buckets.groupBy("m", "total", "hub", "who").agg(F.min("key").alias("key")).select("key", "hub", _blocks(F.col("m"), F.col("total")).alias("blocks"))
    inside = materialize(members.join(small_side(materialize(buckets, "buckets")), "key"), "inside")

    reps = prints.join(inside.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "h")).alias("_key"))
    texts = keyed.join(small_side(materialize(reps, "reps")), "_key").select("node", "_text")
    sets = materialize(map_arrow(texts, _sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def compared(cells: DataFrame, name: str) -> DataFrame:
        dealt = cells.join(sets, "node").select("cell", "node", "own", "shingles").repartition(n, "cell").sortWithinPartitions("cell")
        return materialize(map_arrow(dealt, _verify(least), "a long, b long").distinct(), name)

    # a cell shares no key with another but by a 64-bit collision, which only adds verified links
    part = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    cells = inside.select("key", "node", F.explode(part).alias("part"))
    links = compared(cells.select(F.xxhash64("key", "part").alias("cell"), "node", F.lit(True).alias("own")), "links")

    crowded = materialize(inside.where("blocks > 1").select("key", "node", "size", "hub"), "crowded")
    if crowded.isEmpty():
        return links
    parts = connected_components(links)
    named = crowded.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = named.where("node = hub").select("key", F.col("component").alias("hub_component"))
    named = named.join(small_side(materialize(hubs, "hubs")), "key").withColumn("own", F.col("component") != F.col("hub_component"))
    named = materialize(named.select("key", "node", "size", "own"), "named")
    mine, rest = (lambda x: F.when(F.col("own"), x)), (lambda x: F.when(~F.col("own"), x))
    counted = named.groupBy("key").agg(*(F.coalesce(F.sum(f(x)), F.lit(0)).alias(a) for f, x, a in ((mine, F.lit(1), "o"), (mine, F.col("size"), "os"), (rest, F.lit(1), "r"), (rest, F.col("size"), "rs"))))
    counted = counted.where("o > 0").select("key", F.greatest(F.lit(1), _blocks(F.col("o"), F.col("os"))).alias("bo"), F.greatest(F.lit(1), _blocks(F.col("r"), F.col("rs"))).alias("br"))
    open_ones = named.join(small_side(materialize(counted, "open")), "key")
    k = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("bo")).otherwise(F.col("br"))).cast("int")
    pair = lambda x, y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("bo") + F.col("br") - 1), lambda j: pair(F.col("k"), j))
    with_own = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda i: pair(i, F.col("bo") + F.col("k")))
    cells = open_ones.withColumn("k", k).select("key", "node", "own", F.explode(F.when(F.col("own"), with_all).otherwise(with_own)).alias("p"))
    return links.union(compared(cells.select(F.xxhash64("key", "p.i", "p.j").alias("cell"), "node", "own"), "links"))


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.struct(F.col(doc).alias("id"), F.xxhash64(text).alias("h")).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))


def _prints(keyed: DataFrame) -> DataFrame:
    """(id, h, node, size, fp, bands) per row: text hash, hash of the shingle set, its size, SimHash fingerprint, and keys of the bands."""
    own = keyed.select("_key.id", "_key.h", "_text")
    return map_arrow(own, _signatures, f"id {own.schema['id'].dataType.simpleString()}, h long, node long, size long, fp long, bands array<long>")


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(id, h, root) per row of docs: id, text hash, and a number that near copies share."""
    keyed = _keyed(docs, doc, text)
    prints = materialize(_prints(keyed), "prints")
    parts = connected_components(_pairs(keyed, prints, least))
    return prints.join(parts, "node", "left").select("id", "h", F.coalesce("component", "node").alias("root"))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id (of equal ids, the smallest text hash)."""
    return one_of_each(docs, groups(docs, doc, text, least), doc, text)
