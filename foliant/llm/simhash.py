"""SimHash near-dedup by multi-index hashing.

Fingerprints are folded to distinct values first, so exact copies cost one row. A 64-bit fingerprint
is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most 4 bits
differ by at most 1 bit in the first or the second segment, or by none in the third (else they
would differ in 2 + 2 + 1 bits), so each fingerprint looks up the ball of radius 1 around its first
two segments and the exact third one: 45 table probes find every link. Complete distances are
then verified within each table slot. Only links of a spanning forest leave a slot, so a slot with
thousands of near copies gives as many rows, not their square; a slot beyond ``SLOT_ROWS``
members is dealt, in pairs of blocks, over several tasks. Components come from star contraction.

Defined results: null and empty texts have fingerprint zero, linked like any other; a null id is
the smallest id only where a component has no other; repeated rows give repeated rows; extra
columns are ignored; an empty table gives an empty table. ``dedup`` keeps one row of each component,
whether or not rows have an id or share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, materialize, shuffle_partitions, spare

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (shift, bits, radius of the ball looked up) of each segment.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))
#: Members of a table slot that one task compares at once.
SLOT_ROWS = 20_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles, repeats included; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed 64-bit integer: zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text over its word shingles, as a signed 64-bit integer."""
    return folded(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(1)), np.int64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(made)], ["doc", "fp"])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fp) per row of docs; bytes.lower and bytes.split touch only A-Z and the six separators."""
    own = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return map_arrow(own, _fingerprints, f"doc {own.schema['doc'].dataType.simpleString()}, fp long")


def _forest(fps: np.ndarray, own: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links among one slot's members, at least one end ``own``: few enough to be linear in the members."""
    owned = fps[own]
    if len(owned) * len(fps) <= 1 << 16:
        i, j = np.nonzero(np.bitwise_count(owned[:, None] ^ fps[None, :]) <= radius)
        a, b = owned[i], fps[j]
        differ = a != b
        if differ.sum() <= 2 * len(fps):
            return [np.stack([a[differ], b[differ]])]
    links, left = [], np.ones(len(fps), bool)
    while left.any():  # each walk gathers one component
        first = int(np.argmax(left))
        left[first] = False
        todo = [first]
        rest = np.nonzero(left)[0]
        while todo and len(rest):
            x = fps[todo.pop()]
            near = np.bitwise_count(fps[rest] ^ x) <= radius
            hit, rest = rest[near], rest[~near]
            links.append(np.stack([np.full(len(hit), x), fps[hit]]))
            todo.extend(hit.tolist())
        left[:] = False
        left[rest] = True
    return links


def _slots(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(slot: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            edges = np.nonzero(np.diff(slot))[0] + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(slot)]))
            some = np.add.reduceat(own.astype(np.int64), starts) > 0
            out = [np.empty((2, 0), np.uint64)]
            for a, b in zip(starts[some & (ends - starts > 1)].tolist(), ends[some & (ends - starts > 1)].tolist(), strict=True):
                out += _forest(fps[a:b], own[a:b], radius)
            found = np.unique(np.concatenate(out, axis=1), axis=1).view(np.int64)
            return pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last slot may go on
            if whole:
                yield links(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp) distinct to (a, b): links whose components are those of all pairs within ``radius`` bits."""
    n = shuffle_partitions(nodes.sparkSession)
    probes = [(i, s, b, 0, True) for i, (s, b, _) in enumerate(SEGMENTS)]
    probes += [(i, s, b, 1 << bit, False) for i, (s, b, r) in enumerate(SEGMENTS) if r for bit in range(b)]
    probe = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit((1 << b) - 1).alias("m"), F.lit(x).alias("x"), F.lit(o).alias("own")) for i, s, b, x, o in probes)))
    rows = nodes.select("fp", probe.alias("p"))
    slot = F.expr("p.i * 4194304L + (cast(shiftrightunsigned(fp, p.s) & p.m as bigint) ^ p.x)")
    rows = rows.select(slot.alias("slot"), "fp", "p.own")
    # slots are counted by their own members and hits; only crowded ones are cut into pairs of blocks
    crowded = rows.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > SLOT_ROWS)
    crowded = materialize(crowded.select("slot", F.ceil(F.col("n") / (SLOT_ROWS // 2)).cast("int").alias("blocks")), "crowded")
    if crowded.isEmpty():
        dealt = rows.select("slot", F.lit(0).alias("pair"), "fp", "own")
    else:
        marked = rows.join(crowded, "slot", "left").withColumn("k", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.least(F.col("k"), j) * 65536 + F.greatest(F.col("k"), j))
        dealt = marked.select("slot", F.explode(pair).alias("pair"), "fp", "own")
    key = F.xxhash64("slot", "pair")  # a slot and pair share no key with another but by a 64-bit collision, which only adds verified links
    dealt = dealt.select(key.alias("slot"), "fp", "own").repartition(n, "slot").sortWithinPartitions("slot")
    return map_arrow(dealt, _slots(radius), "a long, b long").distinct()


def components(docs: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc, fp, component) per row of docs."""
    prints = materialize(fingerprints(docs, doc, text), "prints")
    return group_prints(prints, radius)


def group_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc, fp) to (doc, fp, component): component is the smallest doc reachable by links."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    grouped = connected_components(links(nodes.select("fp"), radius))
    labelled = nodes.join(grouped, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.join(roots, "root").select("fp", "component")
    return prints.join(named, "fp").select("doc", "fp", "component")


def one_of_each(docs: DataFrame, groups: DataFrame, doc: str, text: str) -> DataFrame:
    """docs with one row of each root of groups (id, h, root), h being xxhash64 of the text: the smallest (id, h), ids before null.

    Of rows that share id and text the one whose columns have the smallest hash stays, on every run. Rows are folded before they are moved, so
    copies that a third of all rows make up are one row from each task.
    """
    key, one = spare(docs, "key", "one")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k"))
    keep = first.select(F.struct("k.id", "k.h").alias(key)).distinct()
    keyed = docs.withColumn(key, F.struct(F.col(doc).alias("id"), F.xxhash64(text).alias("h")))
    whole = F.struct(*docs.columns)
    folded = keyed.groupBy(key).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(one))
    return folded.join(keep, key, "left_semi").select(f"{one}.*")


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group: the one with the smallest id (of equal ids, the smallest text hash)."""
    keyed = docs.select(F.struct(F.col(doc).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.col(text).alias("text"))
    groups = components(keyed, "key", "text", radius).select("doc.id", "doc.h", F.col("component").alias("root"))
    return one_of_each(docs, groups, doc, text)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
