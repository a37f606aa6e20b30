"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Every usable vector is indexed. Shards are dealt by a hash of the id, ``SHARD_ROWS`` vectors or so in
each, whatever the cluster; a table that would need more than ``SHARDS`` of them gets larger ones, up to
``SHARD_MOST`` vectors, as a search takes hardly longer in a larger graph. Vectors of different length have shards of their own.
Within a shard equal vectors are one node. Nodes are ordered by their top layer, so layer l is a prefix
of the shard and its neighbour lists one flat array; the index is kept as one row per node in the
shared scratch folder. Largest inner products become smallest distances by one more component,
sqrt(M^2 - |x|^2).

Queries meet every shard of their length in blocks: a task reads one shard's nodes, then streams at most
about ``QUERY_ROWS`` queries, so memory and time are bounded by a shard and a block. Each shard's best are
merged by exact scores.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without
an id, take no part; inner products exist between vectors of equal length only, so a vector finds and is found by its own
length; ties go to the smaller id; repeated rows are candidates for each other, and one query; rows that share an id but
not the vector are queries of their own, under one id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, map_arrow, materialize, with_offsets
from .vectors import dots, matrix, usable

TOP = 20
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 96
SHARD_ROWS, SHARDS, SHARD_MOST, QUERY_ROWS = 16_384, 1024, 262_144, 32_768
BATCH = 256


def _beam(q: np.ndarray, x: np.ndarray, near: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all rows of q at once: (ids, squared distances), nearest first, -1 filled.

    near: neighbour lists, -1 filled. entry: (queries, some) start nodes, -1 filled. In each round a
    query opens its two nearest unopened nodes, until all of its ``width`` best are open.
    """
    n, d = len(q), q.shape[1]
    xx = (x * x).sum(1)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for "none"
    seen[:, -1] = True

    def distance(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.full(ids.shape, np.inf, np.float32)
        r, c = np.nonzero(ids >= 0)
        t = ids[r, c]
        out[r, c] = xx[t] - 2 * np.einsum("ij,ij->i", q[rows[r]], x[t])
        return out

    def fresh(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        ids = np.where(seen[rows[:, None], ids], -1, ids)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        seen[rows[:, None], ids] = True
        return ids

    rows = np.arange(n)
    ids = fresh(entry.astype(np.int32), rows)
    dist, opened = distance(ids, rows), np.zeros(ids.shape, bool)
    if ids.shape[1] < width:
        pad = width - ids.shape[1]
        ids = np.concatenate([ids, np.full((n, pad), -1, np.int32)], 1)
        dist = np.concatenate([dist, np.full((n, pad), np.inf, np.float32)], 1)
        opened = np.concatenate([opened, np.zeros((n, pad), bool)], 1)
    while len(rows):
        todo = np.where(opened[rows] | (ids[rows] < 0), np.inf, dist[rows])
        pick = np.argpartition(todo, 1, axis=1)[:, :2]
        go = np.isfinite(np.take_along_axis(todo, pick, 1))
        active = go.any(1)
        rows, pick, go = rows[active], pick[active], go[active]
        if not len(rows):
            break
        opened[rows[:, None], pick] |= go
        nodes = np.where(go, ids[rows[:, None], pick], -1)
        found = np.where((nodes >= 0)[:, :, None], near[nodes], -1).reshape(len(rows), -1)
        found = fresh(found, rows)
        d_found = distance(found, rows)
        all_ids, all_d = np.concatenate([ids[rows], found], 1), np.concatenate([dist[rows], d_found], 1)
        all_open = np.concatenate([opened[rows], np.zeros(found.shape, bool)], 1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        ids[rows], dist[rows], opened[rows] = (np.take_along_axis(y, keep, 1) for y in (all_ids, all_d, all_open))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _diverse(at: np.ndarray, ids: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """From candidates sorted by distance, keep those nearer to the node than to any kept one; then fill up with the nearest."""
    v = np.where((ids >= 0)[:, :, None], x[ids], 0)
    own = ((v - at[:, None]) ** 2).sum(2)
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for c in range(ids.shape[1]):
        clash = (kept & (between[:, c] < own[:, c, None])).any(1)
        take = (ids[:, c] >= 0) & ~clash & (count < links)
        kept[:, c] = take
        count += take
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    out = np.take_along_axis(ids, np.argsort(rank, axis=1)[:, :links], 1)
    return out if out.shape[1] == links else np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def _layer(x: np.ndarray, above: list[np.ndarray], links: int) -> np.ndarray:
    """Neighbour lists of the layer that holds all of x, inserted in batches; above: finished upper layers, top first."""
    near = np.full((len(x) + 1, links), -1, np.int32)
    done = 1
    while done < len(x):
        new = np.arange(done, min(len(x), done + min(done, BATCH)))
        entry = _descend(x[new], x, above)
        entry = np.where(entry < done, entry, -1)
        entry[:, -1] = np.where((entry >= 0).any(1), entry[:, -1], 0)
        ids, _ = _beam(x[new], x[:done], near[: done + 1] if done < len(x) else near, entry, min(BUILD_WIDTH, max(2, done)))
        # candidates of the same batch
        inner = ((x[new][:, None] - x[new][None]) ** 2).sum(2)
        np.fill_diagonal(inner, np.inf)
        mates = new[np.argsort(inner, axis=1)[:, : min(8, len(new) - 1)]] if len(new) > 1 else np.empty((len(new), 0), int)
        ids = np.concatenate([ids, mates], 1).astype(np.int32)
        far = np.where(ids >= 0, ((x[ids] - x[new][:, None]) ** 2).sum(2), np.inf)
        ids = np.take_along_axis(ids, np.argsort(far, axis=1), 1)
        chosen = _diverse(x[new], ids, x, max(2, links // 2))
        near[new, : chosen.shape[1]] = chosen
        r, c = np.nonzero(chosen >= 0)
        src, dst = new[r], chosen[r, c]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(targets), BATCH):
            t, f, k = targets[i : i + BATCH], first[i : i + BATCH], count[i : i + BATCH]
            wide = int(k.max())
            slots = f[:, None] + np.arange(wide)
            back = np.where(np.arange(wide) < k[:, None], src[np.minimum(slots, len(src) - 1)], -1)
            ids = np.concatenate([near[t], back], 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            far = np.where(ids >= 0, ((x[ids] - x[t][:, None]) ** 2).sum(2), np.inf)
            ids = np.take_along_axis(ids, np.argsort(far, axis=1)[:, : 3 * links], 1)
            near[t] = _diverse(x[t], ids, x, links)
        done = int(new[-1]) + 1
    return near


def _descend(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    """Entry nodes for the layer below ``layers``."""
    entry = np.zeros((len(q), 1), np.int32)
    for near in layers:
        ids, _ = _beam(q, x[: len(near) - 1], near, entry, 4)
        entry = ids[:, :2]
    return entry


def build(x: np.ndarray, layer_of: np.ndarray) -> list[np.ndarray]:
    """Layers, top first; x sorted by layer_of, descending. Each has a last row that stands for no node."""
    layers: list[np.ndarray] = []
    for layer in range(int(layer_of.max(initial=0)), -1, -1):
        size = int((layer_of >= layer).sum())
        layers.append(_layer(x[:size], layers, LINKS * (2 if layer == 0 else 1)))
    return layers


def search(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray], width: int = SEARCH_WIDTH) -> np.ndarray:
    ids, _ = _beam(q, x, layers[-1], _descend(q, x, layers[:-1]), min(width, max(2, len(x))))
    return ids


def _extended(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors whose distances to (query, 0) rank as inner products do, scaled by the largest norm."""
    v = v / top
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1).astype(np.float32)


def _build_shards(top: int):
    """(shard, vec, v) by shard to one row per node: its members and its neighbours in each of its layers, flat."""

    def nodes(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, v = rows.column("vec").combine_chunks().to_numpy(), matrix(rows.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order] + 0.0
        x, first, group = np.unique(v, axis=0, return_index=True, return_inverse=True)
        draw = (ids[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
        draw = ((draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)).astype(np.float64) / 2**53
        layer = np.minimum(6, np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS))).astype(int)
        place = np.lexsort((draw, -layer))
        x, layer = x[place], layer[place]
        layers = build(_extended(x, float(np.sqrt((x * x).sum(1)).max())), layer)
        where = np.empty(len(place), int)
        where[place] = np.arange(len(place))
        members: list[list[int]] = [[] for _ in place]
        for i, g in zip(ids.tolist(), where[group.reshape(-1)].tolist(), strict=True):
            if len(members[g]) <= top:  # ids ascend: one node can give no more than its top + 1 smallest
                members[g].append(i)
        shard = rows.column("shard")[0].as_py()
        for i in range(0, len(x), 5000):
            part = range(i, min(len(x), i + 5000))
            flat = [[int(y) for near in layers[::-1][: layer[k] + 1] for y in near[k]] for k in part]
            yield pa.record_batch(
                [pa.array([shard] * len(part), pa.int32()), pa.array(list(part), pa.int32()), pa.array(layer[i : i + 5000], pa.int32()), pa.array([members[k] for k in part], pa.list_(pa.int64())),
                 pa.array(list(x[i : i + 5000]), pa.list_(pa.float64())), pa.array(flat, pa.list_(pa.int32()))],
                ["shard", "node", "layer", "members", "v", "near"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(shards))[0] + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != int(shards[a]):
                    yield from nodes(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from nodes(pa.Table.from_batches(held))

    return run


def _search_shards(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, group, kind, node...) sorted by them: a shard's nodes, then a group of queries."""
        shard, nodes, index = None, [], None

        def load() -> tuple:
            rows = pa.Table.from_batches(nodes)
            v = matrix(rows.column("v").combine_chunks())
            layer, flat = rows.column("layer").to_numpy(), rows.column("near").combine_chunks()
            values, starts = flat.flatten().to_numpy(), flat.offsets.to_numpy()[:-1] - flat.offsets[0].as_py()
            layers = []
            for k in range(int(layer.max()), -1, -1):
                size = int((layer >= k).sum())
                at = starts[:size] + (0 if k == 0 else 2 * LINKS + (k - 1) * LINKS)
                near = values[at[:, None] + np.arange(LINKS * (2 if k == 0 else 1))]
                layers.append(np.concatenate([near, np.full((1, near.shape[1]), -1)]).astype(np.int32))
            return v, _extended(v, float(np.sqrt((v * v).sum(1)).max())), layers, rows.column("members").to_pylist()

        for batch in batches:
            groups, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            shards = (batch.column("shard").to_numpy().astype(np.int64) << 31) + groups
            cuts = [0, *(np.nonzero(np.diff(shards * 2 + kinds))[0] + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shard != shards[a]:
                    shard, nodes, index = shards[a], [], None
                if kinds[a] == 0:
                    nodes.append(part)
                    continue
                if not nodes:
                    continue
                index = index or load()
                v, x, layers, members = index
                qs, ids, keys = matrix(part.column("v")) + 0.0, part.column("node").to_numpy(), part.column("key").to_numpy()
                for i in range(0, len(qs), BATCH):
                    q = qs[i : i + BATCH]
                    unit = q / np.sqrt((q * q).sum(1, keepdims=True))
                    found = search(np.concatenate([unit, np.zeros((len(q), 1))], 1).astype(np.float32), x, layers)
                    r, c = np.nonzero(found >= 0)
                    t = found[r, c]
                    score, same = dots(q[r], v[t]), (q[r] == v[t]).all(1)
                    order = np.lexsort((-score, r))
                    out: list[tuple[int, int, int, float]] = []
                    given, last = [0] * len(q), [0.0] * len(q)
                    for k in order.tolist():
                        row = int(r[k])
                        if given[row] >= top and score[k] < last[row]:  # equal scores go on, for ties
                            continue
                        last[row], own = float(score[k]), int(ids[i + row])
                        found_ids = list(members[int(t[k])])
                        if same[k] and own in found_ids:  # the query's own row
                            found_ids.remove(own)
                        out += [(int(keys[i + row]), own, m, last[row]) for m in found_ids]
                        given[row] += len(found_ids)
                    columns = list(zip(*out, strict=True)) or [()] * 4
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["key", "query", "vec", "score"])

    return run


def nearest(df: DataFrame, queries: DataFrame, vec: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(query, rank, vec, score): each query's ``top`` best inner products among all other rows of df."""
    clean = lambda x: x.select(F.col(vec).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("v")).where(usable("v") & F.col("vec").isNotNull()).withColumn("dims", F.size("v"))
    few = F.ceil(F.col("n") / SHARD_ROWS)
    sizes = clean(df).groupBy("dims").agg(F.count("*").alias("n")).withColumn("shards", F.when(few <= SHARDS, few).otherwise(F.greatest(F.lit(SHARDS), F.ceil(F.col("n") / SHARD_MOST))).cast("int"))
    sizes = materialize(with_offsets(sizes, [F.col("dims")], F.col("shards"), "base"), "sizes")
    asked = materialize(lookup(clean(queries).distinct(), sizes, ["dims"], "n", "inner"), "asked")
    shards, groups = int(sizes.agg(F.sum("shards")).first()[0] or 1), math.ceil(asked.count() / QUERY_ROWS) or 1
    parts = lambda ids: min(ids, 100_000)

    shard = (F.col("base") + F.pmod(F.xxhash64("vec"), F.col("shards"))).cast("int")
    dealt = lookup(clean(df), sizes, ["dims"], "n", "inner").select(shard.alias("shard"), "vec", "v")
    dealt = dealt.repartitionById(parts(shards), F.col("shard") % parts(shards)).sortWithinPartitions("shard")
    index = materialize(map_arrow(dealt, _build_shards(top), "shard int, node int, layer int, members array<long>, v array<double>, near array<int>"), "graph")

    every, none = F.sequence(F.lit(0), F.lit(groups - 1)), F.array()
    kept = index.select("shard", F.explode(every).alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.col("node").cast("long").alias("node"), "layer", "members", "v", "near")
    key = F.xxhash64("vec", "v")
    met = F.explode(F.sequence(F.col("base").cast("int"), (F.col("base") + F.col("shards") - 1).cast("int")))
    asked = asked.select(
        met.alias("shard"), F.pmod(key, F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), key.alias("key"), F.col("vec").alias("node"), F.lit(0).alias("layer"),
        none.cast("array<long>").alias("members"), "v", none.cast("array<int>").alias("near"),
    )
    task = (F.col("shard") * groups + F.col("group")) % parts(shards * groups)
    both = kept.union(asked).repartitionById(parts(shards * groups), task).sortWithinPartitions("shard", "group", "kind", "node")
    found = map_arrow(both, _search_shards(top), "key long, query long, vec long, score double")
    order = Window.partitionBy("query", "key").orderBy(F.desc("score"), "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "rank", "vec", "score")


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
