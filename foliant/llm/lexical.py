"""Ranked lexical search by the Best Position Algorithm.

One pass cuts every document into terms and keeps, of the terms that some item asks for, how often each
occurs (its forward list). Sums over all documents give N, L and every df, and so the weights. A
second pass turns each task's forward lists, ``SEGMENT_ROWS`` documents at a time, into impact lists: a term's documents by
falling impact. An item reads its terms' lists side by side; each document met is at once looked up
in all the other lists (direct access), which tells its whole score and its places there. A list's
best position is the last before which every place has been seen, by reading or by direct access, so
the sum of the impacts there bounds every document not met yet, and more tightly than the places last read.
Reading stops when that bound is strictly below the kth score, so that ties are never lost. A
task carries each item's kth score from segment to segment and hands on ``top`` rows an item; those are merged in two steps.

Items are ranked in blocks of about ``QUERY_BYTES`` of text: what tasks hold of them, and what the driver sees, is
bounded by a block; each block reads the documents once.

Defined results: null and empty texts, and texts without terms, are in no count and no ranking; documents with equal
scores are in the order of their ids, a null id last; repeated documents count and rank each by itself;
repeated items are ranked once, an id with two texts has a ranking for each; an item without terms has no rows; other columns
are ignored; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

TOP = 50
#: Bytes of distinct item texts that are ranked in one pass; a longer item is a pass of its own.
QUERY_BYTES = 1 << 20
#: Documents and postings of which a task makes impact lists at once.
SEGMENT_ROWS, SEGMENT_POSTINGS = 16_384, 1 << 21
#: Places read of each list in the first round; rounds double.
FIRST_READ = 64
#: A list that holds more than this part of a segment's documents is looked up by document number.
DENSE = 8
#: Tasks whose rows are merged first.
MERGED = 256
#: ASCII letters and digits, and all bytes beyond, make terms; only A-Z change.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _forward(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, found, times = [], [0], [], []
            for x in batch.column(1):
                words = terms(x.as_buffer().to_pybytes())
                counts = Counter(filter(vocabulary.__contains__, words))
                lengths.append(len(words))
                found.extend(map(vocabulary.__getitem__, counts))
                times.extend(counts.values())
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            made = pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "times"])
            yield made.filter(pa.array(np.asarray(lengths, np.int64) > 0))

    return run


class Segment:
    """The impact lists of some documents, with direct access by document number."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, times: np.ndarray, documents: int, words: int) -> None:
        self.rows = len(n)
        doc = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        m = np.array([50 + 50 * x * documents // words for x in n.tolist()], np.int64)
        impact = 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + 20 * m[doc])
        order = np.lexsort((doc, -impact, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        heads = np.nonzero(np.diff(term, prepend=-1))[0]
        ends = np.append(heads[1:], len(term))[: len(heads)]
        self.bounds = dict(zip(term[heads].tolist(), zip(heads.tolist(), ends.tolist(), strict=True), strict=True))
        self.direct: dict[int, tuple] = {}

    def places(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of docs the term's list holds, and where in it they stand."""
        a, b = self.bounds[term]
        dense = (b - a) * DENSE >= self.rows
        if term not in self.direct:
            if dense:
                at = np.full(self.rows, -1, np.int32)
                at[self.doc[a:b]] = np.arange(b - a, dtype=np.int32)
                self.direct[term] = (at,)
            else:
                by_doc = np.argsort(self.doc[a:b])
                self.direct[term] = self.doc[a:b][by_doc], by_doc
        if dense:
            at = self.direct[term][0][docs]
            hit = np.nonzero(at >= 0)[0]
            return hit, at[hit]
        own, by_doc = self.direct[term]
        i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        hit = np.nonzero(own[i] == docs)[0]
        return hit, by_doc[i[hit]]


class Best:
    """The best (score, id) of an item so far; null ids come last among equal scores."""

    def __init__(self, top: int) -> None:
        self.top, self.score, self.id, self.none = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def kth(self) -> int:
        """What a document has to reach; every score above 0 does while there are fewer than ``top``."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.kth()
        if not good.any():
            return
        score, ids, none = (np.concatenate([old, new[good]]) for old, new in ((self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score))[: self.top]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def search(segment: Segment, asked: list[tuple[int, int]], ids: np.ndarray, none: np.ndarray, best: Best) -> tuple[int, int]:
    """Bring the segment's documents into ``best`` for (term, weight) pairs; returns the places read and the documents looked up."""
    lists = [(w, *segment.bounds[t], t) for t, w in asked if w > 0 and t in segment.bounds]
    seen = [np.zeros(b - a + 1, bool) for _, a, b, _ in lists]  # the place past the end stays unseen
    upto, met, depth, step, read = [0] * len(lists), np.zeros(segment.rows, bool), 0, FIRST_READ, 0
    while True:
        # nothing unmet can score above the impacts at the best positions; a list seen to its end holds nothing unmet
        bound = sum(w * int(segment.impact[a + max(p - 1, 0)]) for (w, a, b, _), p in zip(lists, upto, strict=True) if p < b - a)
        if bound < best.kth():
            return read, int(met.sum())
        now = np.zeros(segment.rows, bool)
        for _, a, b, _ in lists:
            now[segment.doc[a + depth : min(a + depth + step, b)]] = True
            read += max(0, min(step, b - a - depth))
        new = np.nonzero(now & ~met)[0]
        met[new] = True
        score = np.zeros(len(new), np.int64)
        for i, (w, a, _, t) in enumerate(lists):
            hit, at = segment.places(t, new)
            score[hit] += w * segment.impact[a + at]
            seen[i][at] = True
            upto[i] += int(np.argmin(seen[i][upto[i] :]))
        best.add(score, ids[new], none[new])
        depth, step = depth + step, step * 2


def _ranked(items: list[tuple[bytes, list[tuple[int, int]]]], documents: int, words: int, top: int):
    """Forward lists to (item, doc, score): each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]

        def work(held: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            doc, n, found, times = (part.column(c).chunk(0) for c in ("doc", "n", "terms", "times"))
            sizes = np.diff(found.offsets.to_numpy())
            segment = Segment(n.to_numpy(), sizes, found.flatten().to_numpy(), times.flatten().to_numpy(), documents, words)
            ids, none = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
            for (_, asked), b in zip(items, best, strict=True):
                search(segment, asked, ids, none, b)

        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                held.append(piece)
                rows, postings = rows + piece.num_rows, postings + len(piece.column(2).flatten())
                if rows >= SEGMENT_ROWS or postings >= SEGMENT_POSTINGS:
                    work(held)
                    held, rows, postings = [], 0, 0
        if rows:
            work(held)
        for (item, _), b in zip(items, best, strict=True):
            if len(b.score):
                yield pa.record_batch([pa.array([item] * len(b.score), pa.binary()), pa.array(b.id, mask=b.none), pa.array(b.score)], ["item", "doc", "score"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _rank_block(docs: DataFrame, asked: list[tuple[bytes, set[bytes]]], top: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(ts for _, ts in asked))))}
    forward = materialize(map_arrow(docs, _forward(vocabulary), "doc long, n long, terms array<int>, times array<int>"), "forward")
    documents, words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most as many rows as the block has terms
    items = [(item, [(vocabulary[t], weight(documents, df[vocabulary[t]])) for t in sorted(ts) if vocabulary[t] in df]) for item, ts in asked]
    return map_arrow(forward, _ranked(items, documents, words, top), "item binary, doc long, score long").withColumn("task", F.spark_partition_id())


def rank(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, doc, score): the ``top`` documents of each item, best first."""
    spark = docs.sparkSession
    asked = materialize(items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct().withColumn("blob", F.unhex(F.sha2("text", 256))), "items")
    texts = asked.select("blob", "text").distinct()
    blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / QUERY_BYTES))
    own = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    found = []
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("blob"), F.lit(blocks)) == block).collect()
        wanted = [(bytes(r["blob"]), set(terms(r["text"].encode()))) for r in rows]
        if wanted:
            found.append(materialize(_rank_block(own, wanted, top), "ranked"))
    if not found:
        return asked.select("item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    some = Window.partitionBy("item", "group").orderBy(*order)
    merged = merged.withColumn("group", F.expr(f"task div {MERGED}")).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return merged.withColumnRenamed("item", "blob").join(asked.select("blob", "item"), "blob").select("item", "rank", "doc", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    found = rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, {_TERMS.format("text")} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_words FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, text, unnest({_TERMS.format("text")}) AS term FROM benchmark),
p AS (SELECT row_id, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
f AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
r AS (SELECT item_id, q.text, row_id, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, q.text, row_id, doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
