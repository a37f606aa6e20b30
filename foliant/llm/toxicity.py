"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares two sentences by all their (also gapped) subsequences of three bytes within windows of
``WINDOW`` bytes, spaces included; a skipped byte costs a factor ``DECAY`` and no more, so insults with
gaps, inserted characters or spaces between their letters stay close. Sentences end at a line's end or behind . ! ?, and
long ones are cut every ``WORDS`` words (a word of one letter counts as a quarter). Landmarks are phrases of the training texts; K(landmarks)^(-1/2)
k(sentence) are the features, and a linear machine with squared hinge loss is trained on them. As the
kernel is an inner product of sparse subsequence counts, the trained function is folded into one weight
per hashed subsequence: scoring reads whole texts once, whatever the number of landmarks.

Sentences take their document's label, but few sentences of a toxic document are toxic. At first those
count that hold a phrase which toxic documents share and clean ones lack; then, in ``ROUNDS`` rounds, those that
the machine itself finds toxic, against clean sentences of which those that score highest are added.
A document's score is a logistic fit on the share of its sentences that are toxic and on their highest margin. The fit reads
a part of the training rows, of which a second machine, trained on the others, knows nothing: so it isn't too sure.

Training reads at most ``TRAIN_DOCS`` labelled documents of either label, the first in the order of a
hash of their ids, ``SENTENCES`` sentences of either label and ``HARD`` more clean ones in each round. Its landmarks are at
most ``LANDMARKS`` toxic phrases, 2 * ``LANDMARKS`` clean words, and in each round ``MINED`` words of clean sentences that scored highest.

Defined results: null and empty texts score as a document without sentences; repeated rows give repeated
rows; a document id counts once in training, with the smallest of its texts and the highest of its labels; documents without a
label, or without an id, are scored, not trained on; without toxic or clean training rows, or without a phrase that tells
them apart, every score is 0; other columns are never read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, first_by_hash, map_arrow, materialize

THRESHOLD = 0.7
TRAIN_DOCS, SENTENCES, HARD, ROUNDS, LANDMARKS, MINED = 2400, 5000, 1200, 3, 128, 120
#: One of so many parts of the training rows is kept for the logistic fit, and scored by a machine that is trained on the others.
PARTS = 3
#: Letters of the beginnings of words that, besides whole words, may tell toxic documents from clean ones.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Most times that one document counts a phrase, and how much commoner in toxic documents it has to be.
OFTEN, LIFT = 3, 4.0
#: Part of a beginning's count that a longer one needs to stand for it.
MOSTLY = 0.8
WORDS, WINDOW, DECAY, COST = 3, 5, 0.6, 50.0
BUCKETS = 1 << 18
#: Bytes of texts that a task scores at once.
CHUNK = 1 << 20
_GAPS = [(a, b) for b in range(2, WINDOW) for a in range(1, b)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Model(NamedTuple):
    """Weights per hashed subsequence and bias of sentences; weights of (share, top margin, 1) of documents."""

    weights: np.ndarray
    bias: float
    pooling: np.ndarray


def _code(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(2654435761) + b * np.uint32(2246822519) + c * np.uint32(3266489917)) * np.uint32(668265263)) >> np.uint32(14)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of CHUNK bytes at most, cut at spaces where there are any."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(b" ", at + 1, at + CHUNK) + 1 or at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined, each behind a space and with its separators as spaces; the edges of sentences; the text of each sentence.

    Sentence i reaches from the space at edges[i] to the one at edges[i + 1] (for the last one, the end), both included.
    """
    raw = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.where(_SPACE[raw], np.uint8(32), raw)
    spaces = np.nonzero(data == 32)[0]
    stop = (raw[spaces] == 10) | _STOP[raw[spaces - 1]]
    stop[np.searchsorted(spaces, begins[:-1])] = True
    quarters = np.where(np.diff(np.append(spaces, len(data))) > 2, 4, 1)
    before = np.cumsum(quarters) - quarters
    place = (before - np.maximum.accumulate(np.where(stop, before, 0))) // (4 * WORDS)
    edges = spaces[stop | (np.diff(place, prepend=0) != 0)]
    return data, np.append(edges, len(data)), np.searchsorted(begins, edges, side="right") - 1


def _codes(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the code at each byte, where its subsequence ends within its sentence, and its weight."""
    limit, at = np.repeat(edges[1:], np.diff(edges)), np.arange(len(data))
    wide = np.concatenate([data, np.full(WINDOW, 32, np.uint8)]).astype(np.uint32)
    for a, b in _GAPS:
        yield _code(wide[: len(data)], wide[a : len(data) + a], wide[b : len(data) + b]), at + b <= limit, DECAY ** (b - 2)


def _norms(edges: np.ndarray) -> np.ndarray:
    """Square root of the squared weights of all subsequences of each sentence with its edges."""
    size = np.diff(edges) + 1
    return np.sqrt(sum(np.maximum(size - b, 0) * DECAY ** (2 * (b - 2)) for _, b in _GAPS) + 1e-9)


def margins(data: np.ndarray, edges: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each sentence."""
    sums = np.zeros(len(data), np.float32)
    for code, inside, decay in _codes(data, edges):
        sums += np.where(inside, weights[code], 0) * np.float32(decay)
    return np.add.reduceat(sums, edges[:-1], dtype=np.float64) / _norms(edges) + bias


def _train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps on the squared hinge, block by block; the last weight is the bias."""
    size = x.shape[1] + 1
    w, ridge = np.zeros(size), np.eye(size)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        gram, right = ridge.copy(), np.zeros(size)
        for i in range(0, len(x), 1000):
            part = np.concatenate([x[i : i + 1000], np.ones((len(x[i : i + 1000]), 1))], axis=1, dtype=np.float64)
            active = y[i : i + 1000] * (part @ w) < 1
            part, weighted = part[active], part[active] * cost[i : i + 1000][active, None]
            gram += weighted.T @ part
            right += weighted.T @ y[i : i + 1000][active]
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


class Nystroem:
    """Features of sentences: K(landmarks)^(-1/2) k(landmarks, sentence), of normalised kernels."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.column = np.full(BUCKETS, -1, np.int32)
        made: list[dict[int, float]] = []
        for mark in landmarks:
            data, edges = _whole([mark])
            own: dict[int, float] = {}
            for code, inside, decay in _codes(data, edges):
                for k in code[inside].tolist():
                    own[k] = own.get(k, 0.0) + decay
            made.append({k: v / float(_norms(edges)[0]) for k, v in own.items()})
        self.codes = np.array(sorted({k for f in made for k in f}), np.int64)
        self.column[self.codes] = np.arange(len(self.codes))
        self.marks = np.zeros((len(made), len(self.codes)))
        for i, f in enumerate(made):
            self.marks[i, self.column[list(f)]] = list(f.values())
        values, vectors = np.linalg.eigh(self.marks @ self.marks.T)
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        self.map = (self.marks.T @ self.root).astype(np.float32)

    def with_more(self, sentences: list[str]) -> "Nystroem":
        """With MINED more landmarks, the words of the first sentences that aren't landmarks yet."""
        known = set(self.landmarks)
        return Nystroem([*self.landmarks, *list(dict.fromkeys(w for x in sentences for w in x.split() if w not in known))[:MINED]])

    def features(self, sentences: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(sentences), 250):
            data, edges = _whole(sentences[i : i + 250])
            total = np.zeros((len(edges) - 1, self.map.shape[1]))
            for code, inside, decay in _codes(data, edges):
                at = np.nonzero(inside & (self.column[code] >= 0))[0]
                if len(at):
                    owner = np.searchsorted(edges, at, side="right") - 1
                    some, first = np.unique(owner, return_index=True)
                    total[some] += decay * np.add.reduceat(self.map[self.column[code[at]]], first)
            out.append((total / _norms(edges)[:, None]).astype(np.float32))
        return np.concatenate(out) if out else np.empty((0, self.map.shape[1]))

    def fold(self, w: np.ndarray) -> np.ndarray:
        """The weight of every hashed subsequence in the function with weights w."""
        table = np.zeros(BUCKETS, np.float32)
        table[self.codes] = self.map @ w
        return table


def _whole(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sentences as in flatten, but not cut."""
    own = [b" " + x.encode() for x in sentences]
    raw = np.frombuffer(b"".join(own), np.uint8)
    return np.where(_SPACE[raw], np.uint8(32), raw), np.cumsum([0, *map(len, own)])


def fit_sentences(space: Nystroem, toxic: list[str], clean: list[str]) -> tuple[np.ndarray, float]:
    """Weights per hashed subsequence, and the bias, of the machine trained on labelled sentences."""
    x = space.features([*toxic, *clean])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    cost = np.where(y > 0, COST * max(1.0, len(clean) / max(1, len(toxic)) / 4), COST)
    w = _train_svm(x, y, cost)
    return space.fold(w[:-1]), float(w[-1])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (toxic, sentence)."""
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _parts(text.as_buffer().to_pybytes()):
                data, edges, _ = flatten([part])
                made = [data[a:b].tobytes().strip() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                made = [x.decode(errors="ignore") for x in made if x]
                yield pa.record_batch([pa.array([toxic] * len(made), pa.int32()), pa.array(made, pa.string())], ["toxic", "sentence"])


def _pool(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column is the text; instead of it: sentences, toxic ones (margins from -0.5 to 0.5 count in part), and the highest margin."""
        for batch in batches:
            count, hits, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.full(batch.num_rows, -3.0)
            rows, parts, size = [], [], 0

            def close() -> None:
                data, edges, owner = flatten(parts)
                got, use = margins(data, edges, weights, bias), np.add.reduceat(data != 32, edges[:-1]) > 0
                row, got = np.array(rows)[owner[use]], got[use]
                np.add.at(count, row, 1)
                np.add.at(hits, row, np.clip(got + 0.5, 0, 1))
                np.maximum.at(top, row, got)

            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for part in _parts(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    if size + len(part) > CHUNK and parts:
                        close()
                        rows, parts, size = [], [], 0
                    rows.append(i)
                    parts.append(part)
                    size += len(part)
            if parts:
                close()
            yield pa.record_batch([*batch.columns[:-1], pa.array(count), pa.array(hits), pa.array(top)], [*batch.schema.names[:-1], "sentences", "hits", "top"])

    return run


def _pooled(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    own = docs.withColumn("text", F.lower("text").cast("binary"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return map_arrow(own, _pool(weights, bias), f"{schema}, sentences long, hits double, top double")


#: What the logistic fit reads: the logarithm of the smoothed share of toxic sentences, and the highest margin within bounds.
SHARE, TOP = "ln((hits + 0.1D) / (sentences + 5))", "greatest(-2D, least(2D, top))"


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with softened targets; the last column of z is 1."""
    n1, n0 = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    t, w = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(z.shape[1])
    ridge = np.diag([0.01] * (z.shape[1] - 1) + [1e-4])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - t) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _witnesses(sample: DataFrame) -> list[str]:
    """Words, and beginnings of longer ones, that toxic documents hold too often for chance, however many were tried.

    A document counts a phrase up to OFTEN times, so the test asks for as many times the evidence.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    begins = F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda k: k < F.length("w")), lambda k: F.substring("w", F.lit(1), k))
    each = sample.select("toxic", F.xxhash64("text").alias("doc"), F.explode(words).alias("w")).groupBy("toxic", "doc", "w").agg(F.count("*").alias("n"))
    each = each.select("toxic", "doc", "n", F.explode(F.concat(F.array("w"), begins)).alias("phrase"))
    counts = each.groupBy("toxic", "doc", "phrase").agg(F.least(F.sum("n"), F.lit(OFTEN)).alias("n")).groupBy("phrase").agg(F.sum(F.col("toxic") * F.col("n")).alias("bad"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("good"))
    counts = materialize(counts, "phrases")
    tried, bad, good = counts.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    share = bad / (bad + good)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((F.col("bad") + F.col("good")) * p))).otherwise(0.0)
    evidence = part(F.col("bad"), share) + part(F.col("good"), 1 - share)
    seen = counts.where((evidence > 2 * (float(np.log(tried + 1)) + 1)) & (F.col("bad") * good > LIFT * (F.col("good") + 0.2) * bad)).orderBy(evidence.desc(), "phrase").limit(4 * LANDMARKS).collect()
    # a beginning whose count is mostly that of a longer one says nothing more
    return [r["phrase"] for r in seen if not any(x["phrase"] != r["phrase"] and x["phrase"].startswith(r["phrase"]) and x["bad"] > MOSTLY * r["bad"] for x in seen)][:LANDMARKS]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs: (doc_id, text), labels: (doc_id, toxic). None where nothing tells the labels apart.

    Labels are sampled first, so texts meet at most 2 * TRAIN_DOCS broadcast rows, of distinct ids.
    """
    once = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = materialize(first_by_hash(once, "doc_id", TRAIN_DOCS, "toxic"), "wanted")
    found = docs.where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialize(found.groupBy("text").agg(F.max("toxic").alias("toxic")), "train")  # copies count once
    whole = _machine(sample)
    if whole is None:
        return None
    # what the machine says of its own training rows is too sure, so the fit reads rows that another machine has not seen
    apart = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(PARTS)) == 0
    other = _machine(sample.where(~apart))
    rows = _pooled((sample.where(apart) if other else sample).select("toxic", "text"), *(other or whole))
    rows = rows.selectExpr("toxic", f"{SHARE} AS share", f"{TOP} AS top").toPandas()  # at most 2 * TRAIN_DOCS rows
    return Model(*whole, _logistic(np.stack([rows["share"], rows["top"], np.ones(len(rows))], 1), rows["toxic"].to_numpy()))


def _machine(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and bias of the sentence machine; sample: (toxic, text), of distinct texts. None where nothing tells the labels apart."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    witnesses = _witnesses(sample) if len(sizes) == 2 else []
    if not witnesses:
        return None
    cut = map_arrow(sample.select("toxic", F.lower("text").cast("binary").alias("text")), _sentences, "toxic int, sentence string")
    # a sentence that both labels share says nothing
    cut = cut.groupBy("sentence").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).where("toxic = least").drop("least")
    held = F.exists(F.array(*map(F.lit, witnesses)), lambda w: F.contains(F.concat(F.lit(" "), "sentence"), F.concat(F.lit(" "), w)))
    cut = materialize(cut.withColumn("order", F.xxhash64("sentence")).withColumn("known", (F.col("toxic") == 1) & held), "sentences")
    first = lambda df, *order: [r["sentence"] for r in df.orderBy(*order, "order").limit(SENTENCES).select("sentence").collect()]
    toxic, clean = first(cut.where("known")), first(cut.where("toxic = 0"))
    if not toxic or not clean:
        return None
    words = [w for x in clean for w in x.split()]
    space = Nystroem([*witnesses, *list(dict.fromkeys(words))[: 2 * LANDMARKS]])
    for _ in range(ROUNDS):
        weights, bias = fit_sentences(space, toxic, clean)
        scored = materialize(map_arrow(cut.select("toxic", "known", "sentence", "order", F.col("sentence").cast("binary").alias("text")), _pool(weights, bias), "toxic int, known boolean, sentence string, order long, sentences long, hits double, top double"), "scored")
        toxic = first(scored.where("known OR (toxic = 1 AND top > 0)"))
        hard = scored.where("toxic = 0 AND top > -0.9").orderBy(F.desc("top"), "order").limit(HARD).select("sentence").collect()
        hard = [r["sentence"] for r in hard]
        clean = list(dict.fromkeys([*clean, *hard]))
        space = space.with_more(hard)
    return fit_sentences(space, toxic, clean)


def score(docs: DataFrame, model: Model | None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) per row of docs."""
    own = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"))
    share, top, one = map(float, model.pooling)
    logit = F.expr(SHARE) * share + F.expr(TOP) * top + one
    return _pooled(own, model.weights, model.bias).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    held = lambda x: F.crc32(F.col(x).cast("string").cast("binary")) % 3 == 1
    scored = score(docs, fit(docs, labels.where(~held("doc_id"))))
    return scored.select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
