"""Language ID by Bayesian evidence fusion.

Text likelihoods: smoothed byte-trigram log likelihoods of every language, and of a uniform
background that stands for "none of them", summed over whole texts and tempered, as neighbouring
trigrams aren't independent. They are fitted on the whole texts of at most ``TRAIN_DOCS`` labelled
documents of each label that holds one of ``LEAST_SHARE`` labelled rows or more; tasks count their trigrams.

Other evidence enters as log probabilities learnt from all rows by grouped aggregation of the text
posteriors: the declared markup language, the address suffix, and a prior of the host that is
smoothed towards its domain's, which is smoothed towards the whole corpus's. Aggregates combine
before they shuffle, and rows look their evidence up in tables whose large keys are broadcast, so a
host with a third of all rows never meets in one task.

Defined results: null or empty text, or text without letters, has no text evidence and is rejected
("und"), whatever else is declared; missing evidence of any other kind is neutral; pages without
markup or address have no text or no host; repeated rows give repeated rows; other columns are
ignored; without a labelled document every row is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_by_hash, lookup, map_arrow, materialize, small_side, spare

TRAIN_DOCS = 300
#: A label is learnt if it holds at least one of so many labelled rows, which bounds the languages and so the model: 256 KB each.
LEAST_SHARE = 1000
BUCKETS = 1 << 16
#: Share of the uniform background in every language, so that no trigram weighs more than log(1 / UNIFORM) against it.
UNIFORM = 0.1
#: Evidence of this many trigrams counts as independent, at most.
EFFECTIVE = 40.0
#: Pseudo-counts of the smoothing from domain to host, from corpus to domain, and of the declared evidence.
HOST_SMOOTH, DOMAIN_SMOOTH, OTHER_SMOOTH = 20.0, 50.0, 5.0
#: Bytes whose trigrams are looked up at once.
CHUNK = 1 << 18


class Model(NamedTuple):
    """languages, and a table (BUCKETS, languages) of log probabilities of trigrams."""

    languages: tuple[str, ...]
    table: np.ndarray


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of a text's lower-cased byte trigrams that hold a letter, edges as spaces, chunk by chunk."""
    data = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    for at in range(0, len(data) - 2, CHUNK):
        part = data[at : at + CHUNK + 2]
        a = part.astype(np.uint32)
        codes = (a[:-2] * np.uint32(40503) + a[1:-1] * np.uint32(1566083941) + a[2:] * np.uint32(2654435761)) >> np.uint32(16)
        yield codes[_LETTER[part[:-2]] | _LETTER[part[1:-1]] | _LETTER[part[2:]]].astype(np.intp)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for label in np.unique(labels):
            counts = np.zeros(BUCKETS, np.int64)
            for i in np.nonzero(labels == label)[0].tolist():
                for codes in trigrams(batch.column(1)[i].as_buffer().to_pybytes()):
                    counts += np.bincount(codes, minlength=BUCKETS)
            some = np.nonzero(counts)[0]
            yield pa.record_batch([pa.array([label] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bucket", "n"])


def _score(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = np.zeros((batch.num_rows, table.shape[1])), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text")):
                for codes in trigrams(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    out[i] += table[codes].sum(0, dtype=np.float64)
                    n[i] += len(codes)
            columns = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            mean = out / np.maximum(n, 1)[:, None]
            yield pa.record_batch([*columns, pa.array(n), pa.array(list(mean), pa.list_(pa.float64()))], [*names, "trigrams", "mean_ll"])

    return run


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc: str = "doc_id", limit: int = TRAIN_DOCS) -> Model:
    """Fit on ``limit`` documents of each language, the first in the order of a hash of their ids."""
    own = docs.select(F.col(doc).alias("doc"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialize(own.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    labelled = counts.agg(F.sum("n")).first()[0] or 0
    languages = sorted(r["lang"] for r in counts.where(F.col("n") * LEAST_SHARE >= labelled).collect())  # at most LEAST_SHARE
    sample = first_by_hash(own.where(F.col("lang").isin(languages)), "doc", limit, "lang")
    counted = map_arrow(sample.select("lang", "text"), _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(languages)), 1e-9)
    rows = counted.toPandas()  # at most BUCKETS rows for each language
    counts[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] += rows["n"]
    return Model(tuple(languages), np.log((1 - UNIFORM) * counts / counts.sum(0) + UNIFORM / BUCKETS).astype(np.float32))


def _posterior(logs: Column) -> Column:
    """Normalised exponentials of an array of log weights."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def identify(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """rows: keys, text, declared, suffix, domain, host (strings or null). Returns keys, language, confidence, rejected.

    A row is rejected if it has no letters, or if its text is likelier under the uniform background
    than under every language.
    """
    size = len(model.languages)
    if not size:
        return rows.select(*keys, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"), "declared", "host")
    own = rows.select(*keys, F.col("text").cast("binary").alias("text"), "declared", "suffix", "domain", "host")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    scored = map_arrow(own, _score(model.table), f"{schema}, trigrams long, mean_ll array<double>")
    scale = F.least(F.col("trigrams").cast("double"), F.lit(EFFECTIVE))
    scored = materialize(scored.withColumn("ll", F.transform("mean_ll", lambda x: x * scale)).withColumn("p", _posterior(F.col("ll"))), "scored")
    sure = scored.where("trigrams > 0")
    sums = [F.sum(F.get("p", i)).alias(f"s{i}") for i in range(size)]
    whole = sure.agg(*sums).first()
    total = [(whole[f"s{i}"] or 0.0) + 1.0 for i in range(size)]
    base = [x / sum(total) for x in total]
    n = sum((F.col(f"s{i}") for i in range(1, size)), F.col("s0"))

    def by(column: str, *more: Column) -> DataFrame:
        return sure.where(f"{column} IS NOT NULL").groupBy(column).agg(*more, F.count("*").alias("rows"), *sums)

    def shares(parent: list[Column], weight: float) -> Column:
        return F.array(*((F.col(f"s{i}") + weight * parent[i]) / (n + weight) for i in range(size)))

    domains = by("domain").select("domain", shares([F.lit(x) for x in base], DOMAIN_SMOOTH).alias("domain_p"), F.col("rows").alias("domain_rows"))
    hosts = by("host", F.min("domain").alias("domain"))
    hosts = lookup(materialize(hosts, "hosts"), materialize(domains, "domains"), ["domain"], "domain_rows")
    parent = [F.coalesce(F.get("domain_p", i), F.lit(base[i])) for i in range(size)]
    hosts = hosts.select("host", shares(parent, HOST_SMOOTH).alias("host_p"), F.col("rows").alias("host_rows"))

    def evidence(column: str) -> DataFrame:
        """P(value | language), smoothed towards the value's share of all rows."""
        values = materialize(by(column), column)
        all_of = values.agg(*(F.sum(f"s{i}").alias(f"t{i}") for i in range(size))).first()
        every = sum(all_of[f"t{i}"] or 0.0 for i in range(size)) or 1.0
        logs = [F.log((F.col(f"s{i}") + OTHER_SMOOTH * n / every) / F.lit((all_of[f"t{i}"] or 0.0) + OTHER_SMOOTH)) for i in range(size)]
        return values.select(column, F.array(*logs).alias(f"{column}_l"), F.col("rows").alias(f"{column}_rows"))

    joined = scored
    for column, table in (("host", hosts), ("declared", evidence("declared")), ("suffix", evidence("suffix"))):
        joined = lookup(joined, materialize(table, "evidence"), [column], f"{column}_rows")
    zero = F.array(*[F.lit(0.0)] * size)
    prior = F.coalesce("host_p", F.array(*map(F.lit, base)))
    fused = F.zip_with(
        F.zip_with("ll", F.transform(prior, lambda x: F.log(x)), lambda a, b: a + b),
        F.zip_with(F.coalesce("declared_l", zero), F.coalesce("suffix_l", zero), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    posterior = joined.withColumn("posterior", _posterior(fused))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    rejected = (F.col("trigrams") == 0) | (F.array_max("mean_ll") < F.lit(-float(np.log(BUCKETS))))
    return posterior.select(
        *keys,
        F.when(rejected, "und").otherwise(F.get(F.array(*map(F.lit, model.languages)), best - 1)).alias("language"),
        F.when(F.col("trigrams") == 0, 0.0).otherwise(F.array_max("posterior")).alias("confidence"),
        rejected.alias("rejected"),
        "declared",
        "host",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows for identify(): text is what stands outside tags, scripts and styles."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    path = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/([a-z]{2})(?:/|$)", 1)
    none = lambda c: F.when(c != "", c)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", text.alias("text"), none(declared).alias("declared"),
        none(F.concat_ws("/", none(F.regexp_extract(host, "([^.]+)$", 1)), none(path))).alias("suffix"), none(F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1)).alias("domain"), none(host).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for identify(): the source is the host; nothing is declared, as ``lang`` is what is learnt."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents and all pages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = document_rows(docs).unionByName(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return identify(rows, train(docs), ["doc_id", "page_id"]).withColumn("kept", ~F.col("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; of rows with equal id and text all stay or go together."""
    key = spare(docs, "key")[0]
    hashed = F.xxhash64("doc_id", "text")
    rows = document_rows(docs).withColumn("key", hashed)
    gone = identify(rows, train(docs), ["key"]).where("rejected").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, hashed).join(small_side(materialize(gone, "rejected")), key, "left_anti").select(*docs.columns)
