"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared scratch folder and read again as the next stage's docs. All but the last return the columns
of ``documents``, and may be given more, of any name.

Defined results, stage by stage. Null and empty texts, and texts without letters, are rejected by the first stage; given to a later one by
itself they stay (line dedup, of which an emptied text goes only if lines were deleted from it), are copies of one another (near-dedup), are mixed with size 0, and are one piece, the
closing id. Ids may be null or shared: rows count by id and text together. Of equal rows near-dedup keeps one, the same one on every run; line dedup, mixing and packing treat
each as a row of its own. Ties go by id, then by a hash of the text or of all columns. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language_id, line_dedup, mixing, near_dedup, packing
from foliant.llm.common import materialize, spare


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letters, or no known language) go."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    lost = spare(docs, "lost")[0]
    out = line_dedup.dedup_lines(docs, deleted=lost)
    return out.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: near copies, found by SimHash and by minimum hashes, share 0.8 of their five-word shingles or more."""
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources come near their targets."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express tokenisation, hashed rounding or trained models; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
