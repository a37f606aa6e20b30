"""Secret scans with an incremental blob ledger, by DataFrame functions only.

Every text is addressed by its SHA-256. Only blobs that the ledger has not seen under the present
rule version are scanned, each once however many documents carry it; the findings are then joined
back to all paths. Copies are folded before the shuffle, so a text that a third of all rows share
reaches one task as one row from each map task.

Spans: splitting a text by a pattern gives the gaps between its leftmost non-overlapping matches,
and extracting all matches gives what stands between the gaps, so both lists together place every
match by running sums of lengths in code points.

Defined results: null text counts as empty; empty texts have no spans; repeated rows give repeated
rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: kind, pattern, group whose length counts, least length (fixed values of the contract).
BASE_RULES = [
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
#: Rules beyond the base: key block headers and signed web tokens.
MORE_RULES = [
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 1),
]
#: A cheap test that every text with a finding passes.
MAYBE = "[:=]|AKIA|[0-9a-f]{24}|-----BEGIN|eyJ"
RULE_VERSION = "1"


#: The same matches found faster: runs too short to count are never matched.
QUICK = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    pattern = QUICK.get(kind, pattern)
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    triples = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), sized.alias("part"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,size:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), F.length(x["part"]).alias("size"))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["hit"].isNull() | (span["size"] < least), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(triples, start, step, lambda acc: acc["spans"])).otherwise(empty)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, text) to (blob, spans): every rule's kept matches, by start and then kind."""
    texts = F.col("text")
    each = [_spans(texts, i, *rule) for i, rule in enumerate(BASE_RULES + MORE_RULES)]
    return blobs.where(texts.rlike(MAYBE)).select("blob", F.array_sort(F.concat(*each)).alias("spans")).where(F.size("spans") > 0)


def scan_secrets(paths: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what is new and join findings to all paths.

    ledger (blob, version) and findings (blob, spans, version) are earlier outputs or None. Returns
    (path with spans of this version, ledger, findings), the last two of all versions, with this run's additions.
    """
    addressed = paths.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    blobs = addressed.select("blob", "text").dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("version") == version), "blob", "left_anti")
    fresh = materialize(scan_blobs(blobs).withColumn("version", F.lit(version)), "findings")
    found = fresh if findings is None else findings.unionByName(fresh)
    seen = addressed.select("blob").distinct().withColumn("version", F.lit(version))
    seen = seen if ledger is None else ledger.unionByName(seen).distinct()
    present = found.where(F.col("version") == version).select("blob", "spans")
    return addressed.select("path", "blob").join(present, "blob", "left"), seen, found


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every version in ``documents`` against an empty ledger."""
    scanned, _, _ = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,size:int>>"))
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE_RULES))
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter(spans, lambda s: s["kind_no"] == i)).cast("long")
    return scanned.select(
        F.col("path").alias("doc_id"),
        *(count(i).alias(f"n_{rule[0]}") for i, rule in enumerate(BASE_RULES)),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(spans).alias("spans"),
    )


def _rule_sql(i: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, row_id, {i} AS kind_no, '{kind}' AS kind,
  unnest(list_transform(range(1, len(hits) + 1), lambda i: CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT))) AS start,
  unnest(hits) AS hit, unnest(parts) AS part, {least} AS least
  FROM (SELECT doc_id, row_id, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS gaps FROM docs)"""


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_rule_sql(i, *r) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
kept AS (SELECT row_id, kind_no, kind, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM found WHERE length(part) >= least),
per AS (SELECT row_id, count(*) FILTER (WHERE kind_no = 0) AS n0, count(*) FILTER (WHERE kind_no = 1) AS n1, count(*) FILTER (WHERE kind_no = 2) AS n2,
  string_agg(span, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < 3) AS base, string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM kept GROUP BY row_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row_id)
"""
