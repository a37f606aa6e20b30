"""Chat formatting: relational formatting of turns with Spark expressions only.

Every conversation's turns are collected as structs, sorted, adjacent turns of one role are merged
by array functions, and the parts are concatenated. The template of a merged turn is

    <s>[INST]role[/INST]text[SEP]text</s>

Control strings inside roles and texts are escaped: a backslash is doubled, then a backslash is set
behind the first character of every control string. Unescaping reverses both steps exactly.

Defined results: null text and null role count as empty; ties of the turn number go by role, then
text; a null turn number sorts first; repeated rows are turns of their own; rows with a null
conversation id form one conversation; other columns of the input are ignored; an empty table gives
an empty table. A conversation is one row of the output, so its turns meet in one group by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, ROLE, END_ROLE, SEPARATOR, CLOSE = "<s>", "[INST]", "[/INST]", "[SEP]", "</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, "<(/?s>)", "<\\\\$1"), "\\[(/?INST\\]|SEP\\])", "[\\\\$1")


def unescape(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "\\[\\\\(/?INST\\]|SEP\\])", "[$1"), "<\\\\(/?s>)", "<$1")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: (conv, formatted, loss).

    loss is the mask: structs (segment, start, length), where segment numbers the merged turns from
    0 and start (from 1) and length count characters of that turn's part of ``formatted``.
    """
    escaped = df.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("said"),
    )
    turns = escaped.groupBy("conv").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    starts = turns.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])),
    )
    runs = starts.select(
        "conv",
        F.transform("starts", lambda s, j: F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s)).alias("runs"),
    )
    head = lambda run: F.concat(F.lit(OPEN + ROLE), run[0]["role"], F.lit(END_ROLE))
    wide = len(SEPARATOR)
    spans = F.transform(
        "runs",
        lambda run, k: F.when(
            run[0]["role"] == learn,
            F.transform(
                run,
                lambda t, i: F.struct(
                    k.alias("segment"),
                    (F.length(head(run)) + 1 + F.aggregate(F.slice(run, 1, i), F.lit(0), lambda n, x: n + F.length(x["text"]) + wide)).alias("start"),
                    F.length(t["text"]).alias("length"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<segment:int,start:int,length:int>>")),
    )
    parts = F.transform("runs", lambda run: F.concat(head(run), F.array_join(F.transform(run, lambda t: t["text"]), SEPARATOR), F.lit(CLOSE)))
    return runs.select("conv", F.array_join(parts, "").alias("formatted"), F.flatten(spans).alias("loss"))


def read_chat(df: DataFrame) -> DataFrame:
    """Read (conv, formatted, loss) back: (conv, formatted, turns array<struct<role,text>>, learned array<string>)."""
    cut = df.withColumn("segments", F.split("formatted", "(?<=</s>)", -1)).withColumn("segments", F.filter("segments", lambda x: x != ""))
    body = lambda x: F.split(F.substring(x, len(OPEN + ROLE) + 1, 2**31 - 1), "\\[/INST\\]", 2)
    texts = lambda x: F.split(F.regexp_replace(x, "</s>$", ""), "\\[SEP\\]", -1)
    said = F.flatten(
        F.transform("segments", lambda x: F.transform(texts(body(x)[1]), lambda t: F.struct(unescape(body(x)[0]).alias("role"), unescape(t).alias("text"))))
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.get("segments", s["segment"]), s["start"], s["length"])))
    return cut.select("conv", "formatted", said.alias("turns"), learned.alias("learned"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and conversation -1, and digest what is read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_chat(format_chat(turns.union(planted)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("learned", F.array_join("learned", "")).select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ESCAPED_SQL = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\]|SEP\])', '[\\\1', 'g')"

ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, {ESCAPED_SQL.format("role")} AS erole, {ESCAPED_SQL.format("text")} AS etext FROM rows),
prev AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, erole, etext) AS before FROM esc)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, erole, etext)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, erole, etext) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN before IS NULL OR before <> role THEN 20 + length(erole) ELSE 5 END) AS BIGINT) AS formatted_chars
FROM prev GROUP BY conv_id
"""
