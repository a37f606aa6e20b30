"""Names by dictionary (F21): places and organisations found by one automaton over all of them.

Names (name, label) are checked for size, then built into an Aho-Corasick automaton in each task, once. It
reads a text once, whatever the number of names; of all matches that stand between word bounds the leftmost are kept, of
those that begin together the longest, and none overlaps another. A dictionary larger than ``PART_BYTES`` is looked for in parts, one pass
each, and what all parts have found is settled at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import map_arrow

PART_BYTES = 32 << 20
#: start and end count characters.
SPANS = "array<struct<start:int,end:int,label:string>>"
_BUILT: dict[int, ahocorasick.Automaton] = {}


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def matches(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, label) of every name between word bounds."""
    out = []
    for last, (length, label) in automaton.iter(text) if len(automaton) else ():
        start, end = last + 1 - length, last + 1
        if (start == 0 or not _word(text[start - 1]) or not _word(text[start])) and (end == len(text) or not _word(text[end]) or not _word(text[end - 1])):
            out.append((start, end, label))
    return out


def automaton(names: list[tuple[str, str]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name, label in sorted(names, reverse=True):  # of a name's labels the first stays
        made.add_word(name, (len(name), label))
    made.make_automaton()
    return made


def _find(names: list[tuple[str, str]], at: tuple[int, int], columns_: list[str], settle: bool):
    key = hash(tuple(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(names)
        for batch in batches:
            spans = []
            for text, before in zip(batch.column(at[0]), batch.column(at[1]).to_pylist(), strict=True):
                now = [(s["start"], s["end"], s["label"]) for s in before or ()] + matches(text.as_py() or "", _BUILT[key])
                spans.append([dict(zip(("start", "end", "label"), s, strict=True)) for s in (leftmost_longest(now) if settle else now)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
            columns = list(batch.columns)
            columns[at[1]] = pa.array(spans, kind)
            yield pa.record_batch(columns, names=columns_)

    return run


def find_names(df: DataFrame, names: DataFrame, text: str = "text", out: str = "names", part_bytes: int = PART_BYTES) -> DataFrame:
    """df with the column ``out``: SPANS of the names in its texts. A null or empty name is none; null texts have no names."""
    own = names.select(F.col("name").cast("string"), F.col("label").cast("string")).where("name <> '' AND label IS NOT NULL").distinct()
    size = own.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    made = df.withColumn(out, F.array().cast(SPANS))
    at = made.columns.index(text), made.columns.index(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    for part in range(parts):
        mine = own.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        rows = [(r["name"], r["label"]) for r in mine.collect()]  # about ``part_bytes``
        made = map_arrow(made, _find(rows, at, made.columns, part == parts - 1), schema)
    return made


def places_and_organisations(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """(name, label) of the given tables: nations and regions are LOC, suppliers ORG."""
    entry = lambda df, c, label: df.select(F.col(c).alias("name"), F.lit(label).alias("label"))
    return entry(nation, "n_name", "LOC").unionByName(entry(region, "r_name", "LOC")).unionByName(entry(supplier, "s_name", "ORG"))

