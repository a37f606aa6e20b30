"""File sources (S1-S17 but the engines for PDF and character recognition): dispatch by type, file statistics, readers for zipped office formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import map_arrow

#: Extension to type (fixed values).
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}
UNKNOWN = "application/octet-stream"
MAX_BYTES = 104_857_600
#: Blocks, and bytes of files, after which a task hands on what it has read.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: cells holds a table's header in its first row; title is the heading above a paragraph; properties are those of a sheet or document.
BLOCKS = "path string, kind string, ord int, page int, text string, level int, cells array<array<string>>, title string, properties map<string,string>, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def mime(path: Column) -> Column:
    """S17."""
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.element_at(known, extension(path)), F.lit(UNKNOWN))


def reader_of(path: Column) -> Column:
    """Which reader takes a file; null for none."""
    kind = mime(path)
    return F.when(kind == TYPES["pdf"], "pdf").when(kind.isin(TYPES["xlsx"], TYPES["xls"]), "excel").when(kind.isin(TYPES["docx"], TYPES["doc"]), "word").when(kind.startswith("image/"), "image")


def read_files(spark: SparkSession, folder: str, empty: bool = True) -> DataFrame:
    """Name, size, time and type of every file; content only where a later step asks for it.

    The reader skips empty files; with ``empty`` tasks list the folders to show them. No list of names is made on the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if empty:
        from . import block_source

        block_source.register(spark)
        none = spark.read.format("blocks").option("parse", "false").load(folder).where("length <= 0")
        files = files.unionByName(none.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), "length", F.lit(b"").alias("content")))
    return files.withColumns({"filename": F.element_at(F.split("path", "/"), -1), "mime": mime(F.col("path")), "reader": reader_of(F.col("path"))})


def rejects(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files that can't be read, with the reason."""
    reason = F.when(F.col("length") <= 0, "empty").when(F.col("length") > most, "too large").when(F.col("reader").isNull(), "not supported")
    return files.select("path", "filename", "length", "mime", reason.alias("reason")).where("reason IS NOT NULL")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _read(z: zipfile.ZipFile, name: str) -> ElementTree.Element | list:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else []


def _number(name: str) -> int:
    return int(re.findall(r"\d+", name)[-1])


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet in the workbook's order; by number, without a name, where the workbook doesn't say."""
    parts = {r.get("Id"): "xl/" + r.get("Target", "").removeprefix("/xl/") for r in _read(z, "xl/_rels/workbook.xml.rels")}
    listed = [x for part in _read(z, "xl/workbook.xml") if _local(part.tag) == "sheets" for x in part]
    named = [(x.get("name", ""), parts.get(next((v for k, v in x.attrib.items() if k.startswith("{") and _local(k) == "id"), None))) for x in listed]
    found = [(name, part) for name, part in named if part in z.namelist()]
    return found or [("", n) for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)]


def parse_xlsx(data: bytes) -> Iterator[dict]:
    """A table per sheet that has any, blank rows dropped, cells as stripped text, the sheet's name among its properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _read(z, "xl/sharedStrings.xml")]
        tables = 0
        for sheet, part in _sheets(z):
            rows = []
            for row in (r for r in _read(z, part).iter() if _local(r.tag) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                    cells += [""] * (at - len(cells)) + [(shared[int(value)] if c.get("t") == "s" and value else value).strip()]
                rows.append(cells)
            rows = [r for r in rows if any(r)]
            if rows:
                yield {"kind": "table", "ord": tables, "cells": rows, "properties": [("sheet_name", sheet)]}
                tables += 1


def parse_docx(data: bytes) -> Iterator[dict]:
    """Paragraphs that aren't blank, with heading levels and the heading above them, tables, and one row of core properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in _read(z, "word/document.xml") if _local(x.tag) == "body")
        core = {_local(x.tag): x.text for x in _read(z, "docProps/core.xml") if x.text}
    known = [(name, core[tag]) for name, tag in (("title", "title"), ("author", "creator"), ("created", "created"), ("modified", "modified")) if tag in core]
    if known:
        yield {"kind": "properties", "ord": 0, "properties": known}
    texts, tables, title = 0, 0, None
    words = lambda x: "".join(t.text or "" for t in x.iter() if _local(t.tag) == "t").strip()
    for x in body:
        kind = _local(x.tag)
        if kind == "p" and (said := words(x)):
            style = next((v for s in x.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            last, heading = re.search(r"(\d+)$", style), "Heading" in style
            title = said if heading else title
            yield {"kind": "text", "ord": texts, "text": said, "level": (int(last[1]) if last else 1) if heading else None, "title": title}
            texts += 1
        elif kind == "tbl":
            rows = [[words(c) for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]
            if rows:
                yield {"kind": "table", "ord": tables, "cells": rows}
                tables += 1


#: Readers by name; register more with your own parser, bytes to dicts with the fields of BLOCKS.
PARSERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"excel": parse_xlsx, "word": parse_docx}


def extract(files: DataFrame, parsers: dict[str, Callable[[bytes], Iterator[dict]]] | None = None) -> DataFrame:
    """One row per block of each file that isn't rejected (P16); a file that fails gives one row with its error."""
    parsers = dict(PARSERS if parsers is None else parsers)
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one file's bytes at a time, blocks in batches
                path, reader, data = (batch.column(c)[i].as_py() for c in range(3))
                try:
                    held += [{"path": path, **block} for block in parsers[reader](data)]
                except Exception as why:  # noqa: BLE001  one bad file must not end the job
                    held.append({"path": path, "kind": "error", "error": f"{type(why).__name__}: {why}"})
                read += len(data)
                if len(held) >= BATCH_ROWS or read >= BATCH_BYTES:
                    yield made(held)
                    held, read = [], 0
        if held:
            yield made(held)

    fit = files.where(F.col("reader").isin(list(parsers)) & F.col("length").between(1, MAX_BYTES))
    return map_arrow(fit.select("path", "reader", "content"), run, BLOCKS)


def only_tables(blocks: DataFrame) -> DataFrame:
    """Path, ord, name of the sheet, header row and data rows of each table."""
    cells = F.col("cells")
    return blocks.where("kind = 'table'").select("path", "ord", F.col("properties")["sheet_name"].alias("sheet_name"), F.get(cells, F.lit(0)).alias("headers"), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))).alias("rows"))


def only_images(blocks: DataFrame) -> DataFrame:
    """The images that a reader gives; the readers here give none, your own may."""
    return blocks.where("kind = 'image'")
