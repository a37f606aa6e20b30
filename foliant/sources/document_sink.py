"""Rendered documents as files (S15): ``df.write.format("documents").mode("overwrite").save(folder)`` writes one ``<stem>.md`` a row.

df has the columns ``stem`` and ``text``. Tasks write into a folder beside the target, each file under a name of its own
that becomes the final one once it is whole, so an attempt that runs twice leaves the same files. When all tasks are done that folder takes the
target's place in one move; if one fails, it goes, and the target stays as it was. ``with_stems`` makes stems from file names and numbers those that repeat.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.workers import ship


class Written(WriterCommitMessage):
    def __init__(self, files: int) -> None:
        self.files = files


class DocumentWriter(DataSourceWriter):
    def __init__(self, folder: str, at: tuple[int, int], ending: str) -> None:
        self.folder, self.at, self.ending = folder.rstrip("/"), at, ending
        self.staging = f"{self.folder}.staging-{uuid.uuid4().hex}"

    @staticmethod
    def _store(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = self._store(self.staging)
        store.create_dir(folder)
        files, own = 0, uuid.uuid4().hex
        for row in iterator:
            stem, text = row[self.at[0]], row[self.at[1]]
            if not stem or "/" in stem:
                raise ValueError(f"a stem names a file: {stem!r}")
            with store.open_output_stream(f"{folder}/.{own}") as out:
                out.write((text or "").encode())
            store.move(f"{folder}/.{own}", f"{folder}/{stem}{self.ending}")
            files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._store(self.staging)
        _, target = self._store(self.folder)
        store.create_dir(folder)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_dir(target)
        store.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._store(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class DocumentSink(DataSource):
    """S15; the option ``ending`` is ".md" unless given."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:  # noqa: ANN001
        if not overwrite:
            raise ValueError("documents are written as a whole: use mode('overwrite')")
        return DocumentWriter(self.options["path"], (schema.names.index("stem"), schema.names.index("text")), self.options.get("ending", ".md"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(DocumentSink)


def stem(filename: Column) -> Column:
    """What stands before the last dot; a name without one as it is, a missing one ``document``."""
    own = F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), "[/\\\\~]", "_"), "(?<=.)\\.[^.]*$", "")
    return F.when(own == "", "document").otherwise(own)


def with_stems(rendered: DataFrame, filename: str, doc: str, text: str = "markdown") -> DataFrame:
    """(stem, text): equal stems are told apart by a number behind a tilde, in the order of the documents' ids; rows that are equal are one document.

    Only stems, ids and hashes are brought together to be numbered, texts are not.
    """
    named = rendered.select(stem(F.col(filename)).alias("stem"), F.col(doc).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).dropDuplicates(["stem", "doc", "h"])
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("doc", "h"))
    again = named.select("stem", "doc", "h").withColumn("nth", nth).where("nth > 1").select(F.struct("stem", "doc", "h").alias("k"), "nth")
    numbered = named.withColumn("k", F.struct("stem", "doc", "h")).join(again, "k", "left")
    return numbered.select(F.when(F.col("nth").isNotNull(), F.concat_ws("~", "stem", "nth")).otherwise(F.col("stem")).alias("stem"), "text")


def save_documents(rendered: DataFrame, folder: str, filename: str, doc: str, text: str = "markdown") -> None:
    """Write each document's Markdown as ``<stem>.md``."""
    register(rendered.sparkSession)
    with_stems(rendered, filename, doc, text).write.format("documents").mode("overwrite").save(folder)
