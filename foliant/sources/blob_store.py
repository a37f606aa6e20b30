"""Files kept by their content (S11): saved, listed and deleted by tasks, each under the hash of its bytes.

A file's place follows from its content and ending, so equal files are one, saving again changes nothing, and a
file that an attempt has left half written never stands under its final name. ``places`` says where files lie without touching them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.workers import ship
from .document_sink import DocumentWriter
from .files import extension


def place(content: Column, filename: Column) -> Column:
    """``ab/<hash>.<ending>``, by the SHA-256 of the bytes; without an ending where the name has none."""
    digest, ending = F.sha2(F.coalesce(content, F.lit(b"")), 256), extension(F.coalesce(filename, F.lit("")))
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.when(ending != "", F.concat(F.lit("."), ending)).otherwise(""))


class BlobWriter(DataSourceWriter):
    """Rows (place, content): saves each below the folder, or deletes it where content is null."""

    def __init__(self, folder: str, at: tuple[int, int]) -> None:
        self.folder, self.at = folder.rstrip("/"), at

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = DocumentWriter._store(self.folder)
        own = uuid.uuid4().hex
        for row in iterator:
            path, content = f"{folder}/{row[self.at[0]]}", row[self.at[1]]
            there = store.get_file_info(path).type != fs.FileType.NotFound
            if content is None and there:
                store.delete_file(path)
            elif content is not None and not there:
                store.create_dir(path.rpartition("/")[0])
                with store.open_output_stream(f"{path}.{own}") as out:
                    out.write(bytes(content))
                store.move(f"{path}.{own}", path)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None: ...

    def abort(self, messages: list) -> None: ...  # what is saved is whole, and saving it again changes nothing


class BlobStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema, overwrite: bool) -> BlobWriter:  # noqa: ANN001
        return BlobWriter(self.options["path"], (schema.names.index("place"), schema.names.index("content")))


def _write(rows: DataFrame, folder: str) -> None:
    spark: SparkSession = rows.sparkSession
    ship(spark)
    spark.dataSource.register(BlobStore)
    rows.write.format("blobs").mode("append").save(folder)


def save(files: DataFrame, folder: str, filename: str = "filename", content: str = "content") -> DataFrame:
    """Save every file; returns (filename, place, size) of each row."""
    placed = files.select(F.col(filename).alias("filename"), place(F.col(content), F.col(filename)).alias("place"), F.coalesce(content, F.lit(b"")).alias("content"))
    _write(placed.select("place", "content"), folder)
    return placed.select("filename", "place", F.octet_length("content").alias("size"))


def delete(places: DataFrame, folder: str) -> None:
    """Delete what lies at each ``place``; what isn't there is left alone."""
    _write(places.select("place", F.lit(None).cast("binary").alias("content")).where("place IS NOT NULL").distinct(), folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(place, size, content) of all that is kept; the content only where a later step asks for it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_extract("path", "([0-9a-f]{2}/[^/]+)$", 1).alias("place"), F.col("length").alias("size"), "content")
