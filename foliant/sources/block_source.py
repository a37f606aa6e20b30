"""Blocks of files as a Spark data source (S2, S9, S11, X1): ``spark.read.format("blocks").load(folder)``.

The driver plans from sums of bytes: it walks the folders, adds up each one's bytes by 1,024 slots of a hash of the file names,
and packs folders, or runs of slots of a crowded one, into partitions of about ``partitionBytes``. No list of names
is kept or sent; a task lists its own folders and takes the names of its slots. Filters on path, length and reader are
pushed: folders that a path rules out are not entered, and files that are ruled out are neither counted nor opened. Files that
are empty, too large, of no known reader or broken give one row with their error.

Options: ``partitionBytes`` (128 MB), and ``parse`` ("false" gives one row a file without opening it). A file format of
your own (X1) is a subclass with its own ``parsers``, by the name of the reader, and ``readers``, from extension to reader. A Python data source has no column
pruning in Spark: columns are dropped after the scan, so leave out parsing where only names are asked for.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from ..functions.workers import ship
from .files import BLOCKS, MAX_BYTES, PARSERS, TYPES

SLOTS, PARTITION_BYTES = 1024, 128 << 20
#: Bytes that a file adds to its own in the plan: what opening it costs.
OPEN_BYTES = 1 << 16
SCHEMA = f"{BLOCKS}, length long, reader string"
_ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<array<string>>": pa.list_(pa.list_(pa.string())), "map<string,string>": pa.map_(pa.string(), pa.string()),
}
_FIELDS = [x.split(" ") for x in SCHEMA.split(", ")]
_TESTS: dict[type, Callable] = {
    EqualTo: lambda own, f: own == f.value, GreaterThan: lambda own, f: own > f.value, GreaterThanOrEqual: lambda own, f: own >= f.value, LessThan: lambda own, f: own < f.value,
    LessThanOrEqual: lambda own, f: own <= f.value, In: lambda own, f: own in f.value, StringStartsWith: lambda own, f: own.startswith(f.value), StringEndsWith: lambda own, f: own.endswith(f.value), StringContains: lambda own, f: f.value in own,
}


def default_readers() -> dict[str, str]:
    """Extension to reader, as ``files.reader_of`` has it."""
    kind = lambda mime: "image" if mime.startswith("image/") else "pdf" if mime.endswith("/pdf") else "excel" if "sheet" in mime or "excel" in mime else "word"
    return {ext: kind(mime) for ext, mime in TYPES.items()}


class Unit(InputPartition):
    """(folder, first slot, slot after the last) of each folder that a task reads."""

    def __init__(self, parts: list[tuple[str, int, int]]) -> None:
        self.parts = parts


class BlockReader(DataSourceReader):
    def __init__(self, options: dict, parsers: dict, readers: dict) -> None:
        self.folder, self.parse = options["path"], options.get("parse", "true").lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.parsers, self.readers, self.filters = parsers, readers, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("length",), ("reader",)):
                self.filters.append(f)
            else:
                yield f

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def _name(self, store: fs.FileSystem, path: str) -> str:
        return f"file:{path}" if isinstance(store, fs.LocalFileSystem) else f"{self.folder.split('://')[0]}://{path}"

    def _list(self, store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
        """(path, whether a folder, bytes) of what a folder holds; local ones are walked without a list."""
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as found:
                for x in found:
                    yield x.path, x.is_dir(), 0 if x.is_dir() else x.stat().st_size
        else:
            for x in store.get_file_info(fs.FileSelector(folder)):
                yield x.path, x.type == fs.FileType.Directory, x.size or 0

    def _reader(self, path: str) -> str | None:
        return self.readers.get(path.rpartition("/")[2].rpartition(".")[2].lower())

    def _wanted(self, path: str, length: int) -> bool:
        own = {"path": path, "length": length, "reader": self._reader(path)}
        return all(own[f.attribute[0]] is not None and _TESTS[type(f)](own[f.attribute[0]], f) for f in self.filters)

    def _inside(self, path: str) -> bool:
        """Whether a folder may hold a path that is asked for."""
        asked = [[f.value] if type(f) in (EqualTo, StringStartsWith) else f.value for f in self.filters if f.attribute == ("path",) and type(f) in (EqualTo, In, StringStartsWith)]
        fits = lambda value: value.startswith(f"{path}/") or f"{path}/".startswith(value)
        return all(any(map(fits, values)) for values in asked)

    def partitions(self) -> list[Unit]:
        store, top = self._store()
        folders, out, held, size = [top], [], [], 0

        def add(part: tuple[str, int, int], weight: int) -> None:
            nonlocal held, size
            if held and size + weight > self.most:
                out.append(Unit(held))
                held, size = [], 0
            held, size = [*held, part], size + weight

        while folders:
            folder = folders.pop()
            slots = [0] * SLOTS
            for path, inner, length in self._list(store, folder):
                name = self._name(store, path)
                if inner:
                    folders += [path] if self._inside(name) else []
                elif self._wanted(name, length):
                    slots[zlib.crc32(path.rpartition("/")[2].encode()) % SLOTS] += OPEN_BYTES + (length if self.parse else 0)
            if sum(slots) <= self.most:
                if any(slots):
                    add((folder, 0, SLOTS), sum(slots))
                continue
            first, run = 0, 0
            for slot, weight in enumerate(slots):
                if run and run + weight > self.most:
                    add((folder, first, slot), run)
                    first, run = slot, 0
                run += weight
            add((folder, first, SLOTS), run)
        return [*out, Unit(held)] if held else out or [Unit([])]

    def _blocks(self, store: fs.FileSystem, path: str, name: str, length: int) -> Iterator[dict]:
        reader = self._reader(name)
        about = {"path": name, "length": length, "reader": reader}
        reason = "empty" if length <= 0 else "too large" if length > MAX_BYTES else "not supported" if reader not in self.parsers else None
        if not self.parse:
            yield {**about, "kind": "file"}
        elif reason:
            yield {**about, "kind": "error", "error": reason}
        else:
            try:
                with store.open_input_stream(path) as data:
                    yield from [{**about, **block} for block in self.parsers[reader](data.read())]
            except Exception as why:  # noqa: BLE001  one bad file must not end the job
                yield {**about, "kind": "error", "error": f"{type(why).__name__}: {why}"}

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        batch = lambda rows: pa.record_batch([pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])
        held: list[dict] = []
        for folder, first, last in partition.parts:
            for path, inner, length in self._list(store, folder):
                name = self._name(store, path)
                if not inner and first <= zlib.crc32(path.rpartition("/")[2].encode()) % SLOTS < last and self._wanted(name, length):
                    held += self._blocks(store, path, name, length)
                    if len(held) >= 1024 or length > 1 << 20:  # a large file is a batch of its own
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)


class BlockSource(DataSource):
    """One schema for all formats; subclass it for more."""

    parsers: dict[str, Callable[[bytes], Iterator[dict]]] = PARSERS
    readers: dict[str, str] = default_readers()

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:  # noqa: ANN001
        return BlockReader(self.options, self.parsers, self.readers)


def register(spark: SparkSession, source: type[DataSource] = BlockSource) -> None:
    """Make the source known to a session, with pushed filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
