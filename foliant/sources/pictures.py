"""Encoded pictures as pixels (S8 without recognition, I2-I4, I12): Spark's own image format, then grey values and colours in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import map_arrow

#: Weights of red, green and blue in a grey value, in 65,536ths (fixed values).
RED, GREEN, BLUE, HALF = 19_595, 38_470, 7_471, 32_768
#: Colours are counted up to this many: more are no diagram.
MOST_COLOURS = 50
MODES = {1: "L", 3: "RGB", 4: "RGBA"}
#: Pixels whose colours are counted at once.
CHUNK = 1 << 16


def colours(pixels: np.ndarray, most: int = MOST_COLOURS) -> int:
    """How many different rows pixels has, ``most`` at most; reading ends there."""
    seen = np.empty(0, np.uint32)
    packed = np.zeros(len(pixels), np.uint32)
    for k in range(pixels.shape[1]):
        packed |= pixels[:, k].astype(np.uint32) << np.uint32(8 * k)
    for at in range(0, len(packed), CHUNK):
        seen = np.union1d(seen, packed[at : at + CHUNK])
        if len(seen) >= most:
            return most
    return len(seen)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Rows of blue, green and red (and opacity, which doesn't count) as grey values; single values stay."""
    if pixels.shape[1] == 1:
        return pixels[:, 0].astype(np.int32)
    b, g, r = (pixels[:, k].astype(np.int64) for k in range(3))
    return ((r * RED + g * GREEN + b * BLUE + HALF) >> 16).astype(np.int32)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # one picture's pixels at a time
            row = batch.slice(i, 1)
            w, h, n = (row.column(c)[0].as_py() for c in ("width", "height", "channels"))
            data = row.column("data")[0]
            fits = data.is_valid and n in MODES and w and h and w > 0 and h > 0 and len(data.as_buffer()) == w * h * n
            pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n) if fits else None
            values = pa.array([grey(pixels)], pa.list_(pa.int32())) if fits else pa.array([None], pa.list_(pa.int32()))
            made = [pa.array([MODES[n] if fits else None], pa.string()), pa.array([colours(pixels) if fits and n > 1 else None], pa.int32()), values]
            kept = [row.column(k) for k in range(row.num_columns) if row.schema.names[k] != "data"]
            yield pa.record_batch([*kept, *made], [*(x for x in row.schema.names if x != "data"), "mode", "colours", "pixels"])


def unpack(raw: DataFrame) -> DataFrame:
    """raw (width, height, channels, data: bytes of blue, green and red, row by row, and any other columns) with mode, colours and grey pixels instead of data.

    What has no data, or not as many bytes as its sides say, has no mode, colours or pixels.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields if f.name != "data")
    return map_arrow(raw, _unpack, f"{schema}, mode string, colours int, pixels array<int>")


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Every picture below a folder, decoded in the JVM: path, width, height, mode, colours, grey pixels; a broken file has only its path."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*")
    side = lambda c: F.when(F.col("nChannels") > 0, F.col(c)).alias(c)
    return unpack(found.select(F.col("origin").alias("path"), side("width"), side("height"), F.col("nChannels").alias("channels"), F.when(F.col("nChannels") > 0, F.col("data")).alias("data")))
