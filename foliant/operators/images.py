"""Images (I1-I17 without the engines): measures as Columns over pixel arrays, filters as numpy kernels over Arrow batches, readings."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.correct import adjust_confidence
from ..functions.text import let, py_strip
from ..functions.workers import map_arrow
from .blocks import mean_confidence, merge_maps

#: Pixels that one call of a kernel takes at once (a single image may be larger).
STACK_PIXELS = 1 << 22


def upscale_plan(width: Column, height: Column, target: int = 300) -> Column:
    """The long side is 11 inches; below the target resolution both sides grow, truncated."""
    dpi = F.greatest(width, height) / 11.0
    scale = F.when(dpi < target, target / dpi).otherwise(1.0)
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def deviation(pixels: Column) -> Column:
    """The standard deviation of an array, within its row."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    return let(mean(pixels), lambda m: F.sqrt(mean(F.transform(pixels, lambda x: (x - m) * (x - m)))))


def median(pixels: Column) -> Column:
    """The middle of an array, or the mean of its two middles, within its row."""
    half = lambda xs, more: F.get(xs, F.floor((F.size(xs) - 1 + more) / 2).cast("int"))
    return let(F.array_sort(pixels), lambda xs: (half(xs, 0) + half(xs, 1)) / 2.0)


def contrast_factor(deviation: Column) -> Column:
    """I7."""
    return F.when(deviation < 30, F.least(F.lit(2.5), 30 / F.greatest(deviation, F.lit(1.0)))).otherwise(1.0)


def image_kind(width: Column, height: Column, colours: Column, rgb: Column) -> Column:
    """I12."""
    aspect = width / height
    return (
        F.when((aspect > 3) | (aspect < 0.33), "graphique")
        .when((aspect > 0.8) & (aspect < 1.2) & rgb & (colours > 0) & (colours < 50), "diagramme")
        .otherwise("image")
    )


def otsu_thresholds(batch: list[np.ndarray]) -> np.ndarray:
    """I8: for each image the grey level that splits its histogram with the largest variance between classes; all at once."""
    if not batch:
        return np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(batch)), [x.size for x in batch])
    grey = np.concatenate([np.asarray(x, np.uint8).ravel() for x in batch])
    counts = np.bincount(owner * 256 + grey, minlength=256 * len(batch)).reshape(-1, 256).astype(float)
    low, level = counts.cumsum(1), (counts * np.arange(256)).cumsum(1)
    high = low[:, -1:] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (level / low - (level[:, -1:] - level) / high) ** 2
    return np.nan_to_num(between).argmax(1).astype(np.int32)


def otsu_threshold(pixels: np.ndarray) -> int:
    return int(otsu_thresholds([pixels])[0])


# The kernels below take one grey image (height x width) or a stack of images of one shape, and give the same.


def binarize(pixels: np.ndarray, method: str = "otsu") -> np.ndarray:
    """Pixels above the threshold are white."""
    stack = pixels.reshape(-1, *pixels.shape[-2:])
    cuts = otsu_thresholds(list(stack)) if method == "otsu" else np.median(stack, axis=(1, 2))
    return np.where(stack > cuts[:, None, None], 255, 0).astype(np.uint8).reshape(pixels.shape)


def _around(pixels: np.ndarray) -> np.ndarray:
    """The nine neighbours of every pixel, row by row; the edge repeats outwards."""
    h, w = pixels.shape[-2:]
    wide = np.pad(pixels, [(0, 0)] * (pixels.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    return np.stack([wide[..., y : y + h, x : x + w] for y in range(3) for x in range(3)])


def _weighted(pixels: np.ndarray, centre: int, side: int, divisor: int) -> np.ndarray:
    """A 3 x 3 filter, rounded; the outermost pixels stay as they are."""
    near, out = _around(pixels).astype(np.int32), pixels.copy()
    made = (centre * near[4] + side * (near.sum(0) - near[4]) + divisor // 2) // divisor
    out[..., 1:-1, 1:-1] = np.clip(made, 0, 255)[..., 1:-1, 1:-1]
    return out


def median3(pixels: np.ndarray) -> np.ndarray:
    return np.sort(_around(pixels), axis=0)[4]


def contrast(pixels: np.ndarray, factor) -> np.ndarray:
    """Distances from each image's rounded mean times ``factor``: a number, or one for each image."""
    mean = np.floor(pixels.mean(axis=(-2, -1), keepdims=True) + 0.5)
    return np.clip(mean + factor * (pixels.astype(float) - mean), 0, 255).astype(np.uint8)


def adaptive_contrast(pixels: np.ndarray) -> np.ndarray:
    """I7, applied."""
    spread = pixels.std(axis=(-2, -1), keepdims=True)
    return contrast(pixels, np.where(spread < 30, np.minimum(2.5, 30 / np.maximum(spread, 1.0)), 1.0))


def sharpen(pixels: np.ndarray) -> np.ndarray:
    return _weighted(pixels, 32, -2, 16)


def enhance_edges(pixels: np.ndarray) -> np.ndarray:
    return _weighted(pixels, 10, -1, 2)


def denoise(pixels: np.ndarray) -> np.ndarray:
    """Median, then a box blur of radius one half, along rows and then along columns."""
    near = _around(median3(pixels)).astype(np.int32)
    rows = (near[3] + 2 * near[4] + near[5] + 2) // 4
    near = _around(rows)
    return ((near[1] + 2 * near[4] + near[7] + 2) // 4).astype(np.uint8)


def morphology(pixels: np.ndarray) -> np.ndarray:
    """Opening, then closing, of the bits at or above 128, with a cross."""
    cross = [1, 3, 4, 5, 7]
    bits = (pixels >= 128).astype(np.uint8)
    erode, dilate = (lambda b: _around(b)[cross].min(0)), (lambda b: _around(b)[cross].max(0))
    return erode(dilate(dilate(erode(bits)))) * np.uint8(255)


def rotate(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """The eight orientation tags; others leave the image."""
    turn, flip = (lambda p, k: np.rot90(p, k, (-2, -1))), (lambda p: np.swapaxes(p, -1, -2))
    turns = {2: lambda p: np.flip(p, -1), 3: lambda p: turn(p, 2), 4: lambda p: np.flip(p, -2), 5: flip, 6: lambda p: turn(p, -1), 7: lambda p: flip(turn(p, 2)), 8: lambda p: turn(p, 1)}
    return turns.get(orientation, lambda p: p)(pixels)


def _lanczos(old: int, new: int) -> np.ndarray:
    x = np.arange(old) + 0.5 - (np.arange(new)[:, None] + 0.5) * old / new
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(1, keepdims=True)


def upscale(pixels: np.ndarray, target: float) -> np.ndarray:
    """I5, applied: a Lanczos window of three pixels, where the image is below the target resolution."""
    h, w = pixels.shape[-2:]
    if max(h, w) / 11 >= target:
        return pixels
    scale = target / (max(h, w) / 11)
    made = _lanczos(h, int(h * scale)) @ pixels.astype(float) @ _lanczos(w, int(w * scale)).T
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)


def preprocess(pixels: np.ndarray, method: str | None = "advanced", orientation: int | None = 1, target: float = 0) -> np.ndarray:
    """I1-I4 on grey pixels: basic, advanced or aggressive; unknown methods are advanced. A target of 0 never resamples."""
    if method == "basic":
        return median3(sharpen(contrast(pixels, 2.0)))
    aggressive = method == "aggressive"
    upright = rotate(upscale(pixels, target * (2 if aggressive else 1)), orientation)
    if aggressive:
        return enhance_edges(sharpen(morphology(binarize(contrast(upright, 3.0)))))
    return sharpen(denoise(binarize(adaptive_contrast(upright))))


def filtered(df: DataFrame, kernel: Callable[..., np.ndarray], by: tuple[str, ...] = (), pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """df with ``kernel(stack, *values of by)`` applied to its grey images: arrays of width times height numbers, row by row.

    Images of an Arrow batch that agree in shape and ``by`` go through the kernel in stacks of a bounded
    number of pixels; there is no shuffle. I14: an image whose pixels are null, out of 0 to 255 or don't fit its sides stays as it is.
    """
    names = df.columns
    at = [names.index(c) for c in (pixels, width, height, *by)]
    kinds = [df.schema[c].dataType.simpleString() for c in (width, height)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at[0])
            ends, grey = lists.offsets.to_numpy(), lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            out = [grey[a:b] if ok.as_py() else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid(), strict=True)]
            keys = list(zip(*(batch.column(i).to_pylist() for i in at[1:]), strict=True))
            sides, alike = [k[:2] for k in keys], defaultdict(list)
            for i, (w, h, *values) in enumerate(keys):
                if out[i] is not None and w and h and w > 0 and len(out[i]) == w * h and out[i].min() >= 0 and out[i].max() <= 255:
                    alike[w, h, *values].append(i)
            for (w, h, *values), rows in alike.items():
                step = max(1, STACK_PIXELS // (w * h))
                for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                    made = kernel(np.stack([out[i] for i in part]).reshape(-1, h, w).astype(np.uint8), *values)
                    for i, image in zip(part, made, strict=True):
                        out[i], sides[i] = image.ravel(), (image.shape[1], image.shape[0])
            columns = list(batch.columns)
            flat = np.concatenate([np.empty(0, np.int32), *(x for x in out if x is not None)]).astype(np.int32)
            starts = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in out]))).astype(np.int32)
            broken = pa.array(np.array([x is None for x in out], bool))
            columns[at[0]] = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat, mask=flat < 0), mask=broken)
            for i, side in zip(at[1:3], zip(*sides, strict=True) if sides else ((), ()), strict=True):
                columns[i] = pa.array(side, batch.schema.field(i).type)
            yield pa.record_batch(columns, names=names)

    assert all(k in ("int", "bigint") for k in kinds), "sides are whole numbers"
    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == pixels else f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, fields)


def image_metadata(known: Column, width: Column, height: Column, form: Column, mode: Column, size: Column, kind: Column) -> Column:
    """What is known of an image (a map, or null), with its measures; new entries win."""
    made = {"width": width, "height": height, "format": form, "mode": mode, "size_bytes": F.coalesce(size, F.lit(0)), "content_type": kind, "processed": F.lit("true")}
    entries = F.create_map(*(x for k, v in made.items() for x in (F.lit(k), v.cast("string"))))
    return merge_maps(F.coalesce(known, F.create_map().cast("map<string,string>")), entries)


def image_outputs(images: DataFrame, keep: list[str], method: str = "ocr") -> DataFrame:
    """In one pass, each image and, where its reading isn't blank, a text at its place.

    images: the columns to ``keep`` (ids, page, order), metadata, width, height, format, ocr_text, ocr_confidence. Adds kind, text, method,
    confidence; method and confidence stay null where nothing was read.
    """
    read, entry = F.coalesce(py_strip(F.col("ocr_text")), F.lit("")), lambda *xs: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
    known = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    added = entry("source", "image_ocr", "image_width", F.col("width").cast("string"), "image_height", F.col("height").cast("string"), "image_format", F.col("format"))
    made = F.when(F.coalesce(F.col("ocr_text"), F.lit("")) != "", F.struct(F.lit(method).alias("m"), F.col("ocr_confidence").cast("double").alias("c")))
    block = lambda kind, words, data: F.struct(F.lit(kind).alias("kind"), words.alias("text"), data.alias("metadata"), made["m"].alias("method"), made["c"].alias("confidence"))
    both = F.array(block("image", F.col("ocr_text"), known), block("text", read, merge_maps(known, added)))
    return images.select(*keep, F.explode(F.when(read != "", both).otherwise(F.slice(both, 1, 1))).alias("b")).select(*keep, "b.*")


def best_reading(tries: DataFrame, by: str, corrected: Callable[[Column], Column]) -> DataFrame:
    """Of an image's attempts the best one that read anything, corrected, with its adjusted confidence; else an empty text and 0.

    tries: by, attempt, text, confidences (one for each word, -1 for none) from any engine. A negative attempt is the plain image,
    which counts only where all others are blank. Attempts are combined before the shuffle.
    """
    each = tries.select(by, "attempt", py_strip(F.coalesce("text", F.lit(""))).alias("text"), mean_confidence(F.coalesce("confidences", F.array().cast("array<int>"))).alias("confidence"))
    order = F.when(F.col("text") != "", F.struct(F.col("attempt") >= 0, F.col("confidence"), F.length("text"), -F.col("attempt")))
    best = each.groupBy(by).agg(F.max_by(F.struct("attempt", "text", "confidence"), order).alias("b")).select(by, "b.*")
    text = corrected(F.col("text"))
    sure = F.when(F.col("text").isNull(), 0.0).otherwise(adjust_confidence(F.col("text"), text, F.col("confidence")))
    return best.select(by, "attempt", F.coalesce(text, F.lit("")).alias("text"), sure.alias("confidence"))
