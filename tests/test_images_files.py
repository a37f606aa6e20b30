"""Image kernels against loops over pixels; workbooks and documents with names, titles and properties; progress of a stream."""

import io
import time
import zipfile

import numpy as np
import pytest
from foliant.operators import images
from foliant.sources import files
from foliant.streaming import ingest
from pyspark.sql import functions as F


def around(p, y, x):
    h, w = len(p), len(p[0])
    return [[p[min(max(y + dy, 0), h - 1)][min(max(x + dx, 0), w - 1)] for dx in (-1, 0, 1)] for dy in (-1, 0, 1)]


def each(p, f):
    return [[f(y, x, around(p, y, x)) for x in range(len(p[0]))] for y in range(len(p))]


def weighted(p, centre, side, divisor):
    h, w = len(p), len(p[0])

    def one(y, x, n):
        if y in (0, h - 1) or x in (0, w - 1):
            return p[y][x]
        rest = sum(map(sum, n)) - n[1][1]
        return min(255, max(0, (centre * n[1][1] + side * rest + divisor // 2) // divisor))

    return each(p, one)


def stretched(p, factor):
    flat = [v for r in p for v in r]
    mean = int(sum(flat) / len(flat) + 0.5)
    return [[int(min(255, max(0, mean + factor * (v - mean)))) for v in r] for r in p]


def median(p):
    return each(p, lambda y, x, n: sorted(sum(n, []))[4])


def otsu(p):
    flat = [v for r in p for v in r]
    best, cut = 0.0, 0
    for t in range(256):
        low, high = [v for v in flat if v <= t], [v for v in flat if v > t]
        if low and high:
            found = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if found > best * (1 + 1e-12):
                best, cut = found, t
    return [[255 if v > cut else 0 for v in r] for r in p]


def cross(p, f):
    return each(p, lambda y, x, n: f(n[0][1], n[1][0], n[1][1], n[1][2], n[2][1]))


def plainly(p, method):
    if method == "basic":
        return median(weighted(stretched(p, 2), 32, -2, 16))
    if method == "aggressive":
        bits = [[255 if v >= 128 else 0 for v in r] for r in otsu(stretched(p, 3))]
        closed = cross(cross(cross(cross(bits, min), max), max), min)
        return weighted(weighted(closed, 32, -2, 16), 10, -1, 2)
    flat = [v for r in p for v in r]
    spread = (sum((v - sum(flat) / len(flat)) ** 2 for v in flat) / len(flat)) ** 0.5
    soft = median(otsu(stretched(p, min(2.5, 30 / max(spread, 1)) if spread < 30 else 1)))
    rows = each(soft, lambda y, x, n: (n[1][0] + 2 * n[1][1] + n[1][2] + 2) // 4)
    return weighted(each(rows, lambda y, x, n: (n[0][1] + 2 * n[1][1] + n[2][1] + 2) // 4), 32, -2, 16)


@pytest.mark.parametrize("method", ["basic", "advanced", "aggressive"])
@pytest.mark.parametrize("shape", [(7, 9), (3, 3), (1, 4), (1, 1)])
def test_methods_equal_loops_over_pixels(method, shape):
    rng = np.random.default_rng(5)
    stack = np.stack([rng.integers(0, 256, shape), rng.integers(100, 140, shape), np.full(shape, 77)]).astype(np.uint8)
    made = images.preprocess(stack, method)
    for image, got in zip(stack, made, strict=True):
        assert got.tolist() == plainly(image.tolist(), method) == images.preprocess(image, method).tolist()


def test_rotation_follows_the_tags():
    p = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    assert all(images.rotate(p, k).tolist() == v for k, v in want.items()) and images.rotate(p, 9) is p and images.rotate(p, None) is p


def test_upscaling_keeps_flat_images_and_sizes():
    assert images.upscale(np.full((4, 11), 9, np.uint8), 1) .shape == (4, 11)
    big = images.upscale(np.full((2, 4, 11), 9, np.uint8), 2.5)
    assert big.shape == (2, 10, 27) and (big == 9).all()
    ramp = images.upscale(np.tile(np.arange(0, 220, 20, dtype=np.uint8), (3, 1)), 2)
    assert (np.diff(ramp[1, 4:-4].astype(int)) >= 0).all()


def test_filtered_keeps_what_it_cannot_read(spark):
    rows = [
        (1, [0, 50, 100, 250], 2, 2, "basic", "x"), (2, [1, 2, 3], 3, 1, None, None), (3, [1, 2, 3], 2, 2, "basic", "short"), (4, None, 2, 2, "basic", "null"),
        (5, [300, 1], 2, 1, "basic", "range"), (6, [None, 1], 2, 1, "basic", "hole"), (7, [], 0, 0, "basic", "empty"), (8, [1], None, 1, "basic", "side"), (1, [0, 50, 100, 250], 2, 2, "basic", "x"),
    ]
    df = spark.createDataFrame(rows, "id int, px array<int>, w int, h int, method string, pixels string").repartition(3)
    got = sorted((r["id"], r["px"], r["w"], r["h"], r["pixels"]) for r in images.filtered(df, images.preprocess, ("method",), "px", "w", "h").collect())
    same = {r[0]: r for r in rows}
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5, 6, 7, 8] and got[0] == got[1]
    assert got[0][1] == sum(plainly([[0, 50], [100, 250]], "basic"), []) and got[2][1] == sum(plainly([[1, 2, 3]], "advanced"), [])
    assert all((g[1], g[2], g[3], g[4]) == (*same[g[0]][1:4], same[g[0]][5]) for g in got[3:])
    wide = images.filtered(df.where("id = 2"), lambda p: images.rotate(p, 6), (), "px", "w", "h").first()
    assert (wide["w"], wide["h"], wide["px"]) == (1, 3, [1, 2, 3])
    assert images.filtered(df.limit(0), images.denoise, (), "px", "w", "h").count() == 0


def test_outputs_of_images_without_metadata(spark):
    df = spark.createDataFrame([(1, None, 0.5, None), (2, " \n", 0.5, {"a": "b"}), (3, " read ", 0.5, {"source": "file"})], "id int, ocr_text string, ocr_confidence double, metadata map<string,string>")
    rows = images.image_outputs(df.withColumns({"width": F.lit(2), "height": F.lit(3), "format": F.lit(None).cast("string")}), ["id"]).orderBy("id", "kind").collect()
    assert [(r["id"], r["kind"], r["text"], r["method"], r["confidence"]) for r in rows] == [(1, "image", None, None, None), (2, "image", " \n", "ocr", 0.5), (3, "image", " read ", "ocr", 0.5), (3, "text", "read", "ocr", 0.5)]
    assert rows[3]["metadata"] == {"source": "image_ocr", "image_width": "2", "image_height": "3", "image_format": None} and rows[0]["metadata"] == {}


def test_best_reading_takes_the_plain_image_last(spark):
    tries = [(1, -1, "plain", [99]), (1, 0, " low ", [10, -1]), (1, 1, None, [90]), (2, -1, "plain", [40]), (2, 0, " ", [90]), (3, 0, "", None), (4, 3, "ab", [50]), (4, 1, "cd", [50]), (4, 0, "e", [50])]
    df = spark.createDataFrame(tries, "id int, attempt int, text string, confidences array<int>")
    got = {r["id"]: (r["attempt"], r["text"], round(r["confidence"], 4)) for r in images.best_reading(df, "id", F.upper).collect()}
    assert got == {1: (0, "LOW", 0.105), 2: (-1, "PLAIN", 0.42), 3: (None, "", 0.0), 4: (1, "CD", 0.525)}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_sheets_keep_order_and_names(spark, tmp_path):
    cell = lambda *vs: "".join(f"<c><v>{v}</v></c>" for v in vs)
    sheet = lambda *rows: '<worksheet xmlns="x"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>"
    book = '<workbook xmlns="x" xmlns:r="r"><sheets><sheet name="Second" r:id="a"/><sheet name="Blank" r:id="b"/><sheet name="First" r:id="c"/></sheets></workbook>'
    links = '<Relationships xmlns="y"><Relationship Id="a" Target="worksheets/sheet2.xml"/><Relationship Id="b" Target="worksheets/sheet3.xml"/><Relationship Id="c" Target="/xl/worksheets/sheet1.xml"/></Relationships>'
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/worksheets/sheet1.xml": sheet(cell("h")), "xl/worksheets/sheet2.xml": sheet(cell(" a ", "b"), cell("", " "), cell(1, 2)), "xl/worksheets/sheet3.xml": sheet(cell(""))}
    core = '<cp:coreProperties xmlns:cp="p" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator><cp:revision>3</cp:revision></cp:coreProperties>'
    para = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = f'<w:document xmlns:w="w"><w:body>{para("intro")}{para("One", "Heading1")}{para("text")}{para("Two", "HeadingX")}{para("more")}<w:tbl/></w:body></w:document>'
    (tmp_path / "b.xlsx").write_bytes(zipped(parts))
    (tmp_path / "d.docx").write_bytes(zipped({"word/document.xml": body, "docProps/core.xml": core}))
    (tmp_path / "no.docx").write_bytes(b"")
    blocks = files.extract(files.read_files(spark, str(tmp_path), empty=False))
    assert files.read_files(spark, str(tmp_path), empty=False).count() == 2 and files.read_files(spark, str(tmp_path)).count() == 3
    tables = [tuple(r)[1:] for r in files.only_tables(blocks).orderBy("ord").collect()]
    assert tables == [(0, "Second", ["a", "b"], [["1", "2"]]), (1, "First", ["h"], [])]
    texts = blocks.where("kind = 'text'").orderBy("ord").collect()
    assert [(r["text"], r["level"], r["title"]) for r in texts] == [("intro", None, None), ("One", 1, "One"), ("text", None, "One"), ("Two", 1, "Two"), ("more", None, "Two")]
    assert blocks.where("kind = 'properties'").first()["properties"] == {"title": "T", "author": "A"}
    assert files.only_images(blocks).count() == 0


def test_progress_is_told_and_its_errors_end_nothing(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    told = []

    def tell(message, rows):
        told.append((message, rows))
        raise ValueError("ignored")

    listener = ingest.Progress(tell)
    spark.streams.addListener(listener)
    try:
        ingest.ingest(ingest.watch(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "log"), "id").awaitTermination()
        until = time.time() + 30
        while time.time() < until and not (told and told[-1][0] == "finished"):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == ("started", 0) and told[-1] == ("finished", 5) and ingest.latest(spark, str(tmp_path / "out"), "id").count() == 5
