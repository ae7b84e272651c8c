"""Pixel steps against slow restatements, and files in and out."""

import hashlib
import re
import struct
import zlib
from dataclasses import replace
from datetime import datetime
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlake.params import DetectionParams, PageParams, TileParams
from regionlake.operators import lifecycle, regions as region_ops
from regionlake.raster import features, jobs
from regionlake.raster import kernels as k
from regionlake.sources import exports, images, tables

NATIVE = DetectionParams(target_dpi=72.0, source_dpi=72.0)


def page_rows(*arrays):
    return [(i, a.shape[1], a.shape[0], 1, bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(arrays)]


PAGES = "page_no int, width int, height int, channels int, data binary"


def slow_components(ink, diagonal=True):
    seen, out = np.zeros_like(ink), []
    h, w = ink.shape
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (-1, -1), (1, -1), (-1, 1)] if diagonal else [])
    for y in range(h):
        for x in range(w):
            if ink[y, x] and not seen[y, x]:
                stack, px = [(x, y)], []
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < w and 0 <= b < h and ink[b, a] and not seen[b, a]:
                        seen[b, a] = True
                        px.append((a, b))
                        stack += [(a + i, b + j) for i, j in steps]
                xs, ys = [p[0] for p in px], [p[1] for p in px]
                out.append((min(xs), min(ys), max(xs), max(ys), len(px)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_components(seed):
    rng = np.random.default_rng(seed)
    ink = rng.random(rng.integers(1, 25, 2)) < 0.45
    for diagonal in (True, False):
        assert [tuple(r) for r in k.components(ink, 1, diagonal).tolist()] == slow_components(ink, diagonal)


def test_median_mean_threshold():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (17, 23)).astype(np.uint8)
    m = k.median3(g)
    assert all(m[y, x] == np.median(g[y - 1:y + 2, x - 1:x + 2]) for y in range(1, 16) for x in range(1, 22))
    assert (m[0] == g[0]).all()
    for a in (g, g.astype(float) + 0.25):
        local = np.array([[a[max(0, y - 7):y + 8, max(0, x - 7):x + 8].mean() for x in range(23)] for y in range(17)])
        assert (k.binarize(a, "adaptive") == (a < local - 10)).all()
    flat = np.full((9, 9), 100, np.uint8)
    assert k.otsu(flat) == 128 and (k.equalize(flat) == 100).all()
    two = np.where(rng.random((20, 20)) < 0.3, 40, 200).astype(np.uint8)
    assert 40 <= k.otsu(two) < 200 and k.is_blank(np.full((50, 50), 255, np.uint8)) and not k.is_blank(two)
    assert k.resize(g, 46, 34).shape == (34, 46) and abs(k.resize(g, 5, 4).mean() - g.mean()) < 1


def test_quality_levels(spark):
    sharp = np.indices((120, 200)).sum(0) % 2 * 255
    dark = np.full((40, 60), 5)
    rows = {r.page_no: r for r in jobs.page_quality(spark.createDataFrame(page_rows(sharp, dark), PAGES)).collect()}
    assert rows[0].level == "excellent" and rows[0].contrast == 100.0
    assert rows[1].level == "poor" and {i.type for i in rows[1].issues} == {"low_resolution", "blur", "low_contrast", "too_dark"}


def crop(draw, h=40, w=60):
    a = np.zeros((h, w), bool)
    draw(a)
    return a


def flags(spark, *crops):
    rows = [{"i": i, "w": float(a.shape[1]), "h": float(a.shape[0]),
             **{n: (v.tolist() if isinstance(v, np.ndarray) else v) for n, v in k.profile(a).items()}} for i, a in enumerate(crops)]
    schema = "i int, w double, h double, " + jobs._PROFILE
    return {r.i: r for r in features.region_features(spark.createDataFrame(rows, schema)).collect()}


def test_region_features(spark):
    def fraction(a):
        a[20, 5:55] = True
        a[8:14, 20:30] = True
        a[28:34, 20:30] = True

    def matrix(a):
        a[2:38, 3] = a[2:38, 56] = True
        a[15:25, 20:40] = True

    def grid(a):
        a[5] = a[35] = True
        a[:, 5] = a[:, 50] = True

    def script(a):
        a[20:30, 5:40] = True
        a[8:12, 42:46] = True

    def loop(a):
        a[10:30, 10] = a[10:30, 30] = a[10, 10:31] = a[29, 10:31] = True

    r = flags(spark, crop(fraction), crop(matrix), crop(grid), crop(script), crop(loop), np.zeros((10, 20), bool), np.ones((10, 20), bool))
    assert r[0].has_fraction and not r[0].has_matrix
    assert r[1].has_matrix and not r[1].has_fraction
    assert r[2].has_grid and r[3].has_sup and not r[3].has_sub and r[4].has_greek
    assert r[5].density == 0 and r[6].density == 1 and r[5].aspect == 2 and not r[5].has_fraction
    assert all(0 <= r[i].density <= 1 and 0 <= r[i].edge_density <= 1 and r[i].uniformity <= 1 for i in r)


def test_profile_numbers():
    rng = np.random.default_rng(9)
    a = rng.random((14, 19)) < 0.4
    p = k.profile(a)
    runs = lambda v: sum(1 for i, x in enumerate(v) if x and (i == 0 or not v[i - 1]))
    assert p["col_runs"] == sum(runs(a[:, x]) for x in range(19))
    assert p["row_gaps"] == sum(runs(~a[y]) for y in range(14))
    assert p["curvy_cols"] == sum((np.diff(a[:, x].astype(int)) != 0).sum() >= 3 for x in range(19))
    small = [n for *_, n in slow_components(~a, diagonal=False)]
    assert p["has_loop"] or not [n for n in small if 5 < n < 14 * 19 * 0.3]


def test_tight_box_is_inside():
    rng = np.random.default_rng(4)
    for _ in range(20):
        ink = rng.random((30, 40)) < 0.3
        x, y, w, h, tight = k.tight_box(ink, 300, 200)
        assert 0 <= x and 0 <= y and x + w <= 300 and y + h <= 200 and 0 <= tight <= 1


def test_detection_and_segments(spark):
    page = np.full((300, 300), 255)
    page[40:44, 60:200] = 0
    page[20:32, 100:140] = 0
    page[52:66, 100:140] = 0
    page[200:230, 40:90] = 0
    df = spark.createDataFrame(page_rows(page, np.full((50, 50), 255)), PAGES)
    found = jobs.detect_regions(df, p=NATIVE).collect()
    assert all(r.confidence >= 0.6 and r.x >= 0 and r.x + r.w <= 300 for r in found)
    assert {r.page_no for r in found} <= {0}
    seg = jobs.projection_regions(df).collect()
    whole = [r for r in seg if r.page_no == 1]
    assert [(r.w, r.h, r.confidence) for r in whole] == [(50, 50, 0.8)]
    assert any(abs(r.y - 200) <= 1 and abs(r.h - 29) <= 1 for r in seg if r.page_no == 0)
    bits = {r.page_no: r for r in jobs.binarize_pages(df, p=NATIVE).collect()}
    assert bits[1].blank and not bits[0].blank and bits[0].n_ink > 0
    assert jobs.drop_blank_pages(df).count() == 1


def test_tiles_cover_page(spark):
    page = np.arange(120 * 90).reshape(90, 120) % 251
    p = TileParams(tile_size=50, margin=5, threshold_area=1000)
    got = jobs.tile_pages(spark.createDataFrame(page_rows(page), PAGES), p=p).collect()
    assert len(got) == 6
    seen = np.zeros_like(page, bool)
    for t in got:
        part = np.frombuffer(bytes(t.data), np.uint8).reshape(t.height, t.width)
        assert (part == page[t.tile_y:t.tile_y + t.height, t.tile_x:t.tile_x + t.width]).all()
        seen[t.tile_y:t.tile_y + t.height, t.tile_x:t.tile_x + t.width] = True
    assert seen.all()


def test_whole_page(spark):
    """A box drawn on the page and two lines of mathematics in its text layer, with exact boxes; blank paper gives nothing."""
    page = np.full((200, 400), 255)
    page[120:150, 200:330] = 0
    page[130:140, 220:300] = 255
    items = spark.createDataFrame(
        [(0, i, s, 20.0, 40.0 + 50 * i, 90.0, 14.0, i == 1) for i, s in enumerate(["E = mc^2 + α", "∫ f √x", "plain words"])],
        "page_no int, line_no int, str string, x double, y double, width double, height double, is_math_font boolean")
    df = spark.createDataFrame(page_rows(page), PAGES)
    found = lambda **kw: {(r.detected_by, r.x, r.y, r.w, r.h) for r in jobs.whole_page_regions(df, items, d=NATIVE, **kw).collect()}
    drawn = ("pixel", 198.0, 118.0, 133.0, 33.0)
    assert found() == {drawn}
    low = PageParams(confidence_threshold=0.3)
    written = {("text", -2.0, 13.0, 145.0, 39.0), ("text", -2.0, 63.0, 145.0, 39.0)}
    assert found(p=low) == {drawn} | written
    assert found(p=replace(low, policy="by_size")) == {drawn}
    # a region that several tiles see whole is reported once
    assert len([x for x in found(t=TileParams(tile_size=200, margin=150, threshold_area=1)) if x[0] == "pixel"]) == 1
    blank = spark.createDataFrame(page_rows(np.full((200, 400), 255)), PAGES)
    assert jobs.whole_page_regions(blank, items.filter("line_no = 2"), d=NATIVE, p=low).count() == 0


def png(path, array):
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in array)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", array.shape[1], array.shape[0], 8, 0, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, tmp_path):
    a = np.arange(12 * 20).reshape(12, 20) % 255
    png(tmp_path / "a.png", a)
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.webp").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x")
    pages, rejected = images.read_page_images(spark, str(tmp_path))
    row = pages.first()
    assert (row.width, row.height) == (20, 12) and (np.frombuffer(bytes(row.data), np.uint8).reshape(12, 20) == a).all()
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rejected.collect()} == {
        "b.png": "unreadable", "c.webp": "no_decoder", "d.txt": "unsupported_type"}


def test_stream_pages(spark, tmp_path):
    from regionlake.streaming import jobs as stream

    (tmp_path / "in").mkdir()
    page = np.full((100, 120), 255)
    page[40:60, 20:100] = 0
    png(tmp_path / "in" / "a.png", page)
    df = stream.stream_pages(images.stream_page_images(spark, str(tmp_path / "in")), p=NATIVE)
    q = df.select("path", "x", "y").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = jobs.detect_regions(images.read_page_images(spark, str(tmp_path / "in"))[0], ["path"], p=NATIVE).count()
    assert spark.read.schema("path string").parquet(str(tmp_path / "out")).count() == want


def test_admit_documents(spark):
    files = spark.createDataFrame([("a.pdf", 10), ("b.pdf", 60 * 2**20), ("c.docx", 1), ("d.exe", 1), ("e.md", 6 * 2**20), ("f.pdf", 5), ("g.pdf", 5)],
                                  "path string, length long")
    pages = spark.createDataFrame([("a.pdf", 100), ("f.pdf", 101)], "path string, pages long")
    bad = spark.createDataFrame([("g.pdf",)], "path string")
    got = {r.path: r.reason for r in images.admit_documents(files, pages, bad).collect()}
    assert got == {"a.pdf": None, "b.pdf": "too_large", "c.docx": None, "d.exe": "unsupported_type", "e.md": "too_large",
                   "f.pdf": "too_many_pages", "g.pdf": "unreadable"}


def test_text_layer(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"doc_id":"d","page_no":1,"items":[{"str":"x","transform":[1,0,0,1,5,7],"width":9,"height":3,"font":"S"},{"str":"","transform":[],"width":1,"height":1,"font":"S"},'
        '{"str":"y","transform":[1,0,0,1,6,8],"width":9,"height":3,"font":"T"}],"styles":{"S":{"family":"Symbol","is_math_font":true}}}\n')
    rows = tables.read_text_layer(spark, str(tmp_path / "t.json")).orderBy("line_no").collect()
    assert [(r.line_no, r.str, r.x, r.y, r.is_math_font) for r in rows] == [(0, "x", 5.0, 7.0, True), (2, "y", 6.0, 8.0, False)]


def test_regions_history_runs(spark, tmp_path):
    df = spark.createDataFrame([("d", p, f"r{p}", 1.0, 2.0, 3.0, 4.0, 0.9, "inline") for p in range(3)],
                               "doc_id string, page_no long, id string, x double, y double, w double, h double, confidence double, kind string")
    tables.write_regions(df, str(tmp_path / "r"))
    back = tables.read_regions(spark, str(tmp_path / "r"), df.filter("page_no < 2").select("doc_id", "page_no"))
    assert sorted(r.id for r in back.collect()) == ["r0", "r1"]
    items = spark.createDataFrame([("x", "s"), ("y", None)], "latex string, source string")
    tables.append_history(items, str(tmp_path / "h"), datetime(2024, 1, 1))
    tables.append_history(items, str(tmp_path / "h"), datetime(2024, 1, 2))
    hist = tables.read_history(spark, str(tmp_path / "h")).collect()
    assert len({r.id for r in hist}) == 4 and hist[0].created_at == datetime(2024, 1, 2) and not hist[0].is_favorite
    runs = spark.createDataFrame([("f", True, 4712, 11, 4, None, None, 428.4)], "file string, ready boolean, elapsed_ms long, pages long, formulas long, type string, confidence double, per_page_ms double")
    for fmt in ("csv", "json"):
        tables.write_run_metrics(runs, str(tmp_path / fmt), fmt)
        assert tables.read_run_metrics(spark, str(tmp_path / fmt), fmt).first().elapsed_ms == 4712


def test_exports(spark, tmp_path):
    import json

    rows = [("d", 1, "a", 0.0, 0.0, "display", 0.9, "x", "done", None), ("d", 1, "b", 5.0, 50.0, "inline", 0.8, "y", "done", None),
            ("d", 2, "c", 0.0, 0.0, "inline", 0.7, None, "error", "timeout")]
    df = spark.createDataFrame(rows, "doc_id string, page_no long, id string, x double, y double, kind string, confidence double, latex string, status string, error string")
    df = df.withColumns({"w": F.lit(9.0), "h": F.lit(9.0), "markdown": F.lit(None).cast("string"), "elapsed_ms": F.lit(5)})
    text = lambda pieces: exports.assemble(pieces).first().content
    tex = text(exports.export_latex(df, group_by_page=True, comments=True, title="T", include_failures=True, generated="g"))
    assert tex.index("\\section*{Page 1}") < tex.index("\\begin{equation}\n  x\n\\end{equation}") < tex.index("$y$") < tex.index("% ERROR: timeout")
    assert "% Total Formulas: 3" in tex and "\\title{T}" in tex and tex.endswith("\\end{document}")
    assert "% Type: display, Confidence: 90.0%" in tex
    assert "$$\nx\n$$" in text(exports.export_markdown(df))
    assert "Position: (5, 50)" in text(exports.export_text(df))
    data = json.loads(text(exports.export_json(df, include_failures=True)))
    assert data["metadata"]["totalFormulas"] == 3 and [f["id"] for f in data["formulas"]] == ["a", "b", "c"]
    for size in (1, 2, 3, 4, 10):
        parts = [json.loads(p.content) for p in exports.assemble(exports.export_json(df), rows_per_part=size, json=True).orderBy("part_no").collect()]
        assert [f["id"] for p in parts for f in p["formulas"]] == ["a", "b"] and parts[0]["metadata"]["totalFormulas"] == 2
        assert [p.get("part") for p in parts] == [None, *range(1, -(-4 // size))]
    exports.write_export(exports.assemble(exports.export_text(df)), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() > 5


def test_a_huge_document_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("part_no"), F.repeat(F.col("id").cast("string"), 400).alias("content"))
    with_small = rows.unionByName(spark.createDataFrame([("e", 0, "end")], "doc_id string, part_no long, content string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exports.write_export(with_small, str(tmp_path / "big"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "big").glob("part-*"))
    lines = [x for f in files for x in f.read_text().split()]
    assert len(files) > 2 and lines == [str(i) * 400 for i in range(20_000)] + ["end"]


def test_history_reads_the_days_asked(spark, tmp_path):
    from datetime import datetime

    from regionlake.operators import filters

    for day in (1, 2, 3, 4):
        tables.append_history(spark.createDataFrame([(f"x_{day}", "S")], "latex string, source string"), str(tmp_path / "h"), datetime(2024, 1, day, 12))
    found = filters.search_history(tables.read_history(spark, str(tmp_path / "h")), "X_", datetime(2024, 1, 2), datetime(2024, 1, 3, 23))
    assert sorted(r.latex for r in found.collect()) == ["x_2", "x_3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*day#\d+ >= 2024-01-02", plan)


def test_region_store_is_read_by_viewport(spark, tmp_path):
    """The same boxes as a plain filter, from files whose statistics leave most of them out; huge and negative boxes included."""
    import random

    import pyarrow.parquet as pq

    rng = random.Random(4)
    size = lambda: rng.choice([5.0, 20.0, 64.0, 64.5, 300.0, 4000.0, 1e6])
    rows = [("d", rng.randrange(3), f"r{i}", rng.uniform(-200, 20_000), rng.uniform(-200, 20_000), size(), size(), 0.9, "inline") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id string, page_no long, id string, x double, y double, w double, h double, confidence double, kind string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        tables.write_regions(df, str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for box in ((1000.0, 1000.0, 500.0, 400.0), (-150.0, -50.0, 60.0, 10.0), (0.0, 0.0, 1e5, 1e5), (19_000.0, 3.0, 0.0, 0.0)):
        found = tables.read_viewport(spark, str(tmp_path / "store"), "d", 1, *box, buffer=50.0)
        x, y, w, h = box
        want = {r[2] for r in rows if r[1] == 1 and r[3] <= x + w + 50 and r[3] + r[5] >= x - 50 and r[4] <= y + h + 50 and r[4] + r[6] >= y - 50}
        assert {r.id for r in found.collect()} == want
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        again = tables.read_viewport(spark, str(tmp_path / "store"), "d", 1, 1000.0, 1000.0, 500.0, 400.0, 50.0)
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(doc_bucket" in plan and "GreaterThanOrEqual(zkey" in plan[plan.index("PushedFilters"):]
    intervals = tables.viewport_intervals(1000.0, 1000.0, 500.0, 400.0, 50.0)
    kept = 0
    files = list((tmp_path / "store").rglob("*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        stat = lambda n: meta.row_group(0).column(names.index(n)).statistics
        page, level, key = stat("page_no"), stat("level"), stat("zkey")
        kept += page.min <= 1 <= page.max and any(level.min <= at <= level.max and key.min <= b and a <= key.max for at, a, b in intervals)
    assert len(files) >= 30 and kept < len(files) / 2


def test_recognition_stream_and_fallback(spark, tmp_path):
    from regionlake.streaming import jobs as stream

    def make():
        calls = {}

        def run(row):
            calls[row["id"]] = calls.get(row["id"], 0) + 1
            if bytes(row["data"]) == b"bad" or calls[row["id"]] < 2:
                raise ValueError("no")
            return "x=1"
        return run

    rows = spark.createDataFrame([("a", bytearray(b"1"), 0.9), ("b", bytearray(b"1"), 0.9), ("c", bytearray(b"bad"), 0.9), ("d", bytearray(b"2"), 0.1)],
                                 "id string, data binary, confidence double")
    got = {r.id: (r.success, r.attempts, r.error) for r in lifecycle.recognize_unique(rows, make, delay_seconds=0.0).collect()}
    assert got["a"] == got["b"] == (True, 2, None) and got["c"] == (False, 3, "no")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.stream_recognitions(src, str(tmp_path / "store"), str(tmp_path / "cp"), make, delay_seconds=0.0).awaitTermination()
    out = {r.id: r.success for r in stream.recognised(spark, str(tmp_path / "store")).collect()}
    assert out == {"a": True, "b": True, "c": False}


def test_detection_with_lines_and_crops(spark):
    page = np.full((300, 300), 255)
    page[100:104, 60:200] = 0
    page[84:88, 100:140] = 0
    page[112:116, 100:140] = 0
    df = spark.createDataFrame(page_rows(page), PAGES)
    text = spark.createDataFrame([(0, i, float(y), 14.0) for i, y in enumerate((96, 80, 112))],
                                 "page_no int, line_no int, line_y double, line_h double")
    p = replace(NATIVE, min_confidence=0.2)
    alone = jobs.detect_regions(df, p=p).collect()
    near = jobs.detect_regions(df, p=p, lines=text).collect()
    assert len(alone) == len(near) == 1 and alone[0].kind == "display" and near[0].kind_confidence <= 1
    found = jobs.detect_regions(df, p=p)
    c = jobs.cut_crops(found, df).first()
    assert c.width > 0 and len(c.data) == c.width * c.height
    small = jobs.resize_pages(df, max_side=150).first()
    assert (small.width, small.height) == (150, 150)
    boxes = spark.createDataFrame([(0, "u", 1, 2, 3, 4), (9, "v", 1, 2, 3, 4)], "page_no int, id string, x int, y int, w int, h int")
    r = jobs.select_region(boxes, df, scale=2.0).collect()
    assert [(x.id, x.x, x.orig_x, x.confidence, x.kind) for x in r] == [("manual-0-u", 2.0, 1.0, 1.0, "display")]
    ready = jobs.prepare_crops(found.sparkSession.createDataFrame([("k", 40, 20, 1, bytearray(range(200)) * 4)], "id string, width int, height int, channels int, data binary"), True).first()
    assert min(ready.width, ready.height) >= 320 and set(bytes(ready.data)) <= {0, 255}


def test_refined_box_keeps_ink():
    page = np.full((100, 100), 255.0)
    page[40:60, 30:70] = 0
    x, y, w, h = k.refine_density(page, (28, 38, 44, 24), False, False, False)
    assert x <= 30 and y <= 40 and x + w >= 70 - 1 and y + h >= 60 - 1 and w < 60 and h < 40
    page[30:36, 30:70] = 0
    _, y2, _, h2 = k.refine_density(page, (28, 38, 44, 24), True, False, True)
    assert y2 <= 34 and h2 >= h


def test_merge_tables_and_edits(spark):
    base = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True)], "id int, latex string, is_favorite boolean")
    ch = spark.createDataFrame([(1, False, True), (3, True, None), (4, False, False)], "id int, is_deleted boolean, is_favorite boolean")
    got = {r.id: (r.latex, r.is_favorite) for r in lifecycle.merge_tables(base, ch).collect()}
    assert got == {1: ("a", True), 2: ("b", False), 4: (None, False)}
    e = lifecycle.apply_edit(spark.createDataFrame([("x", "$x$", "\\frac{a}{b}"), ("x", "$x$", "plain")], "latex string, markdown string, edit string")).collect()
    assert [(r.latex, r.markdown) for r in e] == [("\\frac{a}{b}", "$\\frac{a}{b}$"), ("x", "plain")]


def test_recogniser_tries(spark):
    """Refused replies are tried again, time-outs end the tries, unsolved rows stay."""
    import time

    def make():
        calls = {}

        def run(row):
            n = calls[row["id"]] = calls.get(row["id"], 0) + 1
            if row["id"] == "slow":
                time.sleep(3)
            if row["id"] == "late":
                raise TimeoutError
            return "x=1" if n == 2 else "sorry"
        return run

    rows = spark.createDataFrame([("good",), ("slow",), ("late",)], "id string")
    got = {r.id: (r.success, r.error, r.attempts) for r in lifecycle.recognize(
        rows, make, valid=lambda t: "=" in t, delay_seconds=0.01, timeout_seconds=0.5).collect()}
    assert got == {"good": (True, None, 2), "slow": (False, "timeout", 1), "late": (False, "timeout", 1)}
    only = lambda name: lambda df: df.filter(F.col("id") == name).select("id", F.lit("x").alias("latex"))
    out = {r.id: (r.method, r.latex, r.error) for r in lifecycle.with_fallback(rows, [("a", only("good")), ("b", only("late"))]).collect()}
    assert out == {"good": ("a", "x", None), "late": ("b", "x", None), "slow": (None, None, "unsolved")}


def test_active_provider(spark):
    rows = spark.createDataFrame([(1, "backend", "x=1"), (1, "zhipu", "y=1"), (2, "backend", "no"), (2, "gemini", "z=1"), (2, "local", "w=1"),
                                  (3, "backend", None), (4, "own", "v=1")], "id int, provider string, reply string")
    pick = lambda **kw: {r.id: r.provider for r in lifecycle.provider_fallback(rows, F.col("reply").contains("="), **kw).collect()}
    assert pick() == {1: "backend", 2: "gemini", 3: None, 4: None}
    assert pick(active="own", excluded=["gemini"]) == {1: "zhipu", 2: "local", 3: None, 4: "own"}


def test_default_resolution(spark):
    """At the default enlargement a page above the former limit of two million pixels is binarised like a small one."""
    page = np.full((300, 420), 255)
    page[100:140, 50:300] = 0
    df = spark.createDataFrame(page_rows(page), PAGES)
    row = jobs.binarize_pages(df).first()
    assert row.ink_w * row.ink_h > 2_000_000 and row.n_ink > 0
    limited = jobs.binarize_pages(df, p=DetectionParams(max_adaptive_pixels=2_000_000)).first()
    assert bytes(limited.bits) != bytes(row.bits)
    profiles = jobs.row_profiles(spark.createDataFrame(page_rows(np.full((2500, 30), 255)), PAGES))
    assert profiles.count() == 2500


def slow_profile(ink):
    """The counts of one crop, restated pixel by pixel."""
    h, w = ink.shape
    blanks = [n for *_, n in slow_components(~ink, diagonal=False)]
    lengths = sorted(len(run) for row in ink for run in "".join("#" if v else " " for v in row).split())
    return {"rows": ink.sum(1).tolist(), "cols": ink.sum(0).tolist(), "cols_low": ink[int(h * 0.2):].sum(0).tolist(),
            "row_lo": [int(r.argmax()) if r.any() else w for r in ink],
            "row_hi": [int(np.nonzero(r)[0][-1]) if r.any() else 0 for r in ink],
            "row_sum": [int(np.nonzero(r)[0].sum()) for r in ink],
            "stroke": lengths[len(lengths) // 2] if lengths else 0}, blanks


def test_crops_of_a_page_are_counted_together():
    rng = np.random.default_rng(11)
    for density in (0.0, 0.05, 0.4, 0.9, 1.0):
        ink = rng.random((40, 55)) < density
        corners = np.sort(rng.integers(0, 55, (12, 2)), axis=1), np.sort(rng.integers(0, 40, (12, 2)), axis=1)
        boxes = np.stack([corners[0][:, 0], corners[1][:, 0], corners[0][:, 1], corners[1][:, 1]], axis=1)
        one, rows, cols = k.profiles(ink, boxes)
        row_at = np.concatenate([[0], np.cumsum(boxes[:, 3] - boxes[:, 1] + 1)])
        col_at = np.concatenate([[0], np.cumsum(boxes[:, 2] - boxes[:, 0] + 1)])
        for i, (x0, y0, x1, y1) in enumerate(boxes.tolist()):
            part = ink[y0:y1 + 1, x0:x1 + 1]
            want, blanks = slow_profile(part)
            assert {n: v[row_at[i]:row_at[i + 1]].tolist() for n, v in rows.items()} == {n: want[n] for n in rows}
            assert {n: v[col_at[i]:col_at[i + 1]].tolist() for n, v in cols.items()} == {n: want[n] for n in cols}
            assert one["stroke"][i] == want["stroke"]
            assert not one["has_loop"][i] or [n for n in blanks if 5 < n < part.size * 0.3]
            # alone, a crop gives the same counts
            alone = k.profile(part)
            assert all(one[n][i] == alone[n] for n in ("col_runs", "row_gaps", "edges", "curvy_cols", "has_loop", "slant"))
    assert all(len(v) == 0 for v in k.profiles(np.ones((5, 5), bool), np.zeros((0, 4), np.int64))[1].values())


def slow_merge(boxes, gap_x, gap_y):
    """Boxes by tops; each unused one swallows near unused ones, one at a time, until none is near."""
    left = sorted(boxes, key=lambda b: b[1])
    out = []
    while left:
        m = left.pop(0)
        met = True
        while met:
            met = next((b for b in left if b[2] + gap_x >= m[0] and b[0] - gap_x <= m[2]
                        and (max(b[1] - m[3], m[1] - b[3]) < gap_y or (b[1] <= m[3] and b[3] >= m[1]))), None)
            if met:
                left.remove(met)
                m = (min(m[0], met[0]), min(m[1], met[1]), max(m[2], met[2]), max(m[3], met[3]), m[4] + met[4])
        out.append(m)
    return out


@pytest.mark.parametrize("size", [2, 30, 150])
def test_merged_boxes(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 40, 300):
        corner = rng.integers(0, 500, (n, 2))
        boxes = np.concatenate([corner, corner + rng.integers(0, size, (n, 2)), rng.integers(1, 9, (n, 1))], axis=1)
        for gaps in ((0, 0), (5, 3), (30, 15)):
            got = k.merge_boxes(boxes, *gaps).tolist()
            assert [tuple(b) for b in got] == slow_merge([tuple(b) for b in boxes.tolist()], *gaps)


def test_crops_for_remote_recognisers_are_enlarged_on_white(spark):
    rng = np.random.default_rng(4)
    gray = rng.integers(0, 256, (6, 10)).astype(np.uint8)
    want = k.sharpen(k.median3(k.equalize(k.enlarge(gray, 1.5))))
    clear = np.dstack([gray, gray, gray, np.full_like(gray, 255)])
    clear[:3, :, 3] = 0
    rows = [("gray", 10, 6, 1, bytearray(gray.tobytes())), ("clear", 10, 6, 4, bytearray(clear.tobytes()))]
    crops = spark.createDataFrame(rows, "id string, width int, height int, channels int, data binary")
    got = {r.id: r for r in jobs.prepare_crops(crops).collect()}
    assert (got["gray"].width, got["gray"].height) == (15, 9) and bytes(got["gray"].data) == want.tobytes()
    paper = k.sharpen(k.median3(k.equalize(k.enlarge(np.where(np.arange(6)[:, None] < 3, 255, gray).astype(np.uint8), 1.5))))
    assert bytes(got["clear"].data) == paper.tobytes()
    assert jobs.prepare_crops(crops, upscale=1.0).first().width == 10
    hashes = {r.id: r.content_hash for r in jobs.prepare_crops(crops, digest=True).collect()}
    assert hashes == {i: hashlib.sha256(bytes(r.data)).hexdigest() for i, r in got.items()}


@pytest.mark.parametrize("shape, factor", [((1, 1), 1.5), ((2, 3), 1.5), ((7, 5), 1.5), ((8, 6), 2.0), ((5, 9), 1.3)])
def test_enlarged_bytes_are_rounded_exactly(shape, factor):
    a = np.random.default_rng(shape[1]).integers(0, 256, shape).astype(np.uint8)
    got = k.enlarge(a, factor)

    def places(n, m):
        at = [min(max(Fraction(2 * j + 1, 2) * n / m - Fraction(1, 2), Fraction(0)), Fraction(n - 1)) for j in range(m)]
        return [(int(p), min(int(p) + 1, n - 1), p - int(p)) for p in at]

    pick = lambda y, x: int(a[y, x])
    want = [[int((pick(i, x) * (1 - u) + pick(i, z) * u) * (1 - t) + (pick(j, x) * (1 - u) + pick(j, z) * u) * t + Fraction(1, 2))
             for x, z, u in places(shape[1], got.shape[1])] for i, j, t in places(shape[0], got.shape[0])]
    assert got.tolist() == want


def test_bitmaps_of_a_query_are_told_by_their_hash(spark, tmp_path):
    from regionlake import fixtures
    from regionlake.plans import raster_queries as q

    spark.createDataFrame([(1, "x = y\n" * 30), (2, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = jobs.binarize_pages(fixtures.document_pages(spark, str(tmp_path)), q.KEYS, q.NATIVE).collect()
    got = {(r.doc_id, r.page_no): r.bits_hash for r in q.binarize_pages(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and got == {(r.doc_id, r.page_no): hashlib.sha256(bytes(r.bits)).hexdigest() for r in whole}


def test_a_tile_takes_one_kind_of_detections(spark):
    """Text on large tiles, else pixels, else text, else the basic ones; nothing on a blank tile without text."""
    row = "page_no int, tile_no int, id string"
    frame = lambda rows, more="": spark.createDataFrame(rows, row + more)
    tiles = spark.createDataFrame([(0, n, 2000 if n == 1 else 100, 1000) for n in range(6)], "page_no int, tile_no int, tile_w int, tile_h int")
    text = frame([(0, 1, "t1"), (0, 2, "t2"), (0, 3, "t3"), (0, 5, "t5")])
    pixel = frame([(0, 1, "p1", False), (0, 2, "p2", False), (0, 4, "p4", True), (0, 5, "p5", True)], ", blank boolean")
    basic = frame([(0, n, f"b{n}") for n in range(6)])
    pick = lambda *a, **kw: sorted((r.id, r.detected_by) for r in region_ops.text_or_pixel(*a, **kw).collect())
    want = [("p2", "pixel"), ("p5", "pixel"), ("t1", "text"), ("t3", "text")]
    assert pick(text, pixel, tiles) == want
    assert pick(text, pixel, tiles, basic=basic) == sorted([*want, ("b0", "basic")])
    assert pick(text, pixel.drop("blank"), tiles) == sorted([*want, ("p4", "pixel")])


def test_whole_pages_choose_and_move_no_pixels(spark, tmp_path):
    from regionlake import fixtures
    from regionlake.plans import raster_queries as q

    texts = [(1, "a line with x = y + z\n" * 30), (2, ""), (5, "∑ x = √y\n\n" * 20)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages, made = fixtures.document_pages(spark, str(tmp_path)), fixtures.pages_to_make(spark, str(tmp_path))
    items = fixtures.document_items(spark, str(tmp_path))
    low = PageParams(confidence_threshold=0.3, policy="by_size")
    t = TileParams(tile_size=200, margin=20, threshold_area=1000)
    tiles = jobs.tiles_to_make(made, q.KEYS, t)
    cut = {(r.doc_id, r.page_no, r.tile_no, r.tile_x, r.tile_y, r.width, r.height, bytes(r.data)) for r in jobs.tile_pages(pages, q.KEYS, t).collect()}
    assert {(r.doc_id, r.page_no, r.tile_no, r.tile_x, r.tile_y, r.width, r.height, bytes(r.data)) for r in tiles.frame().collect()} == cut
    run = lambda source, **kw: jobs.whole_page_regions(source, items, q.KEYS, low, q.NATIVE, **kw).drop("features")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(run(made)) == rows(run(pages)) and rows(run(made, t=t)) == rows(run(pages, t=t))
    by_tile = {}
    for r in run(made).collect():
        by_tile.setdefault((r.doc_id, r.page_no), set()).add(r.detected_by)
    assert by_tile and all(len(kinds) == 1 for kinds in by_tile.values())
    registered = q.whole_page_regions(spark, str(tmp_path))
    whole = jobs.whole_page_regions(pages, items, q.KEYS, PageParams(policy="by_size"), q.NATIVE).select(*registered.columns)
    assert rows(registered) == rows(whole)
    plan = q.detect_regions(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("MapInArrow") == 1
