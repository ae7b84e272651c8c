"""Joins, aggregates, order and set operations on region tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.geometry import box_fields, intersection, iou, js_round, overlap_of_smaller
from ..lineage import cut
from ..params import MAX_FOLD_ROWS, MAX_WINDOW_ROWS, LevelParams, TileParams
from .ordered import deal, has_hot_group, hot_groups, scan

c = F.col


# ---------------------------------------------------------------- joins
def attach_recognitions(regions: DataFrame, results: DataFrame, done_only: bool = False,
                        partitions: int | None = None) -> DataFrame:
    """Results by region id; a missing one is pending.

    ``partitions`` (see `ordered.partitions_for`) keeps the tasks of a large join of about unique ids small; without it the
    join has the session's number.
    """
    r = deal(results.select("id", "status", "latex", "elapsed_ms", "error"), partitions, "id")
    regions = deal(regions, partitions, "id")
    if done_only:
        return regions.join(r.filter((c("status") == "done") & c("latex").isNotNull()), "id")
    return regions.join(r, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def pending_regions(regions: DataFrame, results: DataFrame, partitions: int | None = None) -> DataFrame:
    """Regions without a result other than pending or error; ``partitions`` as in `attach_recognitions`."""
    settled = results.filter(~c("status").isin("pending", "error")).select("id")
    return deal(regions, partitions, "id").join(deal(settled, partitions, "id"), "id", "left_anti")


def overlap_pairs(df: DataFrame, page: Sequence[str] = ("page_no",), min_iou: float | None = None,
                  min_overlap: float | None = None, cell: float = 128.0) -> DataFrame:
    """Pairs of distinct boxes of a page that overlap, with IoU and share of the smaller box.

    Exact copies of a box are one row with a count, so a crowd of copies yields no pairs among itself.  Boxes meet only
    in shared grid cells, and a pair is reported by the cell that holds the corner of its intersection.
    """
    page = list(page)
    boxes = df.filter("w > 0 AND h > 0").groupBy(*page, "x", "y", "w", "h").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    span = lambda lo, len_: F.sequence(F.floor(c(lo) / cell), F.floor((c(lo) + c(len_)) / cell))
    rows = boxes.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))
    side = lambda s: rows.select(*page, "_cx", "_cy", F.struct("id", "x", "y", "w", "h", "n").alias(s))
    a, b = c("a"), c("b")
    corner = (F.floor(F.greatest(a["x"], b["x"]) / cell) == c("_cx")) & (
        F.floor(F.greatest(a["y"], b["y"]) / cell) == c("_cy"))
    inter = intersection(*box_fields(a), *box_fields(b))
    pairs = side("a").join(side("b"), [*page, "_cx", "_cy"]).filter((a["id"] < b["id"]) & corner & (inter > 0))
    out = pairs.select(
        *page, a["id"].alias("id_a"), b["id"].alias("id_b"), a["n"].alias("copies_a"), b["n"].alias("copies_b"),
        iou(*box_fields(a), *box_fields(b)).alias("iou"),
        overlap_of_smaller(*box_fields(a), *box_fields(b)).alias("overlap"))
    if min_iou is not None:
        out = out.filter(c("iou") > min_iou)
    if min_overlap is not None:
        out = out.filter(c("overlap") > min_overlap)
    return out


def regions_in_viewports(df: DataFrame, viewports: DataFrame, buffer: float = 100.0, cell: float = 256.0,
                         few: int = 64) -> DataFrame:
    """J5/F6 for a table of viewports (viewport_id, page_no, vx, vy, vw, vh).

    Up to ``few`` viewports of a page are one array that its regions look through, so a region is moved once; the viewports of
    other pages and their regions meet by page and grid cell.
    """
    v = viewports.select(
        "viewport_id", "page_no", (c("vx") - buffer).alias("_x0"), (c("vy") - buffer).alias("_y0"),
        (c("vx") + c("vw") + buffer).alias("_x1"), (c("vy") + c("vh") + buffer).alias("_y1"))
    if not has_hot_group(v, ["page_no"], few):
        return _in_few_viewports(df, v)
    many = cut(hot_groups(v, ["page_no"], few))
    part = lambda rows, how: rows.join(many, "page_no", how)
    return _in_few_viewports(part(df, "left_anti"), part(v, "left_anti")).unionByName(
        _in_viewport_cells(part(df, "left_semi"), part(v, "left_semi"), cell))


def _meets(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (c("x") <= x1) & (c("x") + c("w") >= x0) & (c("y") <= y1) & (c("y") + c("h") >= y0)


def _in_few_viewports(df: DataFrame, v: DataFrame) -> DataFrame:
    """Regions and viewports (edges _x0, _y0, _x1, _y1) of a page meet through an array of its viewports."""
    packed = v.groupBy("page_no").agg(F.collect_list(F.struct("viewport_id", "_x0", "_y0", "_x1", "_y1")).alias("_views"))
    hit = F.filter("_views", lambda e: _meets(e["_x0"], e["_y0"], e["_x1"], e["_y1"]))
    return df.join(packed, "page_no").select(F.explode(F.transform(hit, lambda e: e["viewport_id"])).alias("viewport_id"), *df.columns)


def _in_viewport_cells(df: DataFrame, v: DataFrame, cell: float) -> DataFrame:
    """The same by page and grid cell.  Edges count, so cells are compared closed; each match is kept in the one cell of its
    corner."""
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    v = v.withColumn("_cx", F.explode(span(c("_x0"), c("_x1")))).withColumn("_cy", F.explode(span(c("_y0"), c("_y1"))))
    r = df.withColumn("_cx", F.explode(span(c("x"), c("x") + c("w")))).withColumn(
        "_cy", F.explode(span(c("y"), c("y") + c("h"))))
    corner = (F.floor(F.greatest("x", "_x0") / cell) == c("_cx")) & (F.floor(F.greatest("y", "_y0") / cell) == c("_cy"))
    meet = _meets(c("_x0"), c("_y0"), c("_x1"), c("_y1"))
    return r.join(v, ["page_no", "_cx", "_cy"]).filter(meet & corner).select("viewport_id", *df.columns)


def tile_grid(pages: DataFrame, p: TileParams = TileParams()) -> DataFrame:
    """R3 geometry: one tile for small pages, else a grid of overlapping tiles clipped to the page."""
    small = c("width") * c("height") < p.threshold_area
    last = lambda side: F.when(small, F.lit(0).cast("bigint")).otherwise(F.ceil(c(side) / p.tile_size) - 1)
    zero = F.lit(0).cast("bigint")
    grid = (
        pages.withColumn("_small", small)
        .withColumn("tile_row", F.explode(F.sequence(zero, last("height"))))
        .withColumn("tile_col", F.explode(F.sequence(zero, last("width")))))
    start = lambda i: F.greatest(zero, c(i) * p.tile_size - p.margin)
    full = p.tile_size + 2 * p.margin
    cols = F.ceil(c("width") / p.tile_size)
    return grid.select(
        *pages.columns,
        F.when(c("_small"), zero).otherwise(c("tile_row") * cols + c("tile_col")).alias("tile_no"),
        start("tile_col").alias("tile_x"), start("tile_row").alias("tile_y"),
        F.when(c("_small"), c("width")).otherwise(F.least(F.lit(full), c("width") - start("tile_col"))).alias("tile_w"),
        F.when(c("_small"), c("height")).otherwise(F.least(F.lit(full), c("height") - start("tile_row"))).alias("tile_h"),
        F.when(c("_small"), 0).otherwise(p.margin).alias("tile_margin"))


def tiles_of(width: int, height: int, p: TileParams = TileParams()) -> list[tuple[int, int, int, int, int]]:
    """`tile_grid` of one page: (tile_no, tile_x, tile_y, tile_w, tile_h)."""
    if width * height < p.threshold_area:
        return [(0, 0, 0, width, height)]
    full, cols = p.tile_size + 2 * p.margin, -(-width // p.tile_size)
    out = []
    for row in range(-(-height // p.tile_size)):
        for col in range(cols):
            x, y = max(0, col * p.tile_size - p.margin), max(0, row * p.tile_size - p.margin)
            out.append((row * cols + col, x, y, min(full, width - x), min(full, height - y)))
    return out


def assign_to_tiles(items: DataFrame, pages: DataFrame, p: TileParams = TileParams(),
                    page: str = "page_id") -> DataFrame:
    """Tiles whose half-open area holds the origin (x, y) of an item.  Tile numbers are computed, not searched."""
    sized = items.join(pages.select(page, c("width").alias("_pw"), c("height").alias("_ph")), page)
    small = c("_pw") * c("_ph") < p.threshold_area
    zero = F.lit(0).cast("bigint")
    full = p.tile_size + 2 * p.margin
    cols = lambda side: F.ceil(c(side) / p.tile_size)

    def candidates(axis: str, side: str) -> Column:
        at = F.floor(c(axis) / p.tile_size)
        lo = F.greatest(zero, at - 1)
        hi = F.least(cols(side) - 1, at + 1)
        return F.when(small, F.array(zero)).when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    rows = sized.withColumn("_r", F.explode(candidates("y", "_ph"))).withColumn(
        "_c", F.explode(candidates("x", "_pw")))
    x0, y0 = (F.greatest(zero, c(i) * p.tile_size - p.margin) for i in ("_c", "_r"))
    w = F.when(small, c("_pw")).otherwise(F.least(F.lit(full), c("_pw") - x0))
    h = F.when(small, c("_ph")).otherwise(F.least(F.lit(full), c("_ph") - y0))
    inside = (c("x") >= x0) & (c("x") < x0 + w) & (c("y") >= y0) & (c("y") < y0 + h)
    return rows.filter(inside).select(
        *items.columns, F.when(small, zero).otherwise(c("_r") * cols("_pw") + c("_c")).alias("tile_no"))


def select_by_ids(df: DataFrame, ids: DataFrame, key: str = "id", partitions: int | None = None) -> DataFrame:
    """J11; ``partitions`` as in `attach_recognitions`."""
    return deal(df, partitions, key).join(deal(ids.select(key), partitions, key), key, "left_semi")


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "id", partitions: int | None = None) -> DataFrame:
    """J11; ``partitions`` as in `attach_recognitions`."""
    return deal(df, partitions, key).join(deal(ids.select(key), partitions, key), key, "left_anti")


# ---------------------------------------------------------------- aggregates
def detection_stats(df: DataFrame, by: Sequence[str] = (), p: LevelParams = LevelParams()) -> DataFrame:
    """G1: one row per group, or one row with zeros for an empty table without groups."""
    lev = scoring.level(c("confidence"), p)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c("kind") == "display").alias("display"), F.count_if(c("kind") != "display").alias("inline"),
        F.count_if(lev == "high").alias("high"), F.count_if(lev == "medium").alias("medium"),
        F.count_if(lev == "low").alias("low"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def status_counts(regions: DataFrame, results: DataFrame, by: Sequence[str] = ("page_no",),
                  partitions: int | None = None) -> DataFrame:
    """G2; ``partitions`` as in `attach_recognitions`."""
    rows = attach_recognitions(regions, results, partitions=partitions)
    done, busy = F.count_if(c("status") == "done"), F.count_if(c("status") == "processing")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shown"), done.alias("done"), busy.alias("processing"),
        (F.count(F.lit(1)) - done - busy).alias("pending"),
        F.count_if(c("kind") == "display").alias("display"), F.count_if(c("kind") == "inline").alias("inline"))


def page_counts(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions per page, zero for pages without any."""
    n = regions.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_regions"))
    return pages.join(n, "page_no", "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0).cast("bigint")))


def page_context(df: DataFrame, page_area: Column, page: Sequence[str] = ("page_no",)) -> DataFrame:
    """Share of the page covered, mean area and number of formulas."""
    return df.groupBy(*page).agg(F.sum(c("w") * c("h")).alias("area"), F.count(F.lit(1)).alias("n_formulas")).select(
        *page, (c("area") / page_area).alias("formula_density"), (c("area") / c("n_formulas")).alias("avg_size"),
        "n_formulas")


def detections_by_class(df: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Candidates per class, mean certainty and how many pass each later stage."""
    sized = c("h").between(12, 300) & (c("w") >= 16)
    formula = c("content_class") == "formula"
    return df.groupBy("content_class").agg(
        F.count(F.lit(1)).alias("candidates"), F.avg("certainty").alias("avg_certainty"),
        F.count_if(sized).alias("size_ok"), F.count_if(sized & formula).alias("formulas"),
        F.count_if(sized & formula & (c("confidence") >= min_confidence)).alias("kept"))


# ---------------------------------------------------------------- order
def reading_order(df: DataFrame, page: Sequence[str] = ("page_no",), tolerance: float = 20.0,
                  limit: int = MAX_WINDOW_ROWS, hot: bool | None = None) -> DataFrame:
    """Line number (a new line where y grows by more than the tolerance) and position on the page."""
    page = list(page)
    hot = has_hot_group(df, page, limit) if hot is None else hot
    rows = scan(df, page, ["y", "id"], previous={"_py": "y"}, hot=hot)
    rows = rows.withColumn("_new", F.coalesce((c("y") - c("_py") > tolerance).cast("int"), F.lit(0)))
    rows = scan(rows, page, ["y", "id"], sums={"_line": "_new"}, hot=hot)
    rows = rows.withColumn("line_no", (c("_line") + 1).cast("int")).drop("_py", "_new", "_line")
    return scan(rows, page, ["line_no", "x", "id"], number="position", hot=hot)


def number_regions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number", **kw) -> DataFrame:
    """1-based number within a page or document."""
    return scan(df, keys, order, number=name, **kw)


def confidence_bands(df: DataFrame, n: int = 3, min_confidence: float = 0.5,
                     page: Sequence[str] = ("page_no",)) -> DataFrame:
    """Equal-width bands from the page's best confidence down; band 0 holds the best."""
    rows = df.filter(c("confidence") >= min_confidence)
    best = rows.groupBy(*page).agg(F.max("confidence").alias("_best"))
    step = (c("_best") - min_confidence) / n
    band = scoring.total([(c("confidence") < c("_best") - step * i).cast("int") for i in range(1, n)] or [F.lit(0)])
    return rows.join(best, list(page)).withColumn("band", band).drop("_best")


def top_k(df: DataFrame, k: int, page: Sequence[str] | None = ("page_no",)) -> DataFrame:
    """O1: best k per page (cut before the shuffle by the window group limit) or of the whole table."""
    order = [c("confidence").desc(), c("id")]
    if page is None:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*page).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


# ---------------------------------------------------------------- set operations
def concat_detections(*parts: DataFrame) -> DataFrame:
    """U1."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_or_pixel(text: DataFrame, pixel: DataFrame, tiles: DataFrame, large_pixels: int = 1_200_000,
                  tile: Sequence[str] = ("page_no", "tile_no"), basic: DataFrame | None = None) -> DataFrame:
    """Per tile the text detections when there are some and the tile is large or pixels found none, else pixels, else the
    ``basic`` detections.

    ``tiles`` has tile_w and tile_h; the detection tables have the same columns.  ``pixel`` may tell whether its tile is
    ``blank``: a blank tile without text has no detections.
    """
    tile = list(tile)
    by = lambda df, name: df.withColumn("detected_by", F.lit(name))
    if "blank" not in pixel.columns:
        pixel = pixel.withColumn("blank", F.lit(False))
    both = by(text.withColumn("blank", F.lit(False)), "text").unionByName(by(pixel, "pixel"))
    if basic is not None:
        both = both.unionByName(by(basic.withColumn("blank", F.lit(False)), "basic"))
    found = both.groupBy(*tile).agg(
        F.count_if(c("detected_by") == "text").alias("_t"), F.count_if(c("detected_by") == "pixel").alias("_p"),
        F.bool_or("blank").alias("_blank"))
    large = c("tile_w") * c("tile_h") > large_pixels
    pick = F.when((c("_t") > 0) & (large | (c("_p") == 0)), "text").when((c("_t") == 0) & c("_blank"), "none").when(
        c("_p") > 0, "pixel").otherwise("basic")
    choice = found.join(tiles.select(*tile, "tile_w", "tile_h"), tile).select(*tile, pick.alias("_pick"))
    return both.join(choice, tile).filter(c("detected_by") == c("_pick")).drop("_pick", "blank")


def merge_by_position(existing: DataFrame, incoming: DataFrame, order: str = "seq", limit: int = MAX_FOLD_ROWS,
                      page: Sequence[str] = ("page_no",)) -> DataFrame:
    """One row per page and box rounded to 0.1.

    Of the existing rows the last counts.  An incoming row takes over when it brings the missing crop (has_crop) or
    beats the confidence by more than 0.01, in ``order``.  Small groups fold a sorted array; for groups above the limit
    the next take-over is found by an aggregate per round, so no group is gathered.
    """
    cols = existing.columns
    keys = [*page, "_kx", "_ky", "_kw", "_kh"]
    key = {f"_k{n}": js_round(c(n) * 10) for n in ("x", "y", "w", "h")}
    conf = lambda r: F.coalesce(r["confidence"], F.lit(-1.0))
    takes = lambda cur, r: (~cur["has_crop"] & r["has_crop"]) | (conf(r) > conf(cur) + 0.01)

    base = existing.withColumns(key).groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(
        *keys, F.lit(0).alias("_batch"), "_row")
    rows = base.unionByName(
        incoming.select(*cols).withColumns(key).select(*keys, F.lit(1).alias("_batch"), F.struct(*cols).alias("_row")))
    rows = rows.withColumn("_at", F.struct("_batch", F.col(f"_row.{order}").alias("_o")))

    def fold(part: DataFrame) -> DataFrame:
        packed = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_all"))
        final = F.aggregate(
            F.slice("_all", 2, F.greatest(F.lit(1), F.size("_all") - 1)), F.get("_all", F.lit(0))["_row"],
            lambda cur, r: F.when(takes(cur, r["_row"]), r["_row"]).otherwise(cur))
        return packed.select(final.alias("r")).select("r.*")

    if not has_hot_group(rows, keys, limit):
        return fold(rows)
    hot = hot_groups(rows, keys, limit)
    big = cut(rows.join(hot, keys, "left_semi"))
    current = cut(big.groupBy(*keys).agg(F.min_by(F.struct("_at", "_row"), "_at").alias("_cur")))
    settled = []
    while not current.isEmpty():
        step = big.join(current, keys).filter(
            (c("_at") > c("_cur._at")) & takes(c("_cur._row"), c("_row"))
        ).groupBy(*keys).agg(F.min_by(F.struct("_at", "_row"), "_at").alias("_cur"))
        step = cut(step)
        settled.append(current.join(step.select(*keys), keys, "left_anti").select("_cur._row"))
        current = step
    out = fold(rows.join(hot, keys, "left_anti"))
    for s in settled:
        out = out.unionByName(s.select("_row.*"))
    return out
