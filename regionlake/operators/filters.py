"""Filters and projections on region, history and image tables."""

from __future__ import annotations


from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scoring
from ..params import DetectionParams, ValidationParams

c = F.col


def filter_detections(df: DataFrame, p: DetectionParams = DetectionParams(), show: str = "both") -> DataFrame:
    """F1.  ``show`` is 'display', 'inline' or 'both' and narrows the include flags."""
    keep = c("confidence") >= p.min_confidence
    if not p.include_inline or show == "display":
        keep = keep & (c("kind") != "inline")
    if not p.include_display or show == "inline":
        keep = keep & (c("kind") != "display")
    return df.filter(keep)


def validate_regions(df: DataFrame, p: ValidationParams = ValidationParams()) -> DataFrame:
    """a math signal, a plausible size and a minimum confidence."""
    return df.filter(
        scoring.has_math_signal()
        & c("w").between(p.min_width, p.max_width) & c("h").between(p.min_height, p.max_height)
        & (c("confidence") >= p.min_confidence))


def filter_page_and_confidence(df: DataFrame, page_no: int | None, threshold: float) -> DataFrame:
    """one page or all; a missing confidence counts as 1."""
    keep = F.coalesce(c("confidence"), F.lit(1.0)) >= threshold
    return df.filter(keep if page_no is None else (c("page_no") == page_no) & keep)


def filter_by_size(df: DataFrame, pages: DataFrame | None = None, p: DetectionParams = DetectionParams(),
                   scale: float = 1.0, page_size: tuple[float, float] | None = None) -> DataFrame:
    """size limits times the scale, small boxes without structure, boxes that cover most of the page.

    Page sizes come from ``pages`` (page_no, width, height) or from one ``page_size`` for all.
    """
    half_up = lambda v: int(v * scale + 0.5)
    keep = (
        c("h").between(half_up(p.min_height), half_up(p.max_height)) & (c("w") >= half_up(p.min_width))
        & (((c("w") >= 24) & (c("h") >= 14)) | scoring.has_structure()))
    sized = df.filter(keep)
    if page_size is not None:
        return sized.filter(c("w") * c("h") <= max(1.0, page_size[0] * page_size[1]) * p.max_page_share)
    limit = pages.select("page_no", (F.greatest(F.lit(1.0), c("width") * c("height")) * p.max_page_share).alias("_max"))
    return sized.join(limit, "page_no").filter(c("w") * c("h") <= c("_max")).drop("_max")


def search_history(df: DataFrame, query: str | None = None, start: datetime | None = None,
                   end: datetime | None = None, favorites_only: bool = False) -> DataFrame:
    """inclusive dates, favourites, case-insensitive substring of the LaTeX or the source.

    A table with the column ``day`` (files of a history are partitioned by it) is bounded by day too, so other days are not read.
    """
    if "day" in df.columns:
        for bound, keep in ((start, c("day") >= F.to_date(F.lit(start))), (end, c("day") <= F.to_date(F.lit(end)))):
            df = df if bound is None else df.filter(keep)
    if start is not None:
        df = df.filter(c("created_at") >= F.lit(start))
    if end is not None:
        df = df.filter(c("created_at") <= F.lit(end))
    if favorites_only:
        df = df.filter("is_favorite")
    if query:
        q = query.lower()
        df = df.filter(F.lower("latex").contains(q) | F.coalesce(F.lower("source").contains(q), F.lit(False)))
    return df


def regions_in_viewport(df: DataFrame, x: float, y: float, w: float, h: float, buffer: float = 100.0) -> DataFrame:
    """boxes that meet the buffered viewport, edges included."""
    return df.filter(
        (c("x") <= x + w + buffer) & (c("x") + c("w") >= x - buffer)
        & (c("y") <= y + h + buffer) & (c("y") + c("h") >= y - buffer))


def skip_low_confidence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows not worth the recogniser."""
    return df.filter(c("confidence") >= threshold)


def reproject_boxes(df: DataFrame, image_scale: str = "image_scale", render_scale: str = "render_scale") -> DataFrame:
    """box in input pixels (x, y, w, h) and in page units (orig_*)."""
    inv = F.when(c(image_scale) > 0, 1 / c(image_scale)).otherwise(F.lit(1.0))
    safe = F.when(c(render_scale) > 0, c(render_scale)).otherwise(F.lit(1.0))
    boxes = {n: c(n) * inv for n in ("x", "y", "w", "h")}
    return df.withColumns(boxes | {f"orig_{n}": (c(n) * inv) / safe for n in boxes})


def choose_resolution(df: DataFrame, p: DetectionParams = DetectionParams()) -> DataFrame:
    """render scale, source and target resolution from image size (img_w, img_h) and page size (page_w, page_h)."""
    scale = geo.render_scale(c("img_w"), c("img_h"), c("page_w"), c("page_h"))
    return (
        df.withColumn("render_scale", scale)
        .withColumn("source_dpi", c("render_scale") * 72)
        .withColumn("target_dpi", geo.target_dpi(
            c("img_w"), c("img_h"), c("source_dpi"), p.max_detection_pixels, p.min_detection_dpi)))


def crop_boxes(df: DataFrame, pad: float = 10.0, page_w="page_w", page_h="page_h") -> DataFrame:
    """padded whole-pixel crops clamped to the page; empty ones are dropped."""
    cols = geo.crop(c("x"), c("y"), c("w"), c("h"), c(page_w), c(page_h), pad)
    return df.withColumns(cols).filter("crop_w > 0 AND crop_h > 0")


def filter_completed(df: DataFrame) -> DataFrame:
    """F16."""
    return df.filter((c("status") == "done") & (c("latex") != ""))


def multi_formula_candidates(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """tall images that may hold several formulas."""
    return df.filter((c(height) > 200) & (c(height) > c(width) * 0.5))


def classify_levels(df: DataFrame) -> DataFrame:
    """X3 as a table step."""
    return df.withColumn("level", scoring.level(c("confidence")))


