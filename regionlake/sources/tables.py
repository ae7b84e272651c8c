"""Text layers, regions, history and run metrics as files."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from ..schemas import REGIONS, RUN_METRICS, TEXT_LAYER

c = F.col


def read_text_layer(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S3: one row per non-empty text item with position, size, font and whether the font is mathematical."""
    return text_layer_items(spark.read.schema(TEXT_LAYER).format(fmt).load(path))


def text_layer_items(layers: DataFrame) -> DataFrame:
    rows = layers.select("doc_id", "page_no", "styles", F.posexplode("items").alias("line_no", "i"))
    at = lambda n: F.get("i.transform", F.lit(n))
    return rows.filter(F.coalesce(c("i.str"), F.lit("")) != "").select(
        "doc_id", "page_no", "line_no", c("i.str").alias("str"), at(4).alias("x"), at(5).alias("y"),
        c("i.width").alias("width"), c("i.height").alias("height"), c("i.font").alias("font"),
        F.coalesce(F.try_element_at("styles", c("i.font"))["is_math_font"], F.lit(False)).alias("is_math_font"))


def write_regions(regions: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Regions without pixels, partitioned by a document bucket, in order of pages and places.

    A region has a level, the least whose cells are as large as it is, and the Morton key of its corner's cell there.  Files are
    ranges of (document, page, level, key), as many as the size asks for, so a page with most of the rows is written by many
    tasks and a viewport reads the files whose statistics meet a few key intervals.
    """
    names = [f.split()[0] for f in REGIONS.split(", ")]
    rows = regions.select(*[c(n) if n in regions.columns else F.lit(None).cast(t).alias(n) for n, t in (
        f.split() for f in REGIONS.split(", "))])
    rows = rows.select(*names).withColumn("doc_bucket", F.pmod(F.hash("doc_id"), F.lit(buckets)))
    side = F.greatest(c("w"), c("h"), F.lit(CELL))
    level = F.coalesce(F.least(F.ceil(F.log2(side / CELL)), F.lit(LEVELS - 1)), F.lit(0)).cast("int")
    at = lambda v: F.floor(c(v) / (CELL * F.pow(F.lit(2.0), c("level"))))
    rows = rows.withColumn("level", level).withColumn("zkey", _morton(at("x"), at("y")))
    order = ("doc_bucket", "doc_id", "page_no", "level", "zkey")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("doc_bucket").parquet(path)


#: side of a cell of level 0; cells of a level are twice as large as those of the one before
CELL, LEVELS, BITS = 64.0, 21, 24
_MIDDLE = 1 << BITS - 1


def _morton(x: Column, y: Column) -> Column:
    """Bits of two cell numbers in turn; numbers count from the middle of their range, and those beyond it stand at its ends."""
    def spread(v: Column) -> Column:
        v = F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), v + _MIDDLE)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _intervals(x0: int, y0: int, x1: int, y1: int, most: int = 8) -> list[tuple[int, int]]:
    """At most about ``most`` intervals of Morton keys that cover a rectangle of cells (ends included)."""
    nodes, whole = [(0, 0, BITS)], []
    while nodes and len(nodes) + len(whole) < most:
        split = []
        for x, y, k in nodes:
            for a, b in ((x, y), (x + (1 << k - 1), y), (x, y + (1 << k - 1)), (x + (1 << k - 1), y + (1 << k - 1))):
                end = (1 << k - 1) - 1
                if a <= x1 and a + end >= x0 and b <= y1 and b + end >= y0:
                    inside = k == 1 or (x0 <= a and a + end <= x1 and y0 <= b and b + end <= y1)
                    (whole if inside else split).append((a, b, k - 1))
        nodes = split
    key = lambda x, y: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))
    out: list[tuple[int, int]] = []
    for low, high in sorted((key(x, y), key(x, y) + (1 << 2 * k) - 1) for x, y, k in nodes + whole):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def viewport_intervals(x: float, y: float, w: float, h: float, buffer: float = 0.0) -> list[tuple[int, int, int]]:
    """(level, first key, last key) of all cells whose regions can meet a viewport."""
    out = []
    for level in range(LEVELS):
        cell = CELL * 2 ** level
        # a region reaches at most one cell beyond its own, on the last level as far as it likes
        beyond = cell if level < LEVELS - 1 else float("inf")
        place = lambda v: min(max(math.floor(v / cell) + _MIDDLE, 0), (1 << BITS) - 1) if math.isfinite(v) else 0
        x0, y0 = place(x - buffer - beyond), place(y - buffer - beyond)
        out += [(level, a, b) for a, b in _intervals(x0, y0, place(x + w + buffer), place(y + h + buffer))]
    return out


def read_viewport(spark: SparkSession, path: str, doc_id: str, page_no: int, x: float, y: float, w: float, h: float,
                  buffer: float = 100.0, buckets: int = 64) -> DataFrame:
    """F6 on the store: regions of a page that meet the buffered viewport, edges included.

    The bucket is a partition filter; page, levels and key intervals go to the files' statistics.
    """
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit(doc_id)), F.lit(buckets))).first()[0]
    rows = spark.read.schema(REGIONS + ", level int, zkey long, doc_bucket int").parquet(path)
    keys = " OR ".join(f"(level = {k} AND zkey BETWEEN {a} AND {b})" for k, a, b in viewport_intervals(x, y, w, h, buffer))
    near = rows.filter((c("doc_bucket") == bucket) & (c("doc_id") == doc_id) & (c("page_no") == page_no)).filter(keys)
    return filters.regions_in_viewport(near, x, y, w, h, buffer).drop("level", "zkey", "doc_bucket")


def read_regions(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """Stored regions, of existing pages only when ``pages`` (doc_id, page_no) is given."""
    rows = spark.read.schema(REGIONS + ", doc_bucket int").parquet(path).drop("doc_bucket")
    return rows if pages is None else rows.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")


def append_history(items: DataFrame, path: str, now: datetime | None = None) -> None:
    """New rows get an id, the time and no favourite mark; files are partitioned by day."""
    at = F.current_timestamp() if now is None else F.lit(now)
    items.select(
        F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), "latex", F.expr("uuid()")), 256).alias("id"), "latex",
        at.cast("timestamp").alias("created_at"), "source", F.lit(False).alias("is_favorite"),
        F.to_date(at).alias("day")).write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Newest first."""
    return spark.read.parquet(path).orderBy(c("created_at").desc(), c("id"))


def read_run_metrics(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S12."""
    reader = spark.read.schema(RUN_METRICS).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def write_run_metrics(runs: DataFrame, path: str, fmt: str = "csv") -> None:
    """S12."""
    writer = runs.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
