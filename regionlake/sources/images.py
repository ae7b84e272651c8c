"""Reading page images and admitting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import DocumentLimits
from ..schemas import IMAGE

c = F.col
# fixed values: file types that are admitted, and those Spark's image source can decode
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp", "heic", "heif")
DECODABLE = ("png", "jpg", "jpeg", "gif", "bmp")
# fixed values: document type by MIME type and by extension
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/markdown": "markdown", "text/x-markdown": "markdown",
}
BROADCAST_PATHS = 100_000
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "md": "markdown", "markdown": "markdown"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def page_pixels(images: DataFrame) -> DataFrame:
    """Rows of the image source as page rows; a broken file has width -1 and no data."""
    return images.select(
        c("image.origin").alias("path"), c("image.width").alias("width"), c("image.height").alias("height"),
        c("image.nChannels").alias("channels"), c("image.data").alias("data"))


def read_page_images(spark: SparkSession, path: str, limits: DocumentLimits = DocumentLimits()) -> tuple[DataFrame, DataFrame]:
    """(pages with pixels, rejected files with a reason).

    Size and type come from file metadata.  Files of other types are not opened; Spark's image source decodes a file that is
    too large before it is dropped here.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ext = extension(c("path"))
    reason = (
        F.when(~ext.isin(*IMAGE_TYPES, *DECODABLE), "unsupported_type")
        .when(c("length") > limits.image_bytes, "too_large").when(~ext.isin(*DECODABLE), "no_decoder"))
    checked = files.withColumn("reason", reason)
    any_case = ",".join("".join(f"[{ch}{ch.upper()}]" if ch.isalpha() else ch for ch in t) for t in DECODABLE)
    images = page_pixels(spark.read.format("image").option("dropInvalid", False).option(
        "pathGlobFilter", f"*.{{{any_case}}}").load(path))
    key = lambda col: F.regexp_replace(col, "^file:/+", "/")
    # the few files that are dropped go to the pixels, not the pixels through a shuffle to a list of all files
    dropped = checked.filter("reason IS NOT NULL").filter(ext.isin(*DECODABLE)).select(key(c("path")).alias("_k"))
    if dropped.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS:
        dropped = F.broadcast(dropped)
    pages = images.withColumn("_k", key(c("path"))).join(dropped, "_k", "left_anti").drop("_k")
    broken = pages.filter("width < 0").select("path", F.lit("unreadable").alias("reason"))
    return pages.filter("width > 0"), checked.filter("reason IS NOT NULL").select("path", "reason").unionByName(broken)


def stream_page_images(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """T7 source: page images as they arrive."""
    raw = spark.readStream.format("image").schema(IMAGE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return page_pixels(raw)


def admit_documents(files: DataFrame, page_counts: DataFrame | None = None, unreadable: DataFrame | None = None,
                    limits: DocumentLimits = DocumentLimits()) -> DataFrame:
    """Document type and the reason for rejecting a file (null when admitted).

    ``files`` has path, length and optionally mime; ``page_counts`` has path and pages; ``unreadable`` has path.
    """
    mime = _lookup(MIME_TYPES, c("mime")) if "mime" in files.columns else F.lit(None).cast("string")
    rows = files.withColumn("doc_type", F.coalesce(mime, _lookup(EXTENSIONS, extension(c("path")))))
    sizes = F.try_element_at(F.create_map(
        F.lit("pdf"), F.lit(limits.pdf_bytes), F.lit("docx"), F.lit(limits.docx_bytes), F.lit("markdown"),
        F.lit(limits.markdown_bytes)), c("doc_type"))
    rows = rows.join(page_counts.select("path", "pages"), "path", "left") if page_counts is not None else rows.withColumn(
        "pages", F.lit(None).cast("bigint"))
    if unreadable is not None:
        rows = rows.join(unreadable.select("path").distinct().withColumn("_bad", F.lit(True)), "path", "left")
    else:
        rows = rows.withColumn("_bad", F.lit(None).cast("boolean"))
    reason = (
        F.when(c("doc_type").isNull(), "unsupported_type").when(c("length") > sizes, "too_large")
        .when((c("doc_type") == "pdf") & c("_bad"), "unreadable")
        .when((c("doc_type") == "pdf") & (c("pages") > limits.max_pages), "too_many_pages"))
    return rows.withColumn("reason", reason).drop("_bad")
