"""Input tables of the queries, derived from the given parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import partitions_for, scan
from .raster.jobs import PagesToMake

PAGE_W, PAGE_H = 200.0, 140.0
TAIL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region_cols() -> dict[str, Column]:
    c = F.col
    return {
        "page_no": c("l_orderkey"),
        "idx": c("idx"),
        "id": F.concat(c("l_orderkey").cast("string"), F.lit("-"), c("idx").cast("string")),
        "x": ((c("l_partkey") * 37) % 120).cast("double"),
        "y": ((c("l_suppkey") * 53) % 80).cast("double"),
        "w": 20 + c("l_quantity"),
        "h": (12 + (c("l_linenumber") * 7) % 40).cast("double"),
        "confidence": F.round(0.5 + c("l_discount") * 5, 4),
        "kind": F.when(c("l_returnflag") == "A", "display").when(c("l_returnflag") == "N", "inline").otherwise(
            "numbered"),
    }


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem numbered within its order."""
    return scan(table(spark, sf_dir, "lineitem"), ["l_orderkey"], TAIL_ORDER, number="idx")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of 200 x 140."""
    return _numbered(spark, sf_dir).select(*[c.alias(n) for n, c in _region_cols().items()])


def region_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a join that moves every region, by the number of rows that the files of lineitem state."""
    return partitions_for(spark, table(spark, sf_dir, "lineitem").count())


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with pixel and text features."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    base = _numbered(spark, sf_dir).select(
        *[c.alias(n) for n, c in _region_cols().items()],
        (p % 11 == 0).alias("has_integral"), (p % 7 == 0).alias("has_sum"), (s % 5 == 0).alias("has_fraction"),
        (p % 13 == 0).alias("has_matrix"), (s % 9 == 0).alias("has_root"), (p % 3 == 0).alias("has_greek"),
        (p % 4 == 0).alias("has_sup"), (s % 4 == 0).alias("has_sub"),
        (F.col("l_discount") * 6).alias("density"), ((F.col("l_tax") + 0.0) * 10).alias("vertical_complexity"),
        (F.col("l_quantity") / 100).alias("edge_density"), (1 - (F.col("l_tax") + 0.0)).alias("uniformity"),
        (F.col("l_discount") * 10).alias("tightness"), (p % 17 == 0).alias("has_grid"),
        (p % 6).alias("math_symbols"), (s % 4).alias("greek_count"),
    )
    return base.withColumns({
        "aspect": F.col("w") / F.col("h"),
        "math_font": F.col("has_greek"),
        "has_scripts": F.col("has_sup") | F.col("has_sub"),
        "has_large_ops": F.col("has_integral") | F.col("has_sum"),
        "has_brackets": F.col("has_matrix"),
    })


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of the pages: y = 0, 20, ..., 120, height 12; every third page has none."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_no")).filter(
        "page_no % 3 <> 0").distinct()
    return pages.select("page_no", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("line_no")).select(
        "page_no", "line_no", (F.col("line_no") * 20.0).alias("line_y"), F.lit(12.0).alias("line_h"))


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of the documents as text items."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "str"))
        .filter("str <> ''")
        .select(
            "doc_id", "line_no", "str", F.lit(10.0).alias("x"), (F.col("line_no") * 14.0).alias("y"),
            (F.length("str") * 7.0).alias("width"), F.lit(12.0).alias("height"),
            F.when(F.col("doc_id") % 5 == 0, "Symbol").otherwise("Times").alias("font"),
            (F.col("doc_id") % 5 == 0).alias("is_math_font"))
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: whole documents with mathematics put before or around them by document number."""
    d, text = F.col("doc_id").cast("string"), F.col("text")
    kind = F.col("doc_id") % 8
    reply = (
        F.when(kind == 0, F.concat(F.lit("```latex\n\\frac{a}{b} + "), d, F.lit(" "), text, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("$$x^2 + y^2 = "), d, F.lit(" "), text, F.lit("$$")))
        .when(kind == 2, F.concat(F.lit("text $\\alpha_{i}$ "), text))
        .when(kind == 3, F.concat(F.lit("Sorry, the image is blurry "), text))
        .when(kind == 4, F.concat(F.lit("∫ f ≤ ∞ · π "), text))
        .when(kind == 5, F.concat(F.lit("\\begin{matrix} a "), text))
        .when(kind == 6, F.concat(F.lit("{a_1}^{2 "), text))
        .otherwise(text)
    )
    provider = F.element_at(
        F.array(F.lit("backend"), F.lit("zhipu"), F.lit("gemini"), F.lit("local")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), provider.alias("provider"), reply.alias("reply"), "source")


def recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition state of three pages in four."""
    state = (F.col("page_no") + F.col("idx")) % 5
    return regions(spark, sf_dir).filter("page_no % 4 <> 0").select(
        "page_no", "idx", "id",
        F.when(state == 0, "error").when(state == 1, "pending").otherwise("done").alias("status"),
        F.when(state > 1, F.concat(F.lit("x_{"), F.col("idx").cast("string"), F.lit("} = "),
                                   F.col("page_no").cast("string"))).alias("latex"),
        ((F.col("page_no") * 31 + F.col("idx") * 7) % 900).alias("elapsed_ms"),
        F.when((state == 0) & (F.col("page_no") % 2 == 0), "timeout").when(state == 0, "invalid").alias("error"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("latex"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 37).cast("int"))
         ).alias("created_at"),
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("source"),
        (F.col("doc_id") % 7 == 0).alias("is_favorite"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        "user_id", F.concat(F.lit("u"), (u % 140).cast("string"), F.lit("@example.com")).alias("email"),
        (u % 2 == 0).alias("email_verified"),
        F.when(u % 5 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("expires_at"),
        (u % 50 == 0).alias("is_admin"),
        F.when(u % 100 == 0, "registered").otherwise("none").alias("simulate_mode"))


def redemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    amount = F.element_at(F.array(F.lit(5), F.lit(14), F.lit(40), F.lit(7)), (e % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.concat(F.lit("ACTV-"), F.lpad((e % 500).cast("string"), 4, "0"), F.lit("-AAAA-AAAA")).alias("code"),
        amount.alias("amount"))


def issued_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that exist: nine in ten of those anybody tries."""
    return redemptions(spark, sf_dir).select("code").distinct().filter(
        F.substring("code", 9, 1) != "9")


def _clock() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
        secs=((F.col("event_id") % 20000) * 2).cast("decimal(18,6)"))


def _email() -> Column:
    return F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"), F.lit("@example.com"))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification codes sent, on a compressed clock."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        "event_id", _email().alias("email"),
        F.lpad((F.col("event_id") * 7919 % 1000000).cast("string"), 6, "0").alias("code"), _clock().alias("ts"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes typed in: the latest one sent, or a wrong one for every third attempt."""
    sent = sends(spark, sf_dir).select("email", "ts", "event_id", F.col("code").alias("sent"))
    tries = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        "event_id", _email().alias("email"), _clock().alias("ts"), F.lit(None).cast("string").alias("sent"))
    both = sent.select("email", "ts", "event_id", "sent").withColumn("is_try", F.lit(False)).unionByName(
        tries.withColumn("is_try", F.lit(True)))
    both = both.withColumn(
        "mark", F.when(~F.col("is_try"), F.struct("ts", "event_id", "sent")))
    seen = scan(both, ["email"], ["ts", "event_id"], maxs={"last": "mark"})
    return seen.filter("is_try").select(
        "event_id", "email", "ts",
        F.when(F.col("event_id") % 3 != 0, F.coalesce("last.sent", F.lit("000000"))).otherwise(
            F.lit("000000")).alias("code"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored detections keyed by content and options."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"),
        F.concat(F.lit("mc:0.6|res:"), (72 * (F.col("doc_id") % 3 + 1)).cast("string")).alias("options_key"),
        F.col("source").alias("owner"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 37).cast("int"))
         ).alias("ts"),
        F.col("n_chars").alias("bytes"))


def tile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), (800 + F.col("p_size") * 60).cast("bigint").alias("width"),
        (1000 + (F.col("p_partkey") % 40) * 80).alias("height"))


def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 bitmaps, one row per cell."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "v")).select(
        "vec_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"),
        (F.col("v") > 0).alias("ink"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation, whole texts (self-join on the next turn number)."""
    t = table(spark, sf_dir, "conversations")
    a = t.select("conv_id", "turn", F.col("text").alias("original"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("modified"))
    return a.join(b, ["conv_id", "turn"])


# ---------------------------------------------------------------- rasters
LINE_CHARS, PAGE_LINES, GLYPH_W, GLYPH_H, PITCH = 80, 24, 4, 14, 30
PAGES_AT_ONCE = 16


def document_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of `document_pages`, counted from the lines of the texts without setting a page."""
    lines = F.split("text", "\n", -1)
    rows = F.aggregate(lines, F.lit(0), lambda n, line: n + F.greatest(F.lit(1), F.ceil(F.length(line) / LINE_CHARS).cast("int")))
    pages = F.sequence(F.lit(0), F.ceil(rows / PAGE_LINES).cast("int") - 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(pages).alias("page_no"))


def document_pages(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Whole documents set as page images: lines wrapped at 80 characters, 24 to a page, a pattern per character.

    ``only`` chooses pages (doc_id, page_no): their texts are moved to the keys, and no other page is set.  Its other columns
    go with their page, which has one row then.
    """
    return pages_to_make(spark, sf_dir, only).frame()


def pages_to_make(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> PagesToMake:
    """`document_pages`, set by the task that looks at them."""
    import numpy as np
    import pandas as pd

    rest = [] if only is None else [n for n in only.columns if n not in ("doc_id", "page_no")]
    place = np.arange(GLYPH_H)[:, None] // 2 * GLYPH_W + np.arange(GLYPH_W)[None, :]

    def image(lines):
        codes = np.zeros((PAGE_LINES, LINE_CHARS), np.int64)
        for i, line in enumerate(lines):
            codes[i, :len(line)] = np.frombuffer(line.encode("utf-32-le"), "<u4")
        used, which = np.unique(codes, return_inverse=True)
        shown = np.array([u > 0 and not chr(u).isspace() for u in used.tolist()])
        ink = (((used[:, None, None] * 2654435761) >> (place % 28)) & 1 == 1) & shown[:, None, None]
        # a row of a character is one number of as many bytes as it has pixels
        glyphs = np.where(ink, 0, 255).astype(np.uint8).view(f"u{GLYPH_W}")[:, :, 0]
        page = np.full((PAGE_LINES, PITCH, LINE_CHARS), -1, f"i{GLYPH_W}").view(glyphs.dtype)
        page[:, :GLYPH_H] = glyphs.T[:, which.reshape(codes.shape)].transpose(1, 0, 2)
        return page.tobytes()

    def images(pdf):
        chosen = pdf["pages"] if "pages" in pdf.columns else [None] * len(pdf)
        for doc_id, text, wanted in zip(pdf["doc_id"], pdf["text"], chosen):
            wanted = None if wanted is None else {w["page_no"]: [w[n] for n in rest] for w in wanted}
            rows = [line[i:i + LINE_CHARS] for line in text.split("\n") for i in range(0, max(len(line), 1), LINE_CHARS)]
            for page_no, first in enumerate(range(0, len(rows), PAGE_LINES)):
                if wanted is None or page_no in wanted:
                    yield (doc_id, page_no, LINE_CHARS * GLYPH_W, PAGE_LINES * PITCH, 1, image(rows[first:first + PAGE_LINES]),
                           *(wanted[page_no] if wanted else ()))

    def render(batches):
        for pdf in batches:
            pages = images(pdf)
            # a batch of texts becomes far more pixels than a task can hold, so a few pages leave at a time
            while out := list(islice(pages, PAGES_AT_ONCE)):
                yield pd.DataFrame(out, columns=["doc_id", "page_no", "width", "height", "channels", "data", *rest])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if only is not None:
        docs = docs.join(only.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", *rest)).alias("pages")).hint("merge"), "doc_id")
    # few bytes per row here become many below, so rows are spread before they grow
    docs = docs.repartition(spark.sparkContext.defaultParallelism * 2, "doc_id")
    sizes = lambda: document_page_keys(spark, sf_dir).withColumns(
        {"width": F.lit(LINE_CHARS * GLYPH_W), "height": F.lit(PAGE_LINES * PITCH)})
    return PagesToMake(docs, render, "doc_id bigint, page_no int", sizes, lambda rows: pages_to_make(spark, sf_dir, rows))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text layer of `document_pages`: one item per wrapped line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_l", "_s"))
    parts = lines.select("doc_id", "_l", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("_s") / LINE_CHARS).cast("int") - 1)),
        lambda i: F.substr(F.col("_s"), i * LINE_CHARS + 1, F.lit(LINE_CHARS)))).alias("_p", "str"))
    rows = scan(parts, ["doc_id"], ["_l", "_p"], number="_n")
    at = (F.col("_n") - 1) % PAGE_LINES
    return rows.filter("str <> ''").select(
        "doc_id", F.floor((F.col("_n") - 1) / PAGE_LINES).cast("int").alias("page_no"), at.cast("int").alias("line_no"), "str",
        F.lit(0.0).alias("x"), (at * PITCH + GLYPH_H).cast("double").alias("y"), (F.length("str") * float(GLYPH_W)).alias("width"),
        F.lit(float(GLYPH_H)).alias("height"), (F.col("doc_id") % 5 == 0).alias("is_math_font"))


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 bitmaps as counts per row and column, aggregated from their cells."""
    cells = raster_cells(spark, sf_dir).withColumn("_k", F.col("ink").cast("bigint"))
    counts = lambda by: cells.groupBy("vec_id", by).agg(F.sum("_k").alias("n")).groupBy("vec_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(by, "n"))), lambda r: r["n"]).alias(by + "s"))
    return counts("row").join(counts("col"), "vec_id").withColumns({"w": F.lit(8.0), "h": F.lit(8.0)})
