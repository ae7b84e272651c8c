"""Stored results over time: reuse, versions, retention, history, provider choice and recognition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.barrier import settle
from ..lineage import cut
from ..params import PROVIDER_PRIORITY
from .ordered import scan

c = F.col


# ---------------------------------------------------------------- keys
def content_hash(data: Column) -> Column:
    """X17."""
    return F.sha2(data, 256)


def document_id(name: Column, size: Column) -> Column:
    """Stable id from name and size."""
    return F.sha2(F.concat_ws("-", name, size.cast("string")), 256)


def options_key(min_confidence: float, inline: bool, display: bool, resolution: float, source_dpi: float,
                preprocess: bool) -> str:
    """Options that change results, in a fixed order."""
    half_up = lambda v: int(v + 0.5)
    return (f"mc:{min_confidence:g}|in:{int(inline)}|ds:{int(display)}|res:{half_up(resolution)}"
            f"|src:{half_up(source_dpi)}|pre:{int(preprocess)}")


# ---------------------------------------------------------------- J7
def reuse_detections(wanted: DataFrame, stored: DataFrame, now: datetime, ttl_seconds: int = 86_400) -> DataFrame:
    """Mark each wanted (content_hash, options_key) as reusable when a stored row is not older than the TTL."""
    fresh = stored.filter(c("ts") >= F.lit(now) - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).groupBy(
        "content_hash", "options_key").agg(F.max("ts").alias("stored_at"))
    return wanted.join(fresh, ["content_hash", "options_key"], "left").withColumn("reused", c("stored_at").isNotNull())


def to_compute(wanted: DataFrame, stored: DataFrame, now: datetime, ttl_seconds: int = 86_400) -> DataFrame:
    """Rows without a usable stored result."""
    return reuse_detections(wanted, stored, now, ttl_seconds).filter("NOT reused").drop("reused", "stored_at")


# ---------------------------------------------------------------- W7, U5
def latest_version(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as an aggregate, so a key with many versions is reduced before the shuffle."""
    rest = [n for n in df.columns if n not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")
    return df.groupBy(*key).agg(best).select(*key, "_v.*").select(*df.columns)


def apply_edit(df: DataFrame, content: str = "edit") -> DataFrame:
    """An edit with a backslash or brace sets LaTeX and its inline form, any other one the markdown only."""
    is_latex = c(content).contains("\\") | c(content).contains("{")
    return df.withColumns({
        "latex": F.when(is_latex, c(content)).otherwise(c("latex")),
        "markdown": F.when(is_latex, F.concat(F.lit("$"), c(content), F.lit("$"))).otherwise(
            F.coalesce(c(content), c("markdown")))})


def merge_tables(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` (with is_deleted) replace, add to or delete rows of ``base``; null fields keep the old value."""
    cols = [n for n in base.columns if n != key]
    ch = changes.select(key, "is_deleted", *[c(n).alias(f"_n_{n}") for n in cols if n in changes.columns])
    joined = base.join(ch, key, "full_outer").filter(~F.coalesce("is_deleted", F.lit(False)))
    return joined.select(key, *[
        F.coalesce(f"_n_{n}", n).alias(n) if n in changes.columns else c(n) for n in cols])


# ---------------------------------------------------------------- O2-O4, G14
def history_page(df: DataFrame, limit: int, favorites_only: bool = False) -> DataFrame:
    """O2: newest first."""
    rows = df.filter("is_favorite") if favorites_only else df
    return rows.orderBy(c("created_at").desc(), c("id")).limit(limit)


def retain_newest(df: DataFrame, n: int, ttl_seconds: int, now: datetime, owner: Sequence[str] = ("owner",)) -> DataFrame:
    """O3: drop expired rows, then keep the newest n per owner (cut before the shuffle by the window group limit)."""
    fresh = df.filter(c("ts") >= F.lit(now) - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    w = Window.partitionBy(*owner).orderBy(c("ts").desc(), c("id"))
    return fresh.withColumn("_n", F.row_number().over(w)).filter(c("_n") <= n).drop("_n")


def trim_to_budget(df: DataFrame, budget: int, owner: Sequence[str] = ("owner",), share: float = 0.8) -> DataFrame:
    """Owners above the budget lose their oldest rows until the share of the budget is met."""
    owner = list(owner)
    total = df.groupBy(*owner).agg(F.sum("bytes").alias("_total"))
    rows = scan(df, owner, [c("ts").desc(), c("id").desc()], sums={"_kept": "bytes"})
    return rows.join(total, owner).filter((c("_total") <= budget) | (c("_kept") <= budget * share)).select(*df.columns)


def cache_stats(df: DataFrame, by: Sequence[str] = ("owner",)) -> DataFrame:
    """G14."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), F.min("ts").alias("oldest_ts"),
        F.min_by("id", F.struct("ts", "id")).alias("oldest_id"), F.sum("bytes").alias("bytes"))


# ---------------------------------------------------------------- G5, G6, G9
def history_stats(df: DataFrame, now: datetime) -> DataFrame:
    """G5."""
    month = F.date_trunc("month", F.lit(now))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("created_at") >= month).alias("this_month"),
        F.count_if("is_favorite").alias("favorites"))


def group_by_source(df: DataFrame, file_name: str | None = None) -> DataFrame:
    """Groups by source, else file name, else the unnamed group, which sorts last."""
    name = F.coalesce(F.nullif("source", F.lit("")), *([F.nullif(file_name, F.lit(""))] if file_name else []))
    return df.withColumn("_g", name).groupBy("_g").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("_g", F.lit("未分类")).alias("group_name"), "n", c("_g").isNull().alias("unnamed"))


def recognition_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Settled rows, successes, failures, times and completion rate."""
    ok, bad = c("status") == "done", c("status") == "error"
    settled = df.filter(ok | bad)
    return settled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(bad).alias("failed"),
        F.avg("elapsed_ms").alias("mean_ms"), F.sum("elapsed_ms").alias("total_ms"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("completion_rate"))


def errors_by_message(df: DataFrame) -> DataFrame:
    """G6."""
    return df.filter("status = 'error'").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Per file and in all (``overall``, file is null): time, pages, formulas, time per page."""
    per = runs.rollup("file").agg(F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("pages").alias("pages"),
                                  F.sum("formulas").alias("formulas"), (F.grouping("file") == 1).alias("overall"))
    return per.withColumn("per_page_ms", F.try_divide(c("elapsed_ms"), c("pages")))


# ---------------------------------------------------------------- J12
def provider_rank(provider: Column, priority: Sequence[str] = PROVIDER_PRIORITY) -> Column:
    return F.array_position(F.array(*map(F.lit, priority)), provider)


def provider_fallback(replies: DataFrame, valid: Column, excluded: Sequence[str] = (),
                      priority: Sequence[str] = PROVIDER_PRIORITY, active: str = "backend") -> DataFrame:
    """Per item the valid reply of the active provider, else of the first other one in priority.

    Providers outside the priority answer only where they are the active one; excluded ones are never substitutes.  Items
    without a usable reply keep a null one.
    """
    rank = F.when(c("provider") == active, 0).otherwise(F.nullif(provider_rank(c("provider"), priority), F.lit(0)))
    usable = F.coalesce(valid, F.lit(False)) & rank.isNotNull()
    if excluded:
        usable = usable & ((c("provider") == active) | ~c("provider").isin(*excluded))
    best = F.min(F.when(usable, F.struct(rank.alias("rank"), "provider", "reply")))
    return replies.groupBy("id").agg(best.alias("b")).select("id", "b.provider", "b.reply")


# ---------------------------------------------------------------- U3, D1-D3
def dedupe_images(crops: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(one row per content, every id with its content hash)."""
    keyed = crops.withColumn("content_hash", content_hash(c(data)))
    return _one_each(keyed), keyed.select("id", "content_hash")


def _one_each(keyed: DataFrame) -> DataFrame:
    """The row of the first id of each content."""
    rest = [n for n in keyed.columns if n not in ("id", "content_hash")]
    return keyed.groupBy("content_hash").agg(
        F.min_by(F.struct("id", *rest), "id").alias("_f")).select("content_hash", "_f.*")


RESULT = "id string, success boolean, latex string, error string, attempts int"


def attempt(fn: Callable[[dict], str], row: dict, max_attempts: int = 3, valid: Callable[[str], bool] | None = None,
            delay_seconds: float = 1.0, timeout_seconds: float | None = None) -> tuple[bool, str | None, str | None, int]:
    """(success, text, error, tries) of a recogniser on one crop."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    text = error = None
    tries = 0
    while tries < max_attempts and text is None:
        if tries:
            time.sleep(delay_seconds * 2 ** (tries - 1))
        tries += 1
        pool = ThreadPoolExecutor(1) if timeout_seconds else None
        try:
            got = fn(row) if pool is None else pool.submit(fn, row).result(timeout_seconds)
            if valid is None or valid(got):
                text = got
            else:
                error = "invalid"
        except TimeoutError:
            error = "timeout"
            break
        except Exception as ex:  # a failed crop must not fail the job
            error = str(ex) or type(ex).__name__
        finally:
            if pool is not None:  # a call that hangs is left behind
                pool.shutdown(wait=False)
    return text is not None, text, None if text is not None else error, tries


def _pack(crops: DataFrame, data: str) -> DataFrame:
    """``crops`` with each row's bytes compressed, and their length in ``_size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            at = batch.schema.get_field_index(data)
            column = batch.column(at)
            sizes = [len(v.as_buffer()) if v.is_valid else None for v in column]
            packed = [codec.compress(v.as_buffer(), asbytes=True) if v.is_valid else None for v in column]
            yield batch.set_column(at, data, pa.array(packed, column.type)).append_column("_size", pa.array(sizes, pa.int64()))

    types = ", ".join(f"`{n}` {t}" for n, t in crops.dtypes)
    return crops.mapInArrow(run, f"{types}, _size bigint")


def _unpacking(make_recognizer: Callable[[], Callable[[dict], str]], data: str) -> Callable[[], Callable[[dict], str]]:
    """The same recogniser for the rows of `_pack`; a crop is made whole only while it is looked at."""
    def make():
        fn, codec = make_recognizer(), pa.Codec("zstd")

        def one(row: dict) -> str:
            row = dict(row)
            size = row.pop("_size")
            if row[data] is not None:
                row[data] = codec.decompress(row[data], decompressed_size=int(size), asbytes=True)
            return fn(row)

        return one

    return make


def recognize(crops: DataFrame, make_recognizer: Callable[[], Callable[[dict], str]], max_attempts: int = 3,
              valid: Callable[[str], bool] | None = None, delay_seconds: float = 1.0,
              timeout_seconds: float | None = None) -> DataFrame:
    """Run a user's recogniser over crops; a failure becomes a row with its error.

    ``make_recognizer`` is called once per task and returns a function from a row (dict) to text.  A failed try, or a text
    that ``valid`` refuses, is repeated after a pause that doubles each time; a time-out, by ``timeout_seconds`` or raised
    by the recogniser, ends the tries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_recognizer()
        for pdf in batches:
            rows = [(str(row["id"]), *attempt(fn, row, max_attempts, valid, delay_seconds, timeout_seconds)) for row in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=["id", "success", "latex", "error", "attempts"])

    return crops.withColumn("id", c("id").cast("string")).mapInPandas(run, RESULT)


def recognize_unique(crops: DataFrame, make_recognizer, data: str = "data", **kw) -> DataFrame:
    """U3 + D1: identical crops are recognised once and the result goes to every id.

    Bytes are compressed before they are moved to where their copies meet.
    """
    if dict(crops.dtypes)[data] == "binary":
        ids = crops.select("id", content_hash(c(data)).alias("content_hash"))
        packed = _pack(crops.withColumn("content_hash", content_hash(c(data))), data)
        unique = _one_each(packed)
        make_recognizer = _unpacking(make_recognizer, data)
    else:
        unique, ids = dedupe_images(crops, data)
    done = recognize(unique.drop("id").withColumnRenamed("content_hash", "id"), make_recognizer, **kw)
    return ids.join(done.withColumnRenamed("id", "content_hash"), "content_hash")


def map_tiles(tiles: DataFrame, fn, schema) -> DataFrame:
    """A user's function over batches of tiles."""
    return tiles.mapInPandas(fn, schema)


def with_fallback(df: DataFrame, methods: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], key: str = "id") -> DataFrame:
    """D3: each method sees the rows that no earlier one solved; results carry the method's name.

    A method's results are written before they decide what the next one sees, so no method runs twice.  Rows that no method
    solves come last, with their key, a null method and the error "unsolved".
    """
    left, out = df, None
    for name, method in methods:
        got = cut(method(left).withColumn("method", F.lit(name)))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    rest = left.select(key, F.lit(None).cast("string").alias("method"), F.lit("unsolved").alias("error"))
    return rest if out is None else out.withColumn("error", F.lit(None).cast("string")).unionByName(rest, allowMissingColumns=True)


def first_valid(df: DataFrame, column: str, methods: Sequence[tuple[str, Callable[[Column], Column]]], valid: Callable[[Column], Column],
                key: str = "id") -> DataFrame:
    """D3 for methods that need one row alone: (key, method, result, error) as `with_fallback`, in one pass.

    A row keeps the result of the first method that makes a valid one; later methods are not tried on it.
    """
    rows = df.select(key, column, F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("result"))
    for name, method in methods:
        todo = c("method").isNull()
        rows = settle(rows.withColumn("_tried", F.when(todo, method(c(column)))))
        rows = settle(rows.withColumn("_good", todo & valid(c("_tried"))))
        rows = rows.withColumns({"method": F.when(c("_good"), name).otherwise(c("method")),
                                 "result": F.when(c("_good"), c("_tried")).otherwise(c("result"))}).drop("_tried", "_good")
    return rows.select(key, "method", "result", F.when(c("method").isNull(), "unsolved").alias("error"))
