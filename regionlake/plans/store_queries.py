"""Queries that write tables to the shared folder and read them back, and keys of rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lineage import scratch_path
from ..operators import filters, lifecycle, metering
from ..sources import images, stores, tables
from .registry import HISTORY, REGIONS, STORE, USERS, query

c = F.col


@query("region_store", f"""WITH {REGIONS} SELECT CAST(page_no // 100 AS VARCHAR) AS doc_id, page_no, id, x, y, w, h, confidence, kind FROM regions_fx
  WHERE page_no % 2 = 0""")
def region_store(spark, sf):
    """Written by document bucket; only the regions of existing pages are read."""
    path = scratch_path(spark, "regions")
    rows = fx.regions(spark, sf).withColumn("doc_id", F.floor(c("page_no") / 100).cast("string"))
    tables.write_regions(rows.withColumns({n: c(n).cast("double") for n in ("w", "h", "confidence")}), path)
    pages = rows.filter("page_no % 2 = 0").select("doc_id", "page_no").distinct()
    return tables.read_regions(spark, path, pages).select("doc_id", "page_no", "id", "x", "y", "w", "h", "confidence", "kind")


@query("stored_viewport", f"""WITH {REGIONS}, d AS (SELECT max(page_no) AS p FROM regions_fx)
  SELECT page_no, id, x, y, w, h FROM regions_fx, d WHERE page_no = p AND x <= 85 AND x + w >= 25 AND y <= 55 AND y + h >= 15""")
def stored_viewport(spark, sf):
    """F6 on the stored regions of the last page, by key intervals."""
    path = scratch_path(spark, "regions")
    rows = fx.regions(spark, sf).withColumn("doc_id", F.floor(c("page_no") / 100).cast("string"))
    tables.write_regions(rows.withColumns({n: c(n).cast("double") for n in ("w", "h", "confidence")}), path)
    page = rows.agg(F.max("page_no")).first()[0]
    return tables.read_viewport(spark, path, str(page // 100), page, 30.0, 20.0, 50.0, 30.0, 5.0).select("page_no", "id", "x", "y", "w", "h")


@query("history_store", f"""WITH {HISTORY} SELECT latex, source, TIMESTAMP '2024-01-20 12:00:00' AS created_at, false AS is_favorite FROM history_fx""")
def history_store(spark, sf):
    """S5."""
    path = scratch_path(spark, "history")
    tables.append_history(fx.history(spark, sf).select("latex", "source"), path, datetime(2024, 1, 20, 12))
    return tables.read_history(spark, path).select("latex", "source", "created_at", "is_favorite")


@query("merged_store", f"""WITH {HISTORY} SELECT id, latex, CASE WHEN id % 60 = 0 THEN NOT is_favorite ELSE is_favorite END AS is_favorite
  FROM history_fx WHERE id % 110 <> 0 UNION ALL SELECT -1 - id, 'new', NULL FROM history_fx WHERE id % 90 = 0""")
def merged_store(spark, sf):
    """U5 on a stored table, by two merges: marks turned and rows deleted, then rows added."""
    path = scratch_path(spark, "merged")
    rows = fx.history(spark, sf).select("id", "latex", "is_favorite")
    stores.create_keyed(rows, path)
    stores.merge_keyed(rows.filter("id % 60 = 0 OR id % 110 = 0").select(
        "id", (c("id") % 110 == 0).alias("is_deleted"), (~c("is_favorite")).alias("is_favorite")), path)
    stores.merge_keyed(rows.filter("id % 90 = 0").select(
        (-1 - c("id")).alias("id"), F.lit(False).alias("is_deleted"), F.lit("new").alias("latex")), path)
    return stores.read_keyed(spark, path)


@query("stored_detections", f"""WITH {STORE}, s AS (SELECT content_hash, options_key, max(ts) AS stored_at FROM store_fx
    WHERE id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY ALL)
  SELECT id, stored_at IS NOT NULL AS reused, stored_at FROM store_fx LEFT JOIN s USING (content_hash, options_key) WHERE id % 2 = 1""")
def stored_detections(spark, sf):
    """J7 against a bucketed store: only the wanted rows are shuffled."""
    path = scratch_path(spark, "detections")
    rows = fx.store(spark, sf)
    name = "detections_" + path.rsplit("-", 1)[1]
    stores.write_lookup(rows.filter("id % 2 = 0").select("content_hash", "options_key", "ts"), name, path)
    wanted = rows.filter("id % 2 = 1").select("id", "content_hash", "options_key")
    return lifecycle.reuse_detections(wanted, spark.table(name), datetime(2024, 1, 20, 12), 10 * 86_400).select("id", "reused", "stored_at")


@query("run_metrics_store", """SELECT concat('file-', CAST(l_suppkey AS VARCHAR)) AS file, l_partkey % 900 AS elapsed_ms,
  CAST(l_linenumber AS BIGINT) AS pages, l_returnflag AS type FROM lineitem""")
def run_metrics_store(spark, sf):
    """S12."""
    path = scratch_path(spark, "runs")
    null = lambda kind: F.lit(None).cast(kind)
    runs = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("file-"), c("l_suppkey").cast("string")).alias("file"), null("boolean").alias("ready"),
        (c("l_partkey") % 900).alias("elapsed_ms"), c("l_linenumber").cast("bigint").alias("pages"), null("bigint").alias("formulas"),
        c("l_returnflag").alias("type"), null("double").alias("confidence"), null("double").alias("per_page_ms"))
    tables.write_run_metrics(runs, path)
    return tables.read_run_metrics(spark, path).select("file", "elapsed_ms", "pages", "type")


@query("admit_documents", """WITH f AS (SELECT concat('/in/', CAST(doc_id AS VARCHAR), ['.pdf', '.docx', '.md', '.exe'][CAST(doc_id % 4 + 1 AS INT)]) AS path,
    n_chars * 10000 AS length, doc_id, ['pdf', 'docx', 'markdown', NULL][CAST(doc_id % 4 + 1 AS INT)] AS doc_type FROM documents)
  SELECT path, doc_type, CASE WHEN doc_type IS NULL THEN 'unsupported_type'
    WHEN length > CASE doc_type WHEN 'pdf' THEN 52428800 WHEN 'docx' THEN 20971520 ELSE 5242880 END THEN 'too_large'
    WHEN doc_type = 'pdf' AND doc_id % 3 = 0 THEN 'unreadable' WHEN doc_type = 'pdf' AND doc_id % 150 > 100 THEN 'too_many_pages' END AS reason FROM f""")
def admit_documents(spark, sf):
    """Documents as files whose size and pages follow from the text's length and number."""
    d = c("doc_id")
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".md", ".exe"))), (d % 4 + 1).cast("int"))
    files = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/"), d.cast("string"), ending).alias("path"),
                                                    (c("n_chars") * 10_000).alias("length"))
    out = images.admit_documents(files.select("path", "length"), files.select("path", (d % 150).alias("pages")),
                                 files.filter("doc_id % 3 = 0").select("path"))
    return out.select("path", "doc_type", "reason")


@query("skip_low_confidence", f"WITH {REGIONS} SELECT page_no, idx FROM regions_fx WHERE confidence >= 0.7")
def skip_low_confidence(spark, sf):
    """F7."""
    return filters.skip_low_confidence(fx.regions(spark, sf), 0.7).select("page_no", "idx")


@query("document_ids", "SELECT doc_id, sha256(concat(source, '-', CAST(n_chars AS VARCHAR))) AS id FROM documents")
def document_ids(spark, sf):
    """X17."""
    return fx.table(spark, sf, "documents").select("doc_id", lifecycle.document_id(c("source"), c("n_chars")).alias("id"))


@query("masked_emails", f"WITH {USERS} SELECT user_id, sha256(lower(email)) AS key FROM users_fx")
def masked_emails(spark, sf):
    """X20."""
    return fx.users(spark, sf).select("user_id", metering.masked_email(c("email")).alias("key"))
