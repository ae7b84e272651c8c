"""Queries that make documents; a document is a block of a hundred pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..lineage import scratch_path
from ..operators import regions as ops
from ..operators.ordered import has_hot_group
from ..params import MAX_WINDOW_ROWS
from ..sources import exports
from .registry import RECOGNITIONS, query

c = F.col


def _recognised(spark, sf):
    r = fx.regions(spark, sf).withColumn("doc_id", F.floor(c("page_no") / 100)).withColumn(
        "markdown", F.lit(None).cast("string"))
    return ops.attach_recognitions(r, fx.recognitions(spark, sf), partitions=fx.region_partitions(spark, sf)).filter(
        "status IN ('done', 'error')")


def _hot(spark, sf):
    """Whether a document has very many formulas, asked of the table they come from."""
    doc = F.floor(c("l_orderkey") / 100).alias("doc_id")
    return has_hot_group(fx.table(spark, sf, "lineitem").select(doc), ["doc_id"], MAX_WINDOW_ROWS)


_BASE = f"""WITH {RECOGNITIONS},
  j AS (SELECT r.*, page_no // 100 AS doc_id, status, latex, error, elapsed_ms FROM regions_fx r JOIN recognitions_fx q USING (id, page_no, idx) WHERE status IN ('done', 'error')),
  a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_no ORDER BY y, id) > 20 THEN 1 ELSE 0 END AS brk FROM j),
  b AS (SELECT *, sum(brk) OVER (PARTITION BY page_no ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS line FROM a),
  o AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY line, x, id) AS pos FROM b),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS num FROM o)"""
_DONE = _BASE.replace("CASE WHEN y - lag", "CASE WHEN y - lag").replace("FROM j),\n  b AS", "FROM j WHERE status = 'done'),\n  b AS")


@query("export_markdown", _BASE + """, h AS (SELECT doc_id, count(*) AS total, min(page_no) AS p0 FROM j GROUP BY doc_id),
  pc AS (SELECT doc_id, page_no, pos, concat(
      CASE WHEN pos = 1 THEN concat(CASE WHEN page_no <> p0 THEN chr(10) ELSE '' END, '## Page ', page_no, chr(10), chr(10)) ELSE '' END,
      '<!-- Formula ', pos, ' - Page ', page_no, ' -->', chr(10), '<!-- Type: ', kind, ', Confidence: ', printf('%.1f', confidence * 100), '% -->', chr(10),
      CASE WHEN status = 'error' THEN concat('> **Error**: ', error) WHEN kind = 'inline' THEN concat('$', latex, '$')
        ELSE concat('$$', chr(10), latex, chr(10), '$$') END, chr(10)) AS piece FROM o JOIN h USING (doc_id))
  SELECT doc_id, CAST(0 AS BIGINT) AS part_no, concat('# Report', chr(10), chr(10), '> Generated by regionlake on 2024-01-20', chr(10), '> Total Formulas: ', any_value(total), chr(10), chr(10),
    string_agg(piece, chr(10) ORDER BY page_no, pos), chr(10)) AS content FROM pc JOIN h USING (doc_id) GROUP BY doc_id""")
def export_markdown(spark, sf):
    df, hot = _recognised(spark, sf), _hot(spark, sf)
    return exports.assemble(exports.export_markdown(
        df, group_by_page=True, comments=True, title="Report", include_failures=True, generated="2024-01-20", hot=hot), hot=hot)


@query("export_latex", _DONE + """, h AS (SELECT doc_id, count(*) AS total FROM j GROUP BY doc_id),
  pc AS (SELECT doc_id, string_agg(CASE WHEN kind = 'inline' THEN concat('$', latex, '$', chr(10))
      ELSE concat('\\begin{equation}', chr(10), '  ', latex, chr(10), '\\end{equation}', chr(10)) END, chr(10) ORDER BY num) AS body FROM n GROUP BY doc_id)
  SELECT doc_id, CAST(0 AS BIGINT) AS part_no, concat_ws(chr(10), '% LaTeX Document - Exported from regionlake', '% Generated: 2024-01-20', concat('% Total Formulas: ', total), '',
    '\\documentclass{article}', '\\usepackage{amsmath}', '\\usepackage{amssymb}', '\\usepackage{amsfonts}', '', '\\begin{document}', '', body, '\\end{document}') AS content
  FROM h LEFT JOIN pc USING (doc_id)""".replace("\\\\", "\\"))
def export_latex(spark, sf):
    df, hot = _recognised(spark, sf), _hot(spark, sf)
    return exports.assemble(exports.export_latex(df, generated="2024-01-20", hot=hot), hot=hot)


@query("export_text", _DONE + """, h AS (SELECT doc_id, count(*) AS total FROM j GROUP BY doc_id),
  pc AS (SELECT doc_id, string_agg(concat_ws(chr(10), concat('Formula ', num), concat('Page: ', page_no), concat('Type: ', kind),
      concat('Position: (', CAST(x AS INT), ', ', CAST(y AS INT), ')'), 'LaTeX:', latex, '', repeat('-', 60), ''), chr(10) ORDER BY num) AS body FROM n GROUP BY doc_id)
  SELECT doc_id, CAST(0 AS BIGINT) AS part_no, concat_ws(chr(10), 'Exported Formulas - regionlake', 'Generated: 2024-01-20', concat('Total Formulas: ', total), '', repeat('=', 60), '', body) AS content
  FROM h LEFT JOIN pc USING (doc_id)""")
def export_text(spark, sf):
    df, hot = _recognised(spark, sf), _hot(spark, sf)
    return exports.assemble(exports.export_text(df, generated="2024-01-20", hot=hot), hot=hot)


@query("export_json", _DONE + """, h AS (SELECT doc_id, count(*) FILTER (status = 'done') AS valid FROM j GROUP BY doc_id),
  pc AS (SELECT doc_id, string_agg(concat('{"id":"', id, '","pageNumber":', page_no, ',"type":"', kind, '","boundingBox":{"x":', x::DOUBLE, ',"y":', y::DOUBLE,
      ',"width":', w::DOUBLE, ',"height":', h::DOUBLE, '},"latexContent":"', latex, '","markdownContent":"', CASE WHEN kind = 'inline' THEN concat('$', latex, '$')
      ELSE concat('$$\\n', latex, '\\n$$') END, '","recognitionSuccess":true,"confidence":', confidence::DOUBLE, ',"recognitionTime":', elapsed_ms, '}'),
      concat(',', chr(10)) ORDER BY num) AS body FROM n GROUP BY doc_id)
  SELECT doc_id, CAST(0 AS BIGINT) AS part_no, concat_ws(chr(10), concat('{"metadata":{"exportDate":"2024-01-20","totalFormulas":', valid,
    ',"generator":"regionlake","version":"2.0"},"formulas":['), body, ']}') AS content FROM h LEFT JOIN pc USING (doc_id)""")
def export_json(spark, sf):
    df, hot = _recognised(spark, sf), _hot(spark, sf)
    return exports.assemble(exports.export_json(df, include_metadata=True, generated="2024-01-20", hot=hot), hot=hot, json=True)


@query("export_json_parts", _DONE + """ SELECT doc_id, count(*) AS n_formulas, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, true AS valid FROM n GROUP BY doc_id""")
def export_json_parts(spark, sf):
    """S9 in parts of fifty pieces: every part is a document of its own, and together they have each formula once."""
    df, hot = _recognised(spark, sf), _hot(spark, sf)
    parts = exports.assemble(exports.export_json(df, include_metadata=True, hot=hot), rows_per_part=50, hot=hot, json=True)
    path = scratch_path(spark, "json")
    exports.write_export(parts.withColumn("content", F.regexp_replace("content", "\n", " ")), path)
    shape = "metadata struct<totalFormulas:bigint>, formulas array<struct<id:string,pageNumber:bigint,recognitionTime:bigint>>"
    read = spark.read.text(path).select(F.from_json("value", shape).alias("d"))
    rows = read.select(c("d.formulas").isNotNull().alias("valid"), F.explode_outer("d.formulas").alias("f"))
    return rows.groupBy(F.floor(c("f.pageNumber") / 100).alias("doc_id")).agg(
        F.count("f.id").alias("n_formulas"), F.sum("f.recognitionTime").alias("elapsed_ms"), F.bool_and("valid").alias("valid")).filter("doc_id IS NOT NULL")


@query("export_numbered", _DONE + """ SELECT doc_id, CAST(0 AS BIGINT) AS part_no,
  string_agg(concat('### 公式 ', num, chr(10), chr(10), '$$', chr(10), latex, chr(10), '$$', chr(10)), chr(10) ORDER BY num) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS num FROM j WHERE status = 'done') GROUP BY doc_id""")
def export_numbered(spark, sf):
    rows = _recognised(spark, sf).filter("status = 'done'")
    return exports.assemble(exports.export_numbered(rows, "markdown", order="id"))


@query("page_groups", _BASE + """ SELECT page_no, CAST(0 AS BIGINT) AS part_no, string_agg(id, ',' ORDER BY pos) AS ids FROM o GROUP BY page_no""")
def page_groups(spark, sf):
    """Ordered list of the formulas of a page, in parts of bounded length."""
    rows = ops.reading_order(_recognised(spark, sf))
    return rows.groupBy("page_no", F.floor((c("position") - 1) / 10_000).alias("part_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda r: r["id"]), ",").alias("ids"))
