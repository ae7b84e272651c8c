"""Documents made from recognitions: LaTeX, markdown, text, JSON and numbered lists.

An export is a table of pieces: a header, one piece per formula in reading order, a footer.  `assemble` joins the pieces
of a document into parts of bounded length; an ordinary document is the single part 0, and the parts of a huge one follow
each other, so no document has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex as lx
from ..lineage import cut
from ..operators.ordered import has_hot_group, scan
from ..operators.regions import reading_order
from ..params import MAX_WINDOW_ROWS

c = F.col
NAME = "regionlake"


def _lines(*parts) -> Column:
    """Non-null parts, one per line."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _percent() -> Column:
    return F.format_string("%.1f", c("confidence") * 100)


def _ordered(df: DataFrame, doc: str, include_failures: bool, per_page: bool, hot: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Formulas with their number, and per document the counts and the first page.

    Counts are one row a document and serve header, footer and body, so they are written once.
    """
    rows = df.withColumn("success", c("status") == "done")
    totals = cut(rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("_total"), F.count_if(F.lit(include_failures) | c("success")).alias("_valid"),
        F.min(F.when(F.lit(include_failures) | c("success"), c("page_no"))).alias("_first_page")))
    kept = rows if include_failures else rows.filter("success")
    # pages are parts of documents, so one question about documents covers both
    if hot is None:
        hot = not totals.filter(c("_total") > MAX_WINDOW_ROWS).isEmpty()
    if not hot:  # pages and parts of a document stay where the document is, so its rows move once
        kept = kept.repartition(doc)
    placed = reading_order(kept, page=(doc, "page_no"), hot=hot)
    numbered = placed.withColumn("_number", c("position")) if per_page else scan(
        placed, [doc], ["page_no", "position"], number="_number", hot=hot)
    return numbered, totals


def _pieces(doc: str, header: DataFrame, body: DataFrame, footer: DataFrame | None) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    out = header.select(doc, F.lit(0).alias("section"), zero.alias("page_no"), F.lit(0).alias("position"), "piece")
    out = out.unionByName(body.select(doc, F.lit(1).alias("section"), c("page_no").cast("bigint").alias("page_no"),
                                      c("position").cast("int").alias("position"), "piece"))
    if footer is not None:
        out = out.unionByName(footer.select(
            doc, F.lit(2).alias("section"), zero.alias("page_no"), F.lit(0).alias("position"), "piece"))
    return out


def _with_section(body: DataFrame, totals: DataFrame, doc: str, piece: Column, heading: Column, grouped: bool) -> DataFrame:
    if not grouped:
        return body.withColumn("piece", piece)
    gap = F.when(c("page_no") != c("_first_page"), F.lit(""))
    title = F.when(c("position") == 1, _lines(gap, heading, ""))
    return body.join(totals.select(doc, "_first_page"), doc).withColumn("piece", _lines(title, piece))


def export_latex(df: DataFrame, doc: str = "doc_id", group_by_page: bool = False, comments: bool = False, title: str | None = None,
                 include_failures: bool = False, generated: str = "", hot: bool | None = None) -> DataFrame:
    """S6."""
    body, totals = _ordered(df, doc, include_failures, group_by_page, hot)
    head = [F.lit(f"% LaTeX Document - Exported from {NAME}"), F.lit(f"% Generated: {generated}"),
            F.concat(F.lit("% Total Formulas: "), c("_total")), "", "\\documentclass{article}", "\\usepackage{amsmath}",
            "\\usepackage{amssymb}", "\\usepackage{amsfonts}", ""]
    if title:
        head += [f"\\title{{{title}}}", f"\\author{{{NAME}}}", f"\\date{{{generated}}}", ""]
    head += ["\\begin{document}", ""] + (["\\maketitle", ""] if title else [])
    note = F.when(F.lit(comments), _lines(
        F.concat(F.lit("% Formula "), c("_number"), F.lit(" - Page "), c("page_no")),
        F.concat(F.lit("% Type: "), c("kind"), F.lit(", Confidence: "), _percent(), F.lit("%"))))
    shown = (F.when(~c("success"), F.concat(F.lit("% ERROR: "), F.coalesce("error", F.lit("Recognition failed"))))
             .when(c("kind").isin("display", "numbered"), _lines("\\begin{equation}", F.concat(F.lit("  "), c("latex")), "\\end{equation}"))
             .otherwise(F.concat(F.lit("$"), c("latex"), F.lit("$"))))
    heading = F.concat(F.lit("\\section*{Page "), c("page_no"), F.lit("}"))
    body = _with_section(body, totals, doc, _lines(note, shown, ""), heading, group_by_page)
    end = _lines(F.when(F.lit(group_by_page) & (c("_valid") > 0), F.lit("")), "\\end{document}")
    return _pieces(doc, totals.withColumn("piece", _lines(*head)), body, totals.withColumn("piece", end))


def export_markdown(df: DataFrame, doc: str = "doc_id", group_by_page: bool = False, comments: bool = False,
                    title: str = "Exported Formulas", include_failures: bool = False, generated: str = "", hot: bool | None = None) -> DataFrame:
    """S7."""
    body, totals = _ordered(df, doc, include_failures, group_by_page, hot)
    head = _lines(f"# {title}", "", f"> Generated by {NAME} on {generated}", F.concat(F.lit("> Total Formulas: "), c("_total")), "")
    note = F.when(F.lit(comments), _lines(
        F.concat(F.lit("<!-- Formula "), c("_number"), F.lit(" - Page "), c("page_no"), F.lit(" -->")),
        F.concat(F.lit("<!-- Type: "), c("kind"), F.lit(", Confidence: "), _percent(), F.lit("% -->"))))
    markdown = F.coalesce("markdown", lx.to_markdown(c("latex"), c("kind") == "inline"))
    shown = F.when(~c("success"), F.concat(
        F.lit("> **Error**: "), F.coalesce("error", F.lit("Recognition failed")))).otherwise(markdown)
    heading = F.concat(F.lit("## Page "), c("page_no"))
    body = _with_section(body, totals, doc, _lines(note, shown, ""), heading, group_by_page)
    foot = totals.filter("_valid > 0").withColumn("piece", F.lit("")) if group_by_page else None
    return _pieces(doc, totals.withColumn("piece", head), body, foot)


def export_text(df: DataFrame, doc: str = "doc_id", include_failures: bool = False, generated: str = "", hot: bool | None = None) -> DataFrame:
    """S8."""
    body, totals = _ordered(df, doc, include_failures, False, hot)
    head = _lines(f"Exported Formulas - {NAME}", f"Generated: {generated}", F.concat(F.lit("Total Formulas: "), c("_total")),
                  "", "=" * 60, "")
    result = F.when(c("success"), _lines("LaTeX:", c("latex"))).otherwise(
        F.concat(F.lit("Error: "), F.coalesce("error", F.lit("Recognition failed"))))
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    piece = _lines(
        F.concat(F.lit("Formula "), c("_number")), F.concat(F.lit("Page: "), c("page_no")), F.concat(F.lit("Type: "), c("kind")),
        F.concat(F.lit("Position: ("), number(c("x")), F.lit(", "), number(c("y")), F.lit(")")), result, "", "-" * 60, "")
    return _pieces(doc, totals.withColumn("piece", head), body.withColumn("piece", piece), None)


def export_json(df: DataFrame, doc: str = "doc_id", include_failures: bool = False, include_metadata: bool = False,
                generated: str = "", hot: bool | None = None) -> DataFrame:
    """One JSON document; pieces are lines of it."""
    body, totals = _ordered(df, doc, include_failures, False, hot)
    head = F.concat(F.lit('{"metadata":'), F.to_json(F.struct(
        F.lit(generated).alias("exportDate"), c("_valid").alias("totalFormulas"), F.lit(NAME).alias("generator"),
        F.lit("2.0").alias("version"))), F.lit(',"formulas":['))
    markdown = F.when(c("success"), lx.to_markdown(c("latex"), c("kind") == "inline"))
    fields = [c("id"), c("page_no").alias("pageNumber"), c("kind").alias("type"),
              F.struct("x", "y", c("w").alias("width"), c("h").alias("height")).alias("boundingBox"),
              c("latex").alias("latexContent"), markdown.alias("markdownContent"),
              c("success").alias("recognitionSuccess"), c("error").alias("recognitionError"), c("confidence")]
    if include_metadata:
        fields.append(c("elapsed_ms").alias("recognitionTime"))
    comma = F.when(c("_number") < c("_valid"), ",").otherwise("")
    body = body.join(totals.select(doc, "_valid"), doc).withColumn("piece", F.concat(F.to_json(F.struct(*fields)), comma))
    return _pieces(doc, totals.withColumn("piece", head), body, totals.withColumn("piece", F.lit("]}")))


def export_numbered(df: DataFrame, fmt: str = "latex", include_numbers: bool = True, doc: str = "doc_id",
                    order: str = "position", index: str | None = None) -> DataFrame:
    """List of formulas in a format, numbered by the given index or by position."""
    rows = scan(df, [doc], [order], number="_n")
    num = F.coalesce(c(index), c("_n")) if index else c("_n")
    body = lx.convert(c("latex"), fmt)
    if include_numbers:
        mark = {"markdown": ("### 公式 ", "\n\n"), "mathml": ("<!-- 公式 ", " -->\n")}.get(fmt, ("% 公式 ", "\n"))
        body = F.concat(F.lit(mark[0]), num.cast("string"), F.lit(mark[1]), body, F.lit("\n"))
    return rows.select(doc, F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("page_no"),
                       c("_n").cast("int").alias("position"), body.alias("piece"))


def assemble(pieces: DataFrame, doc: str = "doc_id", rows_per_part: int = 10_000, source: DataFrame | None = None,
             json: bool = False, hot: bool | None = None) -> DataFrame:
    """Documents as (doc, part_no, content).

    With ``json`` every part is valid JSON by itself: parts after the first begin with their number and a list of formulas
    of their own, and each part closes its list.
    ``source`` is the table the pieces were made from; a document has at most two pieces more than rows there, so asking
    it for huge documents is cheaper than asking the pieces.  ``hot`` passes on an earlier answer.
    """
    if hot is None and source is not None:
        hot = has_hot_group(source, [doc], MAX_WINDOW_ROWS)
    rows = scan(pieces, [doc], ["section", "page_no", "position"], number="_n", hot=hot)
    return rows.groupBy(doc, F.floor((c("_n") - 1) / rows_per_part).alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "piece"))).alias("_l"), F.max("section").alias("_last")).select(
        doc, "part_no", "_last", F.array_join(F.transform("_l", lambda r: r["piece"]), "\n").alias("content")).transform(
        _closed if json else lambda parts: parts.drop("_last"))


def _closed(parts: DataFrame) -> DataFrame:
    """Parts of a JSON document, each closed."""
    head = F.when(c("part_no") > 0, F.concat(F.lit('{"part":'), c("part_no"), F.lit(',"formulas":[')))
    last = c("_last") == 2
    body = F.when(last, F.regexp_replace("content", r",\n(?=\]\}$)", "\n")).otherwise(F.regexp_replace("content", ",$", ""))
    return parts.withColumn("content", F.concat_ws("\n", head, body, F.when(~last, F.lit("]}")))).drop("_last")


def write_export(documents: DataFrame, path: str, doc: str = "doc_id") -> None:
    """Text files in order of documents and parts, from file to file and within each.

    Files are ranges of (document, part), as many as the size asks for, so a huge document is written by several tasks.
    """
    documents = cut(documents)  # ranges are chosen from a sample, which would make all documents a second time
    documents.repartitionByRange(doc, "part_no").sortWithinPartitions(doc, "part_no").select("content").write.mode("overwrite").text(path)
