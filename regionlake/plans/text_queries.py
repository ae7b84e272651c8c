"""Queries over text items, model replies and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import latex as lx
from ..operators import corpus
from .registry import REPLIES, REVISIONS, TEXT_ITEMS, query

c = F.col


@query("text_items", f"WITH {TEXT_ITEMS} SELECT doc_id, line_no, str, x, y, width, height, font, is_math_font FROM text_items_fx")
def text_items(spark, sf):
    return fx.text_items(spark, sf)


@query("page_text", f"""WITH {TEXT_ITEMS} SELECT doc_id, CAST(0 AS BIGINT) AS part_no, string_agg(str, ' ' ORDER BY line_no) AS text
  FROM text_items_fx GROUP BY doc_id""")
def page_text(spark, sf):
    return corpus.page_text(fx.text_items(spark, sf))


_FEATURES = r""",
  f AS (SELECT *, len(regexp_extract_all(str, '[=+\-*/^_]|\\[a-zA-Z]+|[∑∫∞≈≠≤≥√]')) AS math_symbols,
    len(regexp_extract_all(str, '[α-ωΑ-Ω]')) AS greek_count FROM text_items_fx)"""


@query("text_features", rf"""WITH {TEXT_ITEMS}{_FEATURES} SELECT doc_id, line_no, CAST(math_symbols AS INT) AS math_symbols, CAST(greek_count AS INT) AS greek_count,
  is_math_font AS math_font, contains(str, '/') AS has_fraction, regexp_matches(str, '[_^]') AS has_scripts, contains(str, '√') AS has_root,
  regexp_matches(str, '[∫∑]') AS has_large_ops, regexp_matches(str, '[()\[\]{{}}]') AS has_brackets,
  CASE WHEN is_math_font THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM f""")
def text_features(spark, sf):
    return corpus.text_features(fx.text_items(spark, sf)).select(
        "doc_id", "line_no", "math_symbols", "greek_count", "math_font", "has_fraction", "has_scripts", "has_root",
        "has_large_ops", "has_brackets", "confidence")


@query("detect_text", rf"""WITH {TEXT_ITEMS}{_FEATURES},
  b AS (SELECT *, greatest(width, 20) AS bw, greatest(height, 10) AS bh FROM f WHERE is_math_font OR math_symbols > 0 OR greek_count > 0),
  p AS (SELECT *, greatest(0, floor(x - 6)) AS x0, greatest(0, floor(y - bh - 6)) AS y0 FROM b)
  SELECT doc_id, line_no, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CAST(least(612 - x0, ceil(bw + 12)) AS DOUBLE) AS w,
    CAST(least(792 - y0, ceil(bh + 12)) AS DOUBLE) AS h, 'inline' AS kind FROM p""")
def detect_text(spark, sf):
    return corpus.detect_text(fx.text_items(spark, sf), (0, 0, 612, 792)).select(
        "doc_id", "line_no", "x", "y", "w", "h", "kind")


@query("page_math_hint", rf"""WITH {TEXT_ITEMS}, t AS (SELECT doc_id, string_agg(str, ' ' ORDER BY line_no) AS s FROM text_items_fx GROUP BY doc_id)
  SELECT doc_id, regexp_matches(s, '[∑∫∞≈≠≤≥√]') OR regexp_matches(s, '[A-Za-z0-9]\s*=\s*[A-Za-z0-9]') OR regexp_matches(s, '[A-Za-z0-9]\s*\^\s*\d')
    OR regexp_matches(s, '[A-Za-z0-9]\s*_\s*\d') OR regexp_matches(s, '_\{{[^}}]+\}}')
    OR regexp_matches(s, '\\(frac|sum|int|sqrt|alpha|beta|gamma|delta|theta|pi|sigma|mu|nu|rho|lambda|cdot|times|leq|geq|neq|approx)') AS hint FROM t""")
def page_math_hint(spark, sf):
    return corpus.page_math_hint(fx.text_items(spark, sf))


_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+\\z', '', 'g')"


def _sql_normalize(e: str) -> str:
    out = f"regexp_replace({e}, '^\\$+|\\$+\\z', '', 'g')"
    for sym, cmd in lx.SYMBOL_COMMANDS.items():
        out = f"replace({out}, '{sym}', ' \\{cmd} ')"
    for sym, text in lx.SYMBOL_TEXT.items():
        out = "replace(" + out + f", '{sym}', '" + text.replace("'", "''") + "')"
    return _sql_strip(f"regexp_replace({out}, '{_WS}+', ' ', 'g')")


_EXTRACT = r"""CASE
  WHEN regexp_matches(reply, '```latex\n?((?s:.*?))\n?```') THEN """ + _sql_strip(r"regexp_extract(reply, '```latex\n?((?s:.*?))\n?```', 1)") + r"""
  WHEN regexp_matches(reply, '```\n?((?s:.*?))\n?```') THEN """ + _sql_strip(r"regexp_extract(reply, '```\n?((?s:.*?))\n?```', 1)") + r"""
  WHEN regexp_matches(reply, '\$\$((?s:.*?))\$\$') THEN """ + _sql_strip(r"regexp_extract(reply, '\$\$((?s:.*?))\$\$', 1)") + r"""
  WHEN regexp_matches(reply, '\$((?s:.*?))\$') THEN """ + _sql_strip(r"regexp_extract(reply, '\$((?s:.*?))\$', 1)") + r"""
  ELSE """ + _sql_strip("reply") + " END"
_CLEAN = f"e AS (SELECT *, {_EXTRACT} AS extracted FROM replies_fx), n AS (SELECT *, {_sql_normalize('extracted')} AS latex FROM e)"


@query("clean_latex", f"WITH {REPLIES}, e AS (SELECT id, {_EXTRACT} AS extracted FROM replies_fx) SELECT id, extracted FROM e")
def clean_latex(spark, sf):
    return fx.replies(spark, sf).select("id", lx.extract_latex(c("reply")).alias("extracted"))


@query("clean_latex_variants")
def clean_latex_variants(spark, sf):
    return fx.replies(spark, sf).select(
        "id", lx.extract_all_math(c("reply")).alias("all_math"), lx.unwrap_model_output(c("reply")).alias("unwrapped"))


@query("normalize_latex", f"WITH {REPLIES} SELECT id, {_sql_normalize('reply')} AS latex FROM replies_fx")
def normalize_latex(spark, sf):
    return fx.replies(spark, sf).select("id", lx.normalize_latex(c("reply")).alias("latex"))


def _sql_text_to_latex(e: str) -> str:
    for sym, cmd in lx.TEXT_COMMANDS.items():
        e = f"replace({e}, '{sym}', '\\{cmd}')"
    return f"regexp_replace({e}, '(\\w+)/(\\w+)', '\\\\frac{{\\1}}{{\\2}}', 'g')"


@query("text_to_latex", f"WITH {REPLIES} SELECT id, {_sql_text_to_latex('reply')} AS latex FROM replies_fx")
def text_to_latex(spark, sf):
    return fx.replies(spark, sf).select("id", lx.text_to_latex(c("reply")).alias("latex"))


def _sql_balance(e: str, a: str, b: str) -> str:
    marks = f"regexp_extract_all({e}, '[\\{a}\\{b}]')"
    walk = f"list_transform({marks}, lambda m: CASE WHEN m = '{a}' THEN 1 ELSE -1 END)"
    return (f"(coalesce(list_sum({walk}), 0) = 0 AND len(list_filter(range(1, len({marks}) + 1), "
            f"lambda k: list_sum(({walk})[1:k]) < 0)) = 0)")


def _sql_valid(e: str) -> str:
    tail = f"regexp_replace({e}, '^(?s:.*)\\\\end\\{{[^}}]+\\}}', '')"
    return (f"({_sql_balance(e, '{', '}')} AND {_sql_balance(e, '[', ']')} AND {_sql_balance(e, '(', ')')} "
            f"AND NOT regexp_matches({e}, '\\\\[a-zA-Z]+\\s*\\{{[^}}]*\\z') AND NOT contains({e}, '$$') "
            f"AND NOT regexp_matches({tail}, '\\\\begin\\{{[^}}]+\\}}'))")


@query("validate_latex", f"WITH {REPLIES} SELECT id, {_sql_valid('reply')} AS valid FROM replies_fx")
def validate_latex(spark, sf):
    return fx.replies(spark, sf).select("id", lx.validate_latex(c("reply")).alias("valid"))


@query("validate_markdown", rf"""WITH {REPLIES}, t AS (SELECT id, CASE WHEN regexp_matches(reply, '\$[^$]+\$') OR regexp_matches(reply, '\$\$(?s:.+?)\$\$')
  THEN {_sql_strip("replace(reply, '$', '')")} ELSE reply END AS m FROM replies_fx) SELECT id, {_sql_valid('m')} AS valid FROM t""")
def validate_markdown(spark, sf):
    return fx.replies(spark, sf).select("id", lx.validate_markdown(c("reply")).alias("valid"))


@query("convert_markdown_mathml", f"""WITH {REPLIES} SELECT id, concat('$$', chr(10), {_sql_strip('reply')}, chr(10), '$$') AS markdown,
  concat('<math xmlns="http://www.w3.org/1998/Math/MathML">', chr(10), '  <annotation encoding="application/x-tex">',
    replace(replace(replace(replace(replace(reply, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
    '</annotation>', chr(10), '</math>') AS mathml FROM replies_fx""")
def convert_markdown_mathml(spark, sf):
    return fx.replies(spark, sf).select(
        "id", lx.to_markdown(c("reply")).alias("markdown"), lx.to_mathml(c("reply")).alias("mathml"))


@query("convert_unicode")
def convert_unicode(spark, sf):
    return corpus.convert_corpus(fx.replies(spark, sf), "unicode", "reply").select("id", "content")


_LIKELY = ("({s} <> '' AND NOT (" + " OR ".join(
    "contains(lower({s}), '" + p.replace("'", "''") + "')" for p in lx.REFUSALS)
    + r") AND (regexp_matches({s}, '[\\^_=+\-*/]|\d') OR regexp_matches({s}, '^[^\s]{{1,3}}\z')))")


@query("reject_non_latex", f"""WITH {REPLIES}, t AS (SELECT provider, {_sql_strip('reply')} AS s FROM replies_fx),
  v AS (SELECT provider, {_LIKELY.format(s='s')} AS ok FROM t)
  SELECT provider, count(*) AS n, count(*) FILTER (ok) AS accepted FROM v GROUP BY provider""")
def reject_non_latex(spark, sf):
    return fx.replies(spark, sf).withColumn("ok", lx.likely_latex(c("reply"))).groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("accepted"))


_UNKNOWN = ("list_filter(list_distinct(regexp_extract_all(latex, '\\\\[a-zA-Z]+')), lambda k: NOT list_contains(["
            + ", ".join("'\\" + cmd + "'" for cmd, _ in lx.COMMAND_CHARS.items()) + ", '\\frac'], k))")


@query("corpus_report", f"""WITH {REPLIES}, {_CLEAN},
  v AS (SELECT source, {_LIKELY.format(s=_sql_strip('latex'))} AS ok, {_sql_valid('latex')} AS valid, len({_UNKNOWN}) AS u FROM n)
  SELECT source, count(*) AS n, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (NOT valid) AS invalid, CAST(sum(u) AS BIGINT) AS unknown_commands
  FROM v GROUP BY source""")
def corpus_report(spark, sf):
    return corpus.corpus_report(corpus.clean_corpus(fx.replies(spark, sf)), ["source"])


@query("unknown_commands", f"""WITH {REPLIES}, {_CLEAN}, u AS (SELECT source, unnest({_UNKNOWN}) AS command FROM n)
  SELECT source, command, count(*) AS n FROM u GROUP BY source, command""")
def unknown_commands(spark, sf):
    return corpus.unknown_command_report(corpus.clean_corpus(fx.replies(spark, sf)), ["source"])


@query("diff_pairs")
def diff_pairs(spark, sf):
    return corpus.diff_pairs(fx.revisions(spark, sf)).select(
        "conv_id", "turn", F.array_join(F.transform("diff", lambda s: F.concat(
            F.substring(s["type"], 1, 1), s["text"])), "|").alias("diff"))


@query("diff_bounds", f"""WITH {REVISIONS} SELECT conv_id, turn, length(original) AS original_chars, length(modified) AS modified_chars,
  true AS consistent FROM revisions_fx""")
def diff_bounds(spark, sf):
    """Counts add up to both lengths, and the edit distance lies between its bounds."""
    rows = corpus.diff_stats(fx.revisions(spark, sf))
    edits, more = F.levenshtein("original", "modified"), F.greatest("added", "removed")
    good = ((c("unchanged") + c("removed") == F.length("original")) & (c("unchanged") + c("added") == F.length("modified"))
            & (edits >= more) & (edits <= c("added") + c("removed")))
    return rows.select("conv_id", "turn", F.length("original").cast("bigint").alias("original_chars"),
                       F.length("modified").cast("bigint").alias("modified_chars"), good.alias("consistent"))


@query("revision_churn")
def revision_churn(spark, sf):
    return corpus.revision_churn(fx.revisions(spark, sf), ["conv_id"])
