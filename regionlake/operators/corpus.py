"""Jobs over text items and LaTeX corpora."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import latex as lx
from ..functions import scoring
from ..functions import textmath as tm
from ..functions.barrier import settle
from ..params import MAX_WINDOW_ROWS
from .ordered import has_hot_group, scan

c = F.col


def _edges(s):
    """First and last two characters of a text that are not white space."""

    def edge(cut):
        near = cut(F.regexp_replace(cut(s, 32), f"{lx.SPACE}+", ""), 2)
        whole = cut(F.regexp_replace(s, f"{lx.SPACE}+", ""), 2)
        return F.when((F.char_length(near) == 2) | (F.char_length(s) <= 32), near).otherwise(whole)

    return edge(lambda v, n: F.left(v, F.lit(n))), edge(lambda v, n: F.right(v, F.lit(n)))


def _subscript(text, gap: str):
    return text.contains("_") & (text.rlike(rf"[A-Za-z0-9]{gap}_{gap}\d") | text.rlike(r"_\{[^}]+\}"))


def page_math_hint(items: DataFrame, page: Sequence[str] = ("doc_id",), order: str = "line_no",
                   limit: int = MAX_WINDOW_ROWS) -> DataFrame:
    """F8: whether the text of a page hints at mathematics, from its items (pages without text do not appear).

    The text of a page, its items joined by spaces, is never built.  Without white space every pattern but one has three
    characters, so an item is tested alone and where it meets the last two characters before it; the open-ended one,
    an underscore with a brace closed later, is a first and last position per page.
    """
    page = list(page)
    head, tail = _edges(c("str"))
    full = items.select(*page, order, "str", head.alias("_head"), tail.alias("_end")).filter("_head <> ''")
    # items only get fewer from here on, so their counts bound every group; items of white space only add nothing
    hot = has_hot_group(items, page, limit)
    near = scan(full, page, [order], previous={"_p1": "_end"}, hot=hot)
    near = scan(near, page, [order], previous={"_p2": "_p1"}, hot=hot)
    near = near.withColumn("_seam", F.concat(
        F.expr("right(concat(coalesce(_p2, ''), coalesce(_p1, '')), 2)"), c("_head")))
    text, gap = c("str"), f"{lx.SPACE}*"

    def spans(mark: str, after: str):
        inside = text.contains(mark) & text.rlike(rf"[A-Za-z0-9]{gap}\{mark}{gap}{after}")
        return inside | c("_seam").rlike(rf"[A-Za-z0-9]\{mark}{after}")

    signs = (
        reduce(lambda a, b: a | b, [text.contains(ch) for ch in tm.ONLY_MATH])
        | spans("=", "[A-Za-z0-9]") | spans("^", r"\d") | _subscript(text, gap) | c("_seam").rlike(r"[A-Za-z0-9]_\d")
        | (text.contains("\\") & text.rlike(tm.HINT_COMMANDS)))
    found = near.groupBy(*page).agg(
        F.bool_or(signs).alias("_hit"),
        F.min(F.when(c("str").contains("_{") & c("str").rlike(r"_\{[^}]*\z"), c(order))).alias("_open"),
        F.max(F.when(c("str").contains("}"), c(order))).alias("_close"))
    hint = found.select(*page, (c("_hit") | F.coalesce(c("_open") < c("_close"), F.lit(False))).alias("hint"))
    return items.select(*page).distinct().join(hint, page, "left").withColumn("hint", F.coalesce("hint", F.lit(False)))


def page_text(items: DataFrame, page: Sequence[str] = ("doc_id",), order: str = "line_no", part_rows: int = 10_000) -> DataFrame:
    """S3: items joined by spaces, in parts of bounded length (part_no 0 is the whole text of an ordinary page)."""
    page = list(page)
    rows = scan(items.filter("str <> ''"), page, [order], number="_n")
    parts = rows.groupBy(*page, F.floor((c("_n") - 1) / part_rows).alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "str"))).alias("_l"))
    return parts.select(*page, "part_no", F.array_join(F.transform("_l", lambda r: r["str"]), " ").alias("text"))


def text_features(items: DataFrame) -> DataFrame:
    """X4 for a table of text items (str, is_math_font)."""
    return items.withColumns(tm.text_features(c("str"), c("is_math_font")))


def detect_text(items: DataFrame, tile: tuple | None = None) -> DataFrame:
    """X4 + X5: items with a mathematical sign, Greek letter or font, as inline regions with boxes.

    Items carry their tile (tile_x, tile_y, tile_w, tile_h) or share the one ``tile``.
    """
    return text_boxes(math_items(items), tile)


def math_items(items: DataFrame) -> DataFrame:
    """Features of the items with a mathematical sign, Greek letter or font."""
    return text_features(items).filter(c("math_font") | (c("math_symbols") > 0) | (c("greek_count") > 0))


def text_boxes(rows: DataFrame, tile: tuple | None = None) -> DataFrame:
    """`math_items` as inline regions with boxes within their tile."""
    box = [F.lit(float(v)) for v in tile] if tile else [c(n) for n in ("tile_x", "tile_y", "tile_w", "tile_h")]
    return rows.withColumns(tm.item_box(c("x"), c("y"), c("width"), c("height"), *box)).withColumn(
        "kind", F.lit("inline"))


def clean_corpus(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Cleaned and checked LaTeX of model replies: latex, likely, valid, markdown, text forms."""
    out = replies.withColumn("extracted", lx.extract_latex(c(reply)))
    out = settle(out.withColumn("latex", lx.normalize_latex(c("extracted"))))
    return settle(out.withColumns({
        "likely": lx.likely_latex(c("latex")), "valid": lx.validate_latex(c("latex")),
        "unknown": F.size(lx.unknown_commands(c("latex")))}))


def corpus_report(cleaned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rejects, invalid rows and unknown commands per source or provider."""
    return cleaned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~c("likely")).alias("rejected"),
        F.count_if(~c("valid")).alias("invalid"), F.sum("unknown").cast("bigint").alias("unknown_commands"))


def valid_results(df: DataFrame, column: str = "latex") -> DataFrame:
    """Rows whose LaTeX is likely and valid."""
    return settle(df).filter(lx.likely_latex(c(column)) & lx.validate_latex(c(column)))


def unknown_command_report(cleaned: DataFrame, by: Sequence[str]) -> DataFrame:
    return cleaned.select(*by, F.explode(lx.unknown_commands(c("latex"))).alias("command")).groupBy(
        *by, "command").agg(F.count(F.lit(1)).alias("n"))


def convert_corpus(df: DataFrame, fmt: str, column: str = "latex") -> DataFrame:
    """X13 as a table job."""
    return df.withColumn("content", lx.convert(c(column), fmt))


# ---------------------------------------------------------------- X12, G12
def _positions(text: str) -> dict[str, int]:
    """Bit set of the places of each character."""
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per character."""
    places, full, v = _positions(b), (1 << len(b)) - 1, (1 << len(b)) - 1
    for ch in a:
        u = v & places.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def segments(a: str, b: str) -> list[tuple[str, str]]:
    """Unchanged, removed and added runs that turn ``a`` into ``b``, within about 2 * sqrt(len(a)) bit rows of len(b)."""
    if a == b:
        return [("unchanged", a)]
    if not a or not b:
        return [("removed", a)] if a else [("added", b)]
    places, full = _positions(b), (1 << len(b)) - 1
    step = max(1, math.isqrt(len(a)))

    def rows_from(v: int, start: int) -> list[int]:
        out = []
        for ch in a[start:start + step]:
            u = v & places.get(ch, 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    # rows are kept at every ``step`` characters only, and those between made again on the way back
    kept = [full]
    for start in range(0, len(a) - step, step):
        kept.append(rows_from(kept[-1], start)[-1])
    common, i, j = [], len(a), len(b)
    block, rows = -1, []
    while i and j:
        if a[i - 1] == b[j - 1]:
            common.append(a[i - 1])
            i, j = i - 1, j - 1
            continue
        if (i - 1) // step != block:
            block = (i - 1) // step
            rows = rows_from(kept[block], block * step)
        if (rows[(i - 1) % step] >> (j - 1)) & 1:  # no gain from column j: the match lies further left
            j -= 1
        else:
            i -= 1
    common.reverse()
    marks: list[list[str]] = []

    def put(kind: str, text: str) -> None:
        if text and marks and marks[-1][0] == kind:
            marks[-1][1] += text
        elif text:
            marks.append([kind, text])

    i = j = 0
    for ch in common:
        at_a, at_b = a.index(ch, i), b.index(ch, j)
        put("removed", a[i:at_a])
        put("added", b[j:at_b])
        put("unchanged", ch)
        i, j = at_a + 1, at_b + 1
    put("removed", a[i:])
    put("added", b[j:])
    return [tuple(m) for m in marks]


@F.pandas_udf(T.IntegerType())
def _common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b)], dtype="int32")


_SEGMENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])


SEGMENTS_AT_ONCE = 20_000


def _segment_pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Segments of pairs; they leave in pieces, as those of a whole batch of pairs may take gigabytes."""
    for a, b in batches:
        out, held = [], 0
        for x, y in zip(a, b):
            out.append([{"type": t, "text": s} for t, s in segments(x, y)])
            held += len(out[-1])
            if held > SEGMENTS_AT_ONCE:
                yield pd.Series(out)
                out, held = [], 0
        if out:
            yield pd.Series(out)


@F.pandas_udf(T.ArrayType(_SEGMENT))
def _segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from _segment_pieces(batches)


def diff_pairs(pairs: DataFrame, original: str = "original", modified: str = "modified") -> DataFrame:
    """Segments between two versions of a text."""
    return pairs.withColumn("diff", _segments(F.coalesce(original, F.lit("")), F.coalesce(modified, F.lit(""))))


def diff_stats(pairs: DataFrame, original: str = "original", modified: str = "modified") -> DataFrame:
    """Characters added, removed and unchanged per pair; equal and empty texts skip the Python stage."""
    a, b = F.coalesce(original, F.lit("")), F.coalesce(modified, F.lit(""))
    trivial = (a == b) | (a == "") | (b == "")
    rows = pairs.withColumn("_trivial", trivial)
    easy = rows.filter("_trivial").withColumn("_lcs", F.when(a == b, F.length(a)).otherwise(F.lit(0)))
    hard = rows.filter("NOT _trivial").withColumn("_lcs", _common_length(a, b))
    out = easy.unionByName(hard)
    return out.withColumns({
        "unchanged": c("_lcs").cast("bigint"), "removed": (F.length(a) - c("_lcs")).cast("bigint"),
        "added": (F.length(b) - c("_lcs")).cast("bigint")}).drop("_lcs", "_trivial")


def revision_churn(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return diff_stats(pairs).groupBy(*by).agg(
        F.count(F.lit(1)).alias("revisions"), *[F.sum(n).alias(n) for n in ("added", "removed", "unchanged")])


def score_text_regions(df: DataFrame, context: DataFrame, page: Sequence[str], page_type: str, quality: float) -> DataFrame:
    """X2 with the page context joined."""
    return df.join(context.select(*page, "formula_density"), list(page)).withColumn(
        "confidence", scoring.text_confidence(F.lit(page_type), c("formula_density"), F.lit(quality)))
