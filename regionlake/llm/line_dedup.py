"""Operator 5: line deduplication over a deletion neighbourhood.

A line is compared by its words in lower case, joined by single blanks.  An occurrence is removed if an earlier one (by
document id, then line number) has an equal line, or a line within one edit (a character put in, left out or replaced)
where both have ``min_chars`` characters at least.  Whether the earlier line was itself removed does not matter.

Lines within one edit share a variant with one character left out, so all such variants are emitted as hashed keys and
joined:

* of equally long lines, those that share a variant *and* the place of the character differ at that place only;
* a line that equals a variant of another one is that line with a character left out.

Every key needs only the earliest line on either side, so a key that many lines share gives one row for each of them and
never a pair for each two.  The edit distance to that earliest line is verified.  To keep the number of variants low, a line
is cut into pieces of up to 512 characters (two at least): one edit touches one piece, so lines within one edit agree in all
the rest.  Only lines that share such a rest with another one emit variants, and only for places in that piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, bind, store, texts

c = F.col
PIECE = 512
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def normal(line: Column) -> Column:
    spaced = F.when(line.rlike("[\\x09-\\x0D]|\\x20\\x20"), F.regexp_replace(line, SPACE, " ")).otherwise(line)
    return F.lower(F.trim(spaced))


def _pieces(m: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(m / PIECE)).cast("int")


def _edge(m: Column, q: Column, i: Column) -> Column:
    return F.floor(i * m / q).cast("int")


def _gates(line: Column, n: Column) -> Column:
    """For this length, and one less, the hash of the line without each piece; ``sel`` tells piece and length.

    Lines of two pieces, nearly all, get the same hashes from plain expressions, without a lambda for each piece.
    """
    def half(i: int, shorter: int) -> Column:
        m = n - shorter
        cut, empty = F.floor(m / 2).cast("int"), F.lit("")
        left, right = (empty, F.substring(line, cut + shorter + 1, n)) if i == 0 else (F.substring(line, F.lit(1), cut), empty)
        return F.struct(F.xxhash64(m, F.lit(i), left, right).alias("gate"), F.lit(i * 2 + shorter).alias("sel"))

    def of(shorter: int) -> Column:
        m = n - shorter

        def gate(i: Column) -> Column:
            left, right = _edge(m, _pieces(m), i), m - _edge(m, _pieces(m), i + 1)
            rest = F.struct(F.substring(line, 1, left), F.substring(line, n - right + 1, right))
            return F.struct(F.xxhash64(m, i, rest["col1"], rest["col2"]).alias("gate"), (i * 2 + shorter).alias("sel"))

        return F.transform(F.sequence(F.lit(0), _pieces(m) - 1), gate)

    return F.when(n <= 2 * PIECE, F.array(*[half(i, shorter) for shorter in (0, 1) for i in (0, 1)])).otherwise(F.concat(of(0), of(1)))


def _variants(line: Column, n: Column, sel: Column) -> Column:
    """Keys of a line for one piece: role 0 the line itself, 1 the line with a character left out, 2 the same with its place."""
    i, shorter = F.shiftright(sel, 1), sel.bitwiseAND(F.lit(1))
    m = n - shorter
    lo, hi = _edge(m, _pieces(m), i), _edge(m, _pieces(m), i + 1) - 1
    hi = F.when((shorter == 1) & (i == _pieces(m) - 1), m).otherwise(hi)
    left_out = lambda p: F.concat(F.substring(line, F.lit(1), p), F.substring(line, p + 2, n))
    long = F.transform(F.sequence(lo, hi), lambda p: F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit(1), left_out(p)).alias("key")))
    same = F.transform(F.sequence(lo, hi), lambda p: F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit(2), n, p, left_out(p)).alias("key")))
    own = F.array(F.struct(F.lit(0).alias("role"), F.xxhash64(F.lit(1), line).alias("key")))
    return F.when(shorter == 1, long).otherwise(F.concat(own, same))


def removed_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, line_no, near) of each occurrence to remove; ``docs`` has doc_id and text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    # the filter reads the raw line, and the length is a column of its own, so that neither is computed again for each use
    lines = lines.filter(c("raw").rlike(HAS_WORD)).select("doc_id", "line_no", normal(c("raw")).alias("line")).withColumn(
        "n", F.char_length("line"))
    gates = F.when(c("n") >= min_chars, _gates(c("line"), c("n")))
    place = F.struct("doc_id", "line_no")
    lines = store(lines.select(place.alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                               gates.alias("gates")), "lines")
    first = store(lines.groupBy("h1", "h2").agg(F.min(F.struct("at", "gates")).alias("m")).select(
        "h1", "h2", c("m.at").alias("first"), "m.gates"), "first_lines")
    again = lines.select("at", "h1", "h2").join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter(
        "at <> first").select("at", F.lit(False).alias("near"))
    near = _near_lines(docs, first.filter("gates IS NOT NULL").select("first", "gates"))
    return again.union(near.select(c("first").alias("at"), F.lit(True))).select("at.doc_id", "at.line_no", "near")


def _near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """First occurrences of lines that have an earlier line within one edit."""
    rows = first.select("first", F.inline("gates"))
    shared = rows.groupBy("gate").agg(F.count("*").alias("n")).filter("n > 1").select("gate")
    lines = rows.join(shared, "gate").groupBy(c("first.doc_id").alias("doc_id")).agg(
        F.collect_set(F.struct(c("first.line_no").alias("line_no"), "sel")).alias("lines"))
    lines = store(lines, "gated_lines")  # a document's own lines only
    found = docs.join(lines.hint("merge"), "doc_id").select("doc_id", F.split("text", "\n", -1).alias("text"), F.explode("lines").alias("s")).select(
        F.struct("doc_id", c("s.line_no").alias("line_no")).alias("first"), "s.sel", normal(F.get("text", c("s.line_no"))).alias("line"))
    found = store(found.distinct().withColumn("n", F.char_length("line")), "near_candidates")
    # a key that a line has twice does no harm: only the earliest line of a key counts
    keys = store(found.select("first", F.inline(_variants(c("line"), c("n"), c("sel")))), "variants")
    of = lambda role: F.min(F.when(c("role") == role, c("first")))
    least = keys.groupBy("key").agg(of(0).alias("own"), of(1).alias("left_out"), of(2).alias("same"))
    earlier = F.when(c("role") == 0, c("left_out")).when(c("role") == 1, c("own")).otherwise(c("same"))
    pairs = keys.join(least, "key").select("first", earlier.alias("earlier")).filter("earlier < first").distinct()
    line = found.groupBy("first").agg(F.first("line").alias("line"))
    pairs = pairs.join(line, "first").join(line.select(c("first").alias("earlier"), c("line").alias("other")), "earlier")
    return pairs.filter(F.levenshtein("line", "other", 1).between(0, 1)).select("first").distinct()


def without_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  counts: tuple[str, str] = ("n_removed", "n_near")) -> DataFrame:
    """``docs`` with what is left of each text (lines joined as they were), and two ``counts``: the lines removed, and how many
    of these for a near line.  A text from which nothing is removed stays as it is.

    Lines without a word stay.  Rows with the same id are one document: what is removed from one is removed from all at the
    same line.  A row without an id keeps all its lines, and other documents' lines may be removed for it, as it comes first.
    """
    gone = removed_lines(texts(docs, id_col, text_col), min_chars).groupBy("doc_id", "line_no").agg(
        F.max("near").alias("near")).groupBy("doc_id").agg(
        F.collect_list("line_no").alias("__gone"), F.count(F.when(c("near"), 1)).alias("__near"))
    gone = store(gone.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "__id"), "gone")
    text = c(f"`{text_col}`")
    left = bind(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), c("__gone")), lambda i: F.get(x, i)), "\n"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return docs.join(gone.hint("merge"), c(f"`{id_col}`") == c("__id"), "left").withColumns({
        text_col: F.when(c("__gone").isNull(), text).otherwise(left),
        counts[0]: count(F.when(c("__gone").isNotNull(), F.size("__gone"))), counts[1]: count(c("__near"))}).drop("__gone", "__near", "__id")


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (that hold a word and are left), n_removed, n_near, text; see
    ``without_lines``.  A null text is empty."""
    left = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD)))
    return without_lines(texts(docs, id_col, text_col), min_chars).select("doc_id", left.cast("long").alias("n_lines"), "n_removed", "n_near", "text")
