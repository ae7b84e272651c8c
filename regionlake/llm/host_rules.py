"""Operator 3: quality rules per document and per host.

Each document has counts from its whole text and rules over them.  Failures are summed per host, and the host's rate is
shrunk to the mean of all documents by a beta prior.  The prior is fitted by beta-binomial moments: the spread of the hosts'
rates, weighted by their documents, less what chance gives to hosts of their sizes.  So a host with few documents is not
judged by them alone.  A host whose shrunk rate is above ``max_rate`` is turned down with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, bind, store, words

c = F.col
WINDOW = 5


def _repeat_words(w: Column) -> Column:
    """Words that stand in some window of five words found twice or more in the text."""
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(
        *(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda e, other: F.coalesce(e["h"] == F.get(s, other)["h"], F.lit(False))
        found = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return bind(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    numbered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(numbered(h), repeated)))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each row."""
    rows = docs.select(c(f"`{id_col}`").alias("doc_id"), c(f"`{host_col}`").alias("host"), F.coalesce(c(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    long = lambda x, name: x.cast("long").alias(name)
    return rows.select(
        "doc_id", "host",
        long(F.char_length(F.regexp_replace("text", SPACE, "")), "word_chars"),
        long(F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")), "n_symbols"),
        bind(lines, lambda x: F.struct(long(F.size(x), "n"), long(F.size(x) - F.size(F.array_distinct(x)), "dup"))).alias("lines"),
        bind(words(c("text")), lambda w: F.struct(long(F.size(w), "n"), long(_repeat_words(w), "repeat"))).alias("words"),
    ).select("doc_id", "host", c("words.n").alias("n_words"), "word_chars", "n_symbols", c("lines.n").alias("n_lines"),
             c("lines.dup").alias("n_dup_lines"), c("words.repeat").alias("n_repeat_words"))


def host_rules(docs: DataFrame, max_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
               host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, failed (any rule), host_failed, kept.

    A null or empty text has no words, so it fails.  A document without a host is judged by itself alone.  Repeated rows
    count as often as they stand.
    """
    rows = document_counts(docs, id_col, text_col, host_col)
    base = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    more = (10 * c("n_symbols") > 3 * c("n_words")) | (10 * c("n_dup_lines") > 3 * c("n_lines")) | (
        c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))
    rows = store(rows.withColumn("base_failed", base).withColumn("failed", base | more), "counts")
    hosts = rows.filter("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(c("failed"), 1)).alias("f"))
    a, b = beta_prior(*hosts.agg(F.count("*"), *(F.sum(x) for x in (c("n"), c("f"), c("n") * c("n"), c("f") * c("f") / c("n")))).first())
    bad = hosts.filter((c("f") + a) / (c("n") + a + b) > max_rate).select("host", F.lit(True).alias("host_failed"))
    verdict = F.coalesce("host_failed", F.lit(False))
    # documents without a host match nothing, so they do not meet in a join
    judged = rows.filter("host IS NOT NULL").join(bad, "host", "left").unionByName(
        rows.filter("host IS NULL").withColumn("host_failed", F.lit(False)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed",
        verdict.alias("host_failed"), (~c("base_failed") & ~verdict).alias("kept"))


def beta_prior(k: int, n: int | None, f: int | None, nn: int | None, ff: float | None) -> tuple[float, float]:
    """The beta prior of k hosts, of the sums of documents n, failures f, n * n and f * f / n over hosts.

    With the mean m = f / n and the spread s = sum(n_i (f_i / n_i - m)^2), the correlation within hosts is
    (s / (m (1 - m)) - (k - 1)) / (n - nn / n - (k - 1)); the prior has (1 - it) / it documents.  Hosts that spread no more
    than chance has it are shrunk by as many documents as there are; with no hosts the prior is even.
    """
    if not k:
        return 0.5, 0.5
    mean = f / n
    spread, room = ff - f * f / n, n - nn / n - (k - 1)
    inner = (spread / (mean * (1 - mean)) - (k - 1)) / room if 0 < mean < 1 and room > 0 else 0.0
    inner = min(max(inner, 1 / (n + 1)), 0.999)
    size = (1 - inner) / inner
    return mean * size, (1 - mean) * size
