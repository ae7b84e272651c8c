"""Operator 9: mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most ``cap`` times its size; what is cut off is shared again among
the others by weight until none is above (the level that solves this is found with running sums over sources in the order
in which they reach their caps).  A source of ``size`` words with a target of ``(whole + f) * size`` words gives every
document ``whole`` certain copies, and one more copy to a Pareto sample: documents are ranked by the odds of a uniform
number divided by the odds of their inclusion probability, and taken from the front while that brings the words of the
sample nearer to f * size.  A document's probability is proportional to its words, so that the expected words are
f * size; where it would reach 1 the document is certain and ranks first.  (``odds="equal"`` gives all documents f.)

The place where a source's sample ends is found in histograms of the rank: 4096 bins, 4096 bins of the bin it falls into,
then the few ranks left.  So no source is ever ordered or gathered in one task, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WORD, store

c = F.col
BITS = 52
BIN = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Of sources (source, source_size) the target of each: weights go to sources in order of code points, null last."""
    n = len(weights)
    place = F.row_number().over(W.orderBy(c("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(n)) + 1).cast("long"))
    most = c("source_size") * cap
    full = rows.withColumn("ratio", most / c("w"))
    # sources up to here are taken as full; the level is what the rest can have
    before = W.orderBy("ratio", c("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    full = full.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    level = F.max(F.when(c("ratio") >= c("level"), c("level"))).over(everything)
    return full.withColumn("level", level).select(
        *sizes.columns, F.least(most.cast("double"), c("w") * c("level")).alias("target"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", odds: str = "size", id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, copies, taken (size * copies).

    A null text has size 0; a source of size 0 has target 0; a null source is a source.  Rows with the same id in a source
    share their rank, so they are taken together.  Runs with the same seed agree.
    """
    rows = store(docs.select(c(f"`{id_col}`").alias("doc_id"), c(f"`{source_col}`").alias("source"), n_words(c(f"`{text_col}`")).alias("size")), "sizes")
    # squares add up exactly, whatever the order
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(
        c("size").cast("decimal(19,0)") * c("size").cast("decimal(19,0)")).cast("double").alias("squares"))
    plan = targets(sizes, weights, cap)
    rate = F.when(c("source_size") > 0, c("target") / c("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("f", rate - c("whole")).withColumn(
        "need", F.greatest(c("target") - c("whole") * c("source_size"), F.lit(0.0)))
    plan = store(plan.withColumn("key", _key(c("source"))).drop("source"), "plan")
    chance = c("f") if odds == "equal" else F.when(c("squares") > 0, c("need") / c("squares") * c("size")).otherwise(0.0)
    # a few numbers a source; Spark broadcasts the table if its files are small and splits large keys if not
    drawn = rows.withColumn("key", _key(c("source"))).join(plan, "key").withColumn("rank", _rank(c("doc_id"), chance, seed))
    some = drawn.filter("need > 0").select("key", "need", "size", "rank")
    first = _crossing(some, F.shiftright("rank", BITS - BIN))
    inside = some.join(first, "key").filter(F.shiftright("rank", BITS - BIN) == c("bin")).select(
        "key", (c("need") - c("below")).alias("need"), "size", "rank")
    second = _crossing(inside, F.shiftright("rank", BITS - 2 * BIN))
    last = inside.join(second, "key").filter(F.shiftright("rank", BITS - 2 * BIN) == c("bin")).groupBy("key", "rank").agg(
        F.sum("size").alias("size"), F.first(c("need") - c("below")).alias("need"))
    up_to = F.sum("size").over(W.partitionBy("key").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    third = last.withColumn("up_to", up_to).filter(c("up_to") - c("size") / 2 <= c("need")).groupBy("key").agg(
        F.max("rank").alias("end"))
    shift = lambda x, bits: F.shiftleft(x, bits) - 1
    ends = plan.select("key").join(first, "key", "left").join(
        second.select("key", c("bin").alias("bin2")), "key", "left").join(third, "key", "left").select(
        "key", F.coalesce("end", shift(c("bin2"), BITS - 2 * BIN), shift(c("bin"), BITS - BIN), F.lit((1 << BITS) - 1)).alias("end"))
    ends = store(ends, "ends")
    extra = F.when((c("need") > 0) & (c("rank") <= c("end")), 1).otherwise(0)
    copies = (c("whole") + extra).cast("long")
    return drawn.join(ends, "key").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                                          (c("size") * copies).alias("taken"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _rank(doc_id: Column, f: Column, seed: str) -> Column:
    """Pareto rank as a 52-bit number: the logarithm of the odds of the draw over the odds of inclusion, 0 if certain."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (drawn.cast("long") + 0.5) / float(1 << BITS)
    f = F.least(F.lit(1.0), F.greatest(f, F.lit(1e-12)))
    return F.when(f >= 1, 0).otherwise(F.floor((F.log(u / (1 - u) * (1 - f) / f) + 128) / 256 * float(1 << BITS))).cast("long")


def _crossing(rows: DataFrame, bin_of: Column) -> DataFrame:
    """Per key the first bin that ends above the need, and the words in the bins before it; no row if there is none."""
    bins = rows.groupBy("key", bin_of.alias("bin")).agg(F.sum("size").alias("size"), F.first("need").alias("need"))
    up_to = F.sum("size").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    over = bins.withColumn("up_to", up_to).filter("up_to > need")
    return over.groupBy("key").agg(F.min(F.struct("bin", (c("up_to") - c("size")).alias("below"))).alias("m")).select(
        "key", "m.bin", "m.below")
