"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least ``threshold`` of its distinct five-word shingles (lower case) stand in
it; an item of fewer words is one shingle of that many words.  Items are far smaller than documents, so the two sides get
different sketches: a document is its whole set of shingles, an item its MinHash sketch, the shingles of least hash.  Items
are partitioned by size in powers of two, and a partition of up to ``u`` shingles has sketches of ``u - ceil(threshold * u)
+ 1`` values.  A document that contains an item can miss fewer shingles than that, so it meets at least one value of the
sketch: the search loses nothing.  What it finds is verified by the exact number of shared shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import all_tokens_fit, store, texts, words

c = F.col
SHINGLE = 5
#: Rows of item sketches and items that are sent to every executor; beyond it they are joined by shuffling.
BROADCAST_ROWS = 500_000


def _shingles(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(
        *(F.get(w, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _of_widths(w: Column, widths: list[int]) -> Column:
    return F.concat(*(_shingles(w, k) for k in widths))


def item_sketches(items: DataFrame, threshold: float, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, shingles, sketch) of each item with a word and an id."""
    rows = texts(items, item_col, text_col).filter("doc_id IS NOT NULL").select(
        c("doc_id").alias("item_id"), words(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    of = F.when(F.size("w") >= SHINGLE, _shingles(c("w"), SHINGLE))
    for k in range(1, SHINGLE):
        of = of.when(F.size("w") == k, _shingles(c("w"), k))
    rows = rows.select("item_id", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.sort_array(F.array_distinct(of)).alias("shingles"))
    most = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles").cast("double"))))
    k = (most - F.ceil(most * threshold - 1e-9) + 1).cast("int")
    return rows.withColumn("sketch", F.slice("shingles", F.lit(1), k))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document and each item it contains.

    Null and empty texts and items, and rows without an id, contain and are contained in nothing.  A document repeated with
    the same id counts once; with several texts under one id the best containment is reported.  Items with equal texts are
    reported each.
    """
    docs = texts(docs, id_col, text_col).filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    items = store(item_sketches(items, threshold, item_col, item_text_col), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [SHINGLE]  # five values at most
    sketches = store(items.select(F.explode("sketch").alias("shingle"), "item_id"), "sketches")
    if all_tokens_fit(sketches, BROADCAST_ROWS):
        sketches, items = F.broadcast(sketches), F.broadcast(items)
    met = docs.select("doc_id", words(c("text")).alias("w")).select(
        "doc_id", F.explode(_of_widths(c("w"), widths)).alias("shingle")).join(sketches, "shingle").select("doc_id", "item_id")
    # one row for each document found, with its own items
    met = store(met.distinct().groupBy("doc_id").agg(F.collect_list("item_id").alias("items")), "met")
    found = docs.join(met.hint("merge"), "doc_id").select("doc_id", "items", words(c("text")).alias("w")).select(
        "doc_id", "items", F.array_distinct(_of_widths(c("w"), widths)).alias("own")).select(
        "doc_id", "own", F.explode("items").alias("item_id"))
    shared = found.join(items, "item_id").select(
        "doc_id", "item_id", F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"),
        F.size("shingles").cast("long").alias("n_item"))
    best = shared.filter(c("n_shared") / c("n_item") >= threshold).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((c("n_shared") / c("n_item")).alias("containment"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")
