"""Labelled rows to learn from, in bounded number, and rows held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether a row belongs to the part of the documents whose labels are never read."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def labelled(labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """(doc_id, label 0/1) of the rows to learn from: one row an id (the larger label), without null ids and labels."""
    rows = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id"), parts, part))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same ones at every run: those of the least hash of the id.

    ``rows`` should be narrow.  Of many rows only those below a hash that twice ``bound`` of them have are ordered, so what the
    partitions send on does not grow with their number.
    """
    rank = F.xxhash64("doc_id", F.lit(5))
    n = rows.count()
    if n > 4 * bound:
        rows = rows.filter(rank < -(1 << 63) + (1 << 64) * 2 * bound // n)
    return rows.orderBy(rank, "doc_id").limit(bound)
