"""Stages that turn documents into a training mix; each is written as Parquet and read again by the next one.

Stages 1 to 4 return the columns of documents.  A document without an id is judged by its own text only: the first stage
can drop it, later ones leave it.  Rows that share an id are one document and stay or go together.  An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlake.deploy import ship
from regionlake.llm.decontamination import contained_items
from regionlake.llm.line_dedup import HAS_WORD, without_lines
from regionlake.llm.ngram_join import ngram_jaccard_join
from regionlake.llm.pareto_mix import n_words, pareto_mix
from regionlake.llm.quality_gam import score_column, train
from regionlake.llm.tables import store, table

#: Stages learn and choose by models and hashes, which SQL does not express; tests hold them against plain Python.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go."""
    score = score_column(train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.coalesce("text", F.lit(""))) >= 0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document all of whose words stood in them goes with them.  n_chars follows the text."""
    names = docs.columns
    rows = without_lines(docs, counts=("__removed", "__near"))
    untouched = F.col("__removed") == 0
    rows = rows.filter(untouched | F.col("text").rlike(HAS_WORD))
    chars = F.when(untouched, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return rows.withColumn("n_chars", chars).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least id."""
    others = ngram_jaccard_join(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their sizes, the target of their source, copies and words taken.

    These replace columns of the same names.
    """
    numbers = ("source_size", "target", "copies")
    chosen = pareto_mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), *(F.col(n).alias(f"__{n}") for n in numbers)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    size = n_words(F.col("text"))
    own = [n for n in docs.columns if n not in (*numbers, "size", "taken")]
    return docs.join(chosen.hint("merge"), same).select(*own, size.alias("size"), *(F.col(f"__{n}").alias(n) for n in numbers),
                                          (size * F.col("__copies")).alias("taken"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
