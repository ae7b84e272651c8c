"""Small shared helpers: inputs in a settled shape and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch_path

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text``; a null text is empty.  Other columns never meet
    names of the operator's own."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, although ``body`` names it several times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text: what stands between ASCII white space."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_tokens_fit(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows, looking at no more than one row beyond."""
    return df.limit(limit + 1).count() <= limit
