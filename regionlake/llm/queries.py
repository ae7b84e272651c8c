"""Named queries of the operators over the test tables, each over whole tables and whole texts, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from . import sql
from .collocations import collocations
from .decontamination import contained_items
from .hard_negatives import hard_negatives
from .host_rules import host_rules
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard_join
from .pareto_mix import pareto_mix
from .passage_dedup import repeated_passages
from .quality_gam import quality_scores
from .secret_scan import labelled_tokens, secret_scan, train_markov, written
from .separator_scan import token_counts
from .substring_dedup import without_repeats
from .tables import table, texts
from .toxicity_pu import toxicity_scores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if text is not None:
            SQL[name] = text
        return fn

    return register


@query("op1_ngram_jaccard_join", sql.NGRAM_JACCARD)
def _op1(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def _op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_scan(docs, train_markov(labelled_tokens(texts(docs))))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"), "n_random")


@query("op3_host_rules", sql.HOST_RULES)
def _op3(spark, sf_dir):
    return host_rules(table(spark, sf_dir, "documents"))


@query("op4_separator_scan")
def _op4(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op5_line_dedup", sql.LINE_DEDUP)
def _op5(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query("op6_decontamination", sql.DECONTAMINATION)
def _op6(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_passage_dedup")
def _op7(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_quality_gam")
def _op8(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_pareto_mix", sql.PARETO_MIX)
def _op9(spark, sf_dir):
    return pareto_mix(table(spark, sf_dir, "documents"))


@query("op10_toxicity_pu")
def _op10(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_collocations", sql.COLLOCATIONS)
def _op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_substring_dedup", sql.SUBSTRING_DEDUP)
def _op12(spark, sf_dir):
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_hard_negatives", sql.HARD_NEGATIVES)
def _op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))
