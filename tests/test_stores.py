"""Stored tables: merges touch their buckets only, look-ups leave the store where it is."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from regionlake.operators import lifecycle
from regionlake.sources import stores

SCHEMA = "id long, latex string, is_favorite boolean"


def files(path):
    return {str(f.relative_to(path)) for f in (path / "data").rglob("*.parquet")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.range(2_000).select("id", F.concat(F.lit("x_"), "id").alias("latex"), (F.col("id") % 3 == 0).alias("is_favorite"))
    stores.create_keyed(base, str(tmp_path), buckets=16)
    before = files(tmp_path)
    changes = spark.createDataFrame([(5, False, "new", None), (6, True, None, None), (5_000, False, "added", True)],
                                    "id long, is_deleted boolean, latex string, is_favorite boolean")
    assert stores.merge_keyed(changes, str(tmp_path)) == 1
    want = lifecycle.merge_tables(base, changes).select("id", "latex", "is_favorite")
    got = stores.read_keyed(spark, str(tmp_path))
    assert sorted(got.collect()) == sorted(want.collect()) and got.schema.names == base.schema.names
    # nothing of the earlier version is touched, and at most three buckets are written
    after = files(tmp_path)
    assert before <= after and len({f.split("/")[2] for f in after - before}) <= 3
    assert sorted(stores.read_keyed(spark, str(tmp_path), 0).collect()) == sorted(base.collect())
    with pytest.raises(ValueError):
        stores.read_keyed(spark, str(tmp_path), 9)


def test_merge_of_nothing_of_everything_and_of_null_keys(spark, tmp_path):
    base = spark.createDataFrame([(None, "n", True), (1, "a", False), (2, None, None)], SCHEMA)
    stores.create_keyed(base, str(tmp_path), buckets=4)
    change = lambda rows: spark.createDataFrame(rows, "id long, is_deleted boolean, latex string")
    assert stores.merge_keyed(change([]), str(tmp_path)) == 0
    assert stores.merge_keyed(change([(1, True, None), (2, True, None)]), str(tmp_path)) == 1
    assert [tuple(r) for r in stores.read_keyed(spark, str(tmp_path)).collect()] == [(None, "n", True)]
    stores.merge_keyed(change([(1, False, "again"), (None, False, "m")]), str(tmp_path))
    got = sorted(map(tuple, stores.read_keyed(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "n", True), (None, "m", None), (1, "again", None)], key=str)


def test_empty_table(spark, tmp_path):
    stores.create_keyed(spark.createDataFrame([], SCHEMA), str(tmp_path), buckets=4)
    assert stores.read_keyed(spark, str(tmp_path)).count() == 0
    stores.merge_keyed(spark.createDataFrame([(1, False, "a")], "id long, is_deleted boolean, latex string"), str(tmp_path))
    assert [tuple(r) for r in stores.read_keyed(spark, str(tmp_path)).collect()] == [(1, "a", None)]


def test_a_look_up_does_not_shuffle_the_store(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("h"), F.col("id") % 200).alias("content_hash"), F.lit("o").alias("options_key"),
                                   F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    stores.write_lookup(rows, "detections_test", str(tmp_path / "d"), buckets=8)
    stores.write_lookup(rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), "detections_test", str(tmp_path / "d"), buckets=8)
    schema = spark.table("detections_test").schema
    spark.sql("DROP TABLE detections_test")  # files of an external table stay
    stored = stores.open_lookup(spark, "detections_test", str(tmp_path / "d"), schema, buckets=8)
    wanted = spark.createDataFrame([("h1", "o"), ("h199", "o"), ("h9", "p"), (None, "o")], "content_hash string, options_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lifecycle.reuse_detections(wanted, stored, datetime(2023, 11, 15))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.content_hash, r.options_key): r.reused for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {("h1", "o"): True, ("h199", "o"): True, ("h9", "p"): False, (None, "o"): False}
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    assert {r.stored_at for r in out.filter("reused").collect()} == {
        r.ts for r in stored.filter("content_hash IN ('h1', 'h199')").groupBy("content_hash").agg(F.max("ts").alias("ts")).collect()}
    spark.sql("DROP TABLE detections_test")


def test_methods_of_one_row_are_tried_in_one_pass(spark, tmp_path):
    """fallback_methods gives what `with_fallback` gives, without moving a text."""
    from pyspark.sql import functions as F

    from regionlake import fixtures
    from regionlake.functions import latex as lx
    from regionlake.operators import corpus, lifecycle
    from regionlake.plans import metering_queries as q

    texts = ["plain words", "x = 1", "a (b", "$y$ and $$z^2$$", "```\nq_1\n```", "", "{", "∑ α", None, "\\frac{a}{b} 3"]
    rows = [(i, texts[i % len(texts)], "web") for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q.fallback_methods(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    keep = lambda fn: lambda df: corpus.valid_results(df.withColumn("latex", fn(F.col("reply")))).select("id", "latex")
    want = lifecycle.with_fallback(fixtures.replies(spark, str(tmp_path)).select("id", "reply"), [
        ("extract", keep(lx.extract_latex)), ("spans", keep(lx.extract_all_math)), ("plain", keep(lx.normalize_latex))])
    found = sorted(got.collect())
    assert found == sorted(want.select(*got.columns).collect()) and {r.method for r in found} > {"extract", "plain"}
