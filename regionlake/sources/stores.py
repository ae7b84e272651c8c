"""Stored tables that grow by merges (U5) and stores that are looked up by key without a shuffle of their own."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..operators import lifecycle

c = F.col
VERSIONS = "version long, bucket int, data_version long, n_buckets int, key string, row_schema string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int, version: int) -> None:
    """Rows below data/, a folder a version and bucket; a large bucket is written by several tasks."""
    rows.withColumns({"data_version": F.lit(version).cast("long"), "bucket": _bucket(key, buckets)}).hint(
        "rebalance", "bucket").write.mode("append").partitionBy("data_version", "bucket").parquet(f"{path}/data")


def _commit(spark: SparkSession, path: str, key: str, buckets: int, version: int, held: dict[int, int], schema: StructType) -> None:
    """The list of what is valid is one small file, so a version is seen whole or not at all."""
    rows = [(version, b, held.get(b), buckets, key, schema.json()) for b in range(buckets)]
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def create_keyed(rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """A table of unique keys in a folder, split by a hash of the key.  Rows without a key stand in one bucket and stay as they are."""
    _write(rows, path, key, buckets, 0)
    _commit(rows.sparkSession, path, key, buckets, 0, dict.fromkeys(range(buckets), 0), rows.schema)


def _listed(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict[int, int], str, StructType]:
    """Number of the version (the newest unless given), data version of each bucket, key and schema: one row a bucket."""
    versions = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    rows = versions.filter(c("version") == version).collect()
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    held = {r.bucket: r.data_version for r in rows}
    return version, held, rows[0].key, StructType.fromJson(json.loads(rows[0].row_schema))


def _read(spark: SparkSession, path: str, held: dict[int, int], schema: StructType) -> DataFrame:
    by_version: dict[int, list[int]] = {}
    for bucket, v in held.items():
        by_version.setdefault(v, []).append(bucket)
    wanted = [(c("data_version") == v) & c("bucket").isin(sorted(b)) for v, b in sorted(by_version.items())]
    stored = StructType([*schema.fields]).add("data_version", LongType()).add("bucket", IntegerType())
    rows = spark.read.schema(stored).parquet(f"{path}/data")
    return rows.filter(reduce(Column.__or__, wanted, F.lit(False))).select(*schema.names)


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it stands, or as it stood at a version; only folders that are valid there are read."""
    _, held, _, schema = _listed(spark, path, version)
    return _read(spark, path, held, schema)


def merge_keyed(changes: DataFrame, path: str) -> int:
    """U5 on a stored table: only buckets that ``changes`` touch are read and written again.  Returns the new version.

    ``changes`` has one row a key and is_deleted, as in `merge_tables`; rows of it without a key are added.  Folders of earlier
    versions stay, so readers in the middle of a job are not disturbed.  One writer at a time.
    """
    spark = changes.sparkSession
    version, held, key, schema = _listed(spark, path, None)
    # at most a number a bucket
    touched = [r.bucket for r in changes.select(_bucket(key, len(held)).alias("bucket")).distinct().collect()]
    if not touched:
        return version
    base = _read(spark, path, {b: held[b] for b in touched}, schema)
    _write(lifecycle.merge_tables(base, changes, key).select(*schema.names), path, key, len(held), version + 1)
    _commit(spark, path, key, len(held), version + 1, held | dict.fromkeys(touched, version + 1), schema)
    return version + 1


# ---------------------------------------------------------------- J7
DETECTION_KEY = ("content_hash", "options_key")


def write_lookup(rows: DataFrame, name: str, path: str, key: Sequence[str] = DETECTION_KEY, buckets: int = 64, mode: str = "append") -> None:
    """Rows in files bucketed and sorted by their key, so that joins and aggregates on it need no shuffle of the store.

    Each task of the rows, grouped by bucket first, writes whole buckets; a look-up shuffles the wanted rows only.
    """
    rows.repartition(buckets, *key).write.mode(mode).bucketBy(buckets, *key).sortBy(*key).option("path", path).format(
        "parquet").saveAsTable(name)


def open_lookup(spark: SparkSession, name: str, path: str, schema: StructType, key: Sequence[str] = DETECTION_KEY,
                buckets: int = 64) -> DataFrame:
    """A store written before, made known to a new session whose catalog does not have it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    names = ", ".join(f"`{n}`" for n in key)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) "
              f"INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)
