"""Numbering and running values over an ordered group of any size.

A plain window sends a whole group to one task.  `scan` counts the rows of the groups first.  If no group is above
the limit, the plain window is used, over as many tasks as the rows ask for.  If one is, rows are range-partitioned on
(group, order), so that a big group is cut into consecutive blocks; each block is scanned alone, and what earlier blocks
carry over (one small row per block and group) is added afterwards.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..params import MAX_TASK_ROWS, MAX_WINDOW_ROWS


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """True when some group has more than ``limit`` rows (one pruned, map-side combined count of the rows as they are now)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return not counts.isEmpty()


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys of the groups above the limit; joined without a hint, so AQE picks by measured size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(*keys)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the table and of its largest group (one pruned, map-side combined count)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows, most = counts.agg(F.sum("n"), F.max("n")).first()
    return rows or 0, most or 0


def partitions_for(spark: SparkSession, rows: int, task_rows: int = MAX_TASK_ROWS) -> int:
    """Partitions for so many rows: the session's number, or more where a task would get over ``task_rows``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


def deal(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Rows by key in so many partitions; left alone, for AQE to size, where the session's number will do.

    For keys without large groups: Spark does not split the skewed partitions of an explicit number.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys) if partitions and partitions > usual else df


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    number: str | None = None,
    previous: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    maxs: dict[str, str] | None = None,
    limit: int = MAX_WINDOW_ROWS,
    hot: bool | None = None,
    blocks: int | None = None,
    task_rows: int = MAX_TASK_ROWS,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    number: row number from 1.  previous: {new: column} value of the row before.
    sums / maxs: {new: column} running sum / maximum including the row itself.  ``order`` must be total.
    ``hot`` passes on an earlier answer of `has_hot_group` for the same rows and keys; without it rows are counted, and a
    table of more than ``task_rows`` a shuffle partition is dealt to more tasks, so that a task does not grow with the table.
    """
    previous, sums, maxs = previous or {}, sums or {}, maxs or {}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = list(keys)
    rows = 0
    if keys and hot is None:
        rows, most = group_sizes(df, keys)
        hot = most > limit
    n = partitions_for(df.sparkSession, rows, task_rows)

    if keys and not hot:
        df = deal(df, n, *keys)
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = {number: F.row_number().over(w)} if number else {}
        new |= {o: F.lag(c).over(w) for o, c in previous.items()}
        new |= {o: F.sum(c).over(upto) for o, c in sums.items()}
        new |= {o: F.max(c).over(upto) for o, c in maxs.items()}
        return df.withColumns(new)

    blocked = cut(
        df.repartitionByRange(blocks or n, *[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id())
    )
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {"_n": F.row_number().over(w)}
    new |= {f"_p_{o}": F.lag(c).over(w) for o, c in previous.items()}
    new |= {f"_s_{o}": F.sum(c).over(upto) for o, c in sums.items()}
    new |= {f"_m_{o}": F.max(c).over(upto) for o, c in maxs.items()}
    local = blocked.withColumns(new)

    tail = local.groupBy(*keys, "_block").agg(
        F.max("_n").alias("_tn"),
        *[F.max_by(F.struct(F.col(c).alias("v")), "_n").alias(f"_tp_{o}") for o, c in previous.items()],
        *[F.sum(c).alias(f"_ts_{o}") for o, c in sums.items()],
        *[F.max(c).alias(f"_tm_{o}") for o, c in maxs.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tail.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.sum("_tn").over(before).alias("_cn"),
        *[F.last(f"_tp_{o}").over(before).alias(f"_cp_{o}") for o in previous],
        *[F.sum(f"_ts_{o}").over(before).alias(f"_cs_{o}") for o in sums],
        *[F.max(f"_tm_{o}").over(before).alias(f"_cm_{o}") for o in maxs],
    ).filter(F.col("_cn").isNotNull())
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, on, "left")
    out = {number: (F.col("_n") + F.coalesce(F.col("_cn"), F.lit(0))).cast("int")} if number else {}
    out |= {
        o: F.when(F.col("_n") == 1, F.col(f"_cp_{o}.v")).otherwise(F.col(f"_p_{o}")) for o in previous
    }
    out |= {
        o: F.when(F.col(f"_s_{o}").isNull(), F.col(f"_cs_{o}")).otherwise(
            F.col(f"_s_{o}") + F.coalesce(F.col(f"_cs_{o}"), F.lit(0))) for o in sums
    }
    out |= {o: F.greatest(f"_m_{o}", f"_cm_{o}") for o in maxs}
    return joined.select(*df.columns, *[c.alias(o) for o, c in out.items()])
