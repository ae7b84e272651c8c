"""Blocks of a table that are read several times, and numbers of them that are added up over all blocks.

A block is one row that packs many small ones, a few megabytes in all.  Blocks are written once, bucketed by their number,
so later steps meet answers for a block without moving it.  A block asks about its hashes: they are dealt to parts by their
upper bits, each part adds up what all blocks sent, and answers each block in the order in which it asked.  A hash that
stands everywhere is one number a block, so no part grows with a hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch_path

SENT = "part int, block long, keys binary, counts binary"
ANSWER = "block long, part int, answer binary"
#: hashes a part adds up, as an estimate
PART = 1_500_000
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("answer", pa.binary())])


def squeeze(a: np.ndarray) -> bytes:
    """The bytes of an array, compressed."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expand(b: bytes, kind) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"))
    return np.frombuffer(raw, kind)


def numbers() -> Iterator[int]:
    """Numbers for the blocks of one task, different from those of other tasks."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def store_blocks(df: DataFrame, name: str, n_bytes: int) -> DataFrame:
    """Write blocks bucketed by number, about two to a bucket, and read them back."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(max(8, n_bytes >> 24), "block").option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: files at a given path stay
    return out


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def asked(block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """What a block sends about its sorted, different hashes."""
    cuts = np.searchsorted(parts_of(keys, parts), np.arange(parts + 1))
    some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    short = keys.astype(np.uint32)
    return pa.RecordBatch.from_arrays([
        pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()),
        pa.array([squeeze(short[cuts[p]:cuts[p + 1]]) for p in some], pa.binary()),
        pa.array([squeeze(counts[cuts[p]:cuts[p + 1]].astype(np.uint32)) for p in some], pa.binary())], schema=_SENT)


def _add_up(rows: pa.Table) -> pa.Table:
    keys = [expand(x.as_py(), np.uint32) for x in rows["keys"]]
    counts = np.concatenate([expand(x.as_py(), np.uint32) for x in rows["counts"]])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(place, counts), 0xFFFFFFFF).astype(np.uint32)[place]
    each = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_arrays([rows["block"], rows["part"], pa.array([squeeze(x) for x in each], pa.binary())], schema=ANSWERS)


def totals(sent: DataFrame) -> DataFrame:
    """(block, part, answer): the sums of all blocks' counts, for each block in the order of its hashes.

    Within a part hashes are compared by 32 bits: a sum is never too small, and rarely too large.
    """
    return sent.groupBy("part").applyInArrow(_add_up, ANSWER)


def answered(rows: pa.Table, kind) -> np.ndarray:
    """The answers of all parts to one block, in order."""
    found = sorted(zip(rows["part"].to_pylist(), rows["answer"].to_pylist()))
    return np.concatenate([expand(b, kind) for _, b in found]) if found else np.zeros(0, kind)


def with_answers(blocks: DataFrame, answers: DataFrame, body, schema: str) -> DataFrame:
    """``body(block, answers)`` of each block and the rows that answer it; blocks stay where they are."""
    def meet(block: pa.Table, rows: pa.Table) -> pa.Table:
        return body(block, rows)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
