"""Operator 4: token counts of documents in flat, unindexed token files, by searching for the end-of-document identifier.

A token file is nothing but identifiers of 16 or 32 bits in a row, each document followed by the end identifier.  ``scan``
cuts a file into blocks and searches each block for the end identifier with one vectorised comparison; a block reports the
documents that end in it, counting the first one from the block's start, and how many tokens are left open behind the last.
A prefix scan over the blocks of a file then adds the tokens left open before it, possibly over many blocks, to the first
end of each block, and numbers the documents.

``write_token_files`` makes such files with Spark's text writer: a line is a document's raw identifiers, and what ends a
line is the end identifier itself.  The ids of the documents go, in the same order, to a file of their own beside each
token file.  A task begins new files every few megabytes, so that reading a file takes the same memory however much text
a task had.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import scratch_path
from .tables import texts

c = F.col
END = 50256
BLOCK_TOKENS = 1 << 20
FILE_BYTES = 4 << 20


@lru_cache(maxsize=1)
def _coder(ranks: bytes, pattern: str):
    """One coder for all tasks of a worker."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("documents", pat_str=pattern, special_tokens={},
                             mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})


class _Encode:
    """Identifiers of each text as little-endian 16-bit numbers, by a public byte-pair vocabulary."""

    def __init__(self, ranks: bytes, pattern: str, file_bytes: int = FILE_BYTES):
        self.ranks, self.pattern, self.file_bytes = ranks, pattern, file_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(self.ranks, self.pattern)
        n = written = piece = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 256):
                part = ids[lo:lo + 256]
                coded = [np.array(coder.encode_ordinary(t), "<u2").tobytes() for t in batch.column(1).slice(lo, 256).to_pylist()]
                key = [np.array([0 if i is None else i, i is not None], "<i8").tobytes() for i in part]
                at = np.arange(n, n + len(part))
                n += len(part)
                pieces = []
                for value in coded:
                    # a file has the document that passes its size, and 16 bytes of every document for its ids
                    pieces.append(piece)
                    written += len(value) + 16
                    if written >= self.file_bytes:
                        written, piece = 0, piece + 1
                for kind, value in (("tokens", coded), ("ids", key)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(part)), pa.array(pieces, pa.int32()), pa.array(at, pa.int64()), pa.array(value, pa.binary())],
                        ["kind", "piece", "at", "value"])


def vocabulary(path: str) -> tuple[bytes, str]:
    """Ranks of a ``.tiktoken`` file (fixed size, about a megabyte) and the pattern that splits texts into pieces."""
    # fixed value: the pattern that goes with the byte-level vocabularies
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        return f.read(), pattern


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      file_bytes: int = FILE_BYTES) -> None:
    """Token files below ``path/kind=tokens`` and the documents' ids below ``path/kind=ids``.

    Each task writes a pair of files for every ``file_bytes`` of identifiers, in folders ``piece=0``, ``piece=1`` and so on; a
    document is never divided.  A null or empty text is a document of no tokens.  Texts are encoded whole; strings that look like special tokens are
    ordinary text, so no document holds the end identifier.
    """
    separator = np.array([END], "<u2").tobytes().decode("latin-1")
    rows = texts(docs, id_col, text_col).mapInArrow(
        _Encode(*vocabulary(tokenizer), file_bytes), "kind string, piece int, at long, value binary")
    # the writer puts out a string's bytes as they are; ordering keeps both files of a piece in step
    rows.sortWithinPartitions("kind", "piece", "at").select("kind", "piece", c("value").cast("string").alias("value")).write.partitionBy(
        "kind", "piece").option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = lambda pattern: F.coalesce(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        found("/part-(\\d+)[^/]*$").alias("file_no"), found("/piece=(\\d+)/[^/]*$").alias("piece"), "path", "content")


def scan(spark: SparkSession, path: str, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, file_no, piece, doc_no, start, n_tokens) of each document in the files below ``path``.

    ``file_no`` and ``piece`` are taken from the file's name and folder, 0 without them.  ``start`` is the document's first token in the file.  Tokens behind the last end identifier are a document of their
    own (of a file cut short); an empty file has none.  A file of up to 2 GB is read by one task.
    """
    blocks = _files(spark, path).mapInArrow(_Search(end, width, block_tokens), _BLOCK)
    order = W.partitionBy("path").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # tokens left open so far: positions count from the last end before the block
    last_end = F.max(F.when(F.size("ends") > 0, c("at") + F.element_at("ends", -1) + 1))
    rows = blocks.withColumn("open_from", F.coalesce(last_end.over(before), F.lit(0))).withColumn(
        "docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn(
        "last", F.lead("block").over(order).isNull())
    tail = F.coalesce(c("at") + F.try_element_at("ends", F.lit(-1)) + 1, c("open_from"))
    ends = F.transform("ends", lambda e, i: F.struct(
        (c("docs_before") + i).alias("doc_no"),
        F.when(i == 0, c("open_from")).otherwise(c("at") + F.get("ends", i - 1) + 1).alias("start"), (c("at") + e).alias("stop")))
    open_end = F.when(c("last") & (tail < c("at") + c("size")), F.array(F.struct(
        (c("docs_before") + F.size("ends")).alias("doc_no"), tail.alias("start"), (c("at") + c("size")).alias("stop"))))
    return rows.select("path", "file_no", "piece", F.inline(F.concat(ends, F.coalesce(open_end, F.array().cast(
        "array<struct<doc_no:bigint,start:bigint,stop:bigint>>"))))).select(
        "path", "file_no", "piece", "doc_no", "start", (c("stop") - c("start")).alias("n_tokens"))


_BLOCK = "path string, file_no int, piece int, block int, at long, size long, ends array<long>"


class _Search:
    def __init__(self, end: int, width: int, block_tokens: int):
        self.end, self.width, self.block = end, width, block_tokens

    def __call__(self, batches):
        kind = np.dtype("<u2" if self.width == 2 else "<u4")
        for batch in batches:
            for file_no, piece, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                tokens = np.frombuffer(content.as_buffer(), kind, len(content.as_buffer()) // self.width)
                rows = [(path, file_no, piece, k, at, len(part), np.flatnonzero(part == self.end)) for k, (at, part) in enumerate(
                    (at, tokens[at:at + self.block]) for at in range(0, len(tokens), self.block))]
                if rows:
                    cols = list(zip(*rows))
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)],
                                                     ["path", "file_no", "piece", "block", "at", "size", "ends"])


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, piece, doc_no, doc_id) from the files of ids that ``write_token_files`` left."""
    def read(batches):
        for batch in batches:
            for file_no, piece, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                ids = raw.reshape(-1, 18)[:, :16].copy().view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), file_no, np.int32)), pa.array(np.full(len(ids), piece, np.int32)), pa.array(np.arange(len(ids))),
                     pa.array(ids[:, 0], mask=ids[:, 1] == 0)], ["file_no", "piece", "doc_no", "doc_id"])

    return _files(spark, path).select("file_no", "piece", "content").mapInArrow(
        read, "file_no int, piece int, doc_no long, doc_id long")


def token_counts(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, and where its tokens are: file_no, piece, doc_no, start.

    The token files are written below ``path``, by default a new folder in the shared one.  Repeated rows and rows without
    an id are documents like any other.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    if not docs.limit(1).count():  # no documents leave no files to read
        return spark.createDataFrame([], "doc_id long, n_tokens long, file_no int, doc_no long, start long, piece int")
    write_token_files(docs, path, tokenizer, id_col, text_col)
    found = scan(spark, f"{path}/kind=tokens")
    return found.join(document_ids(spark, f"{path}/kind=ids"), ["file_no", "piece", "doc_no"]).select(
        "doc_id", "n_tokens", "file_no", "doc_no", "start", "piece")
