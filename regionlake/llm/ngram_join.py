"""Operator 1: n-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of shingles of five words (a text of fewer words is one shingle).  Texts whose sets have a Jaccard similarity
of at least the threshold are linked.

1. Each text gets 128 MinHash values; equal texts are one class from there on.
2. Texts that agree in all four values of one of 32 bands share a bucket (at 0.8 a pair misses all buckets with a
   probability of 5e-8).  Buckets are compared in blocks of bounded size, a large bucket as pairs of blocks.
3. In a block, MinHash values are compared 16 at a time; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold, given the matches so far and a uniform prior, falls below ``tolerance``.  Of the
   pairs left a block reports a spanning forest, so its answer is no longer than its input.
4. Components of these forests hold every surviving pair.  Each is verified exactly, again in blocks: shingle sets are
   multiplied as incidence matrices, and each text gets its number of links.  No pair becomes a row.
5. Components of the verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import connected_components
from .tables import store, texts

c = F.col
BANDS, ROWS = 32, 4
STEP = 16
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 2_000_000


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_id (least id of its exact copies), n_copies, class_id (least id of all
    documents that links lead to), n_links (different texts linked), n_linked_docs (documents linked, copies included).

    A text without words (null, empty, white space) is like no other: a class of its own without copies.  Rows with the
    same id count as one document with the shingles of all of them.  A row without an id gets null classes and no links.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the bands are made for thresholds from 0.5 to 1")
    docs = texts(docs, id_col, text_col)
    signed = store(docs.filter("doc_id IS NOT NULL").mapInArrow(_sign, "doc_id long, digest binary, n int, sig binary, low binary"), "signed")
    classes = store(signed.groupBy("digest").agg(
        F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.min("n").alias("n"),
        F.min("sig").alias("sig"), F.min("low").alias("low")), "classes")
    near = connected_components(_survivors(classes, threshold, tolerance))
    links = store(_verified(docs, classes, near, threshold), "links")
    split = links.filter(~c("whole")).select(c("copy_id").alias("a"), c("root").alias("b"))
    counts = links.groupBy("copy_id").agg(
        F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"),
        F.min(F.when(c("whole"), c("root"))).alias("root"))
    groups = connected_components(split)
    found = counts.join(groups, c("copy_id") == c("node"), "left").select(
        "copy_id", F.coalesce("component", "root").alias("class_id"), "n_links", "n_linked_docs")
    members = signed.select("doc_id", "digest").distinct().join(classes.select("digest", "copy_id", "n_copies"), "digest")
    of = members.join(found, "copy_id", "left").groupBy("doc_id").agg(
        F.min("copy_id").alias("copy_id"), F.max("n_copies").alias("n_copies"), F.min("class_id").alias("class_id"),
        F.max("n_links").alias("n_links"), F.max("n_linked_docs").alias("n_linked_docs"))
    own = lambda name: F.coalesce(name, "copy_id", "doc_id").alias(name)
    zero = lambda x, name: F.coalesce(x, F.lit(0)).cast("long").alias(name)
    copies = F.coalesce("n_copies", F.lit(1))
    return docs.select("doc_id").join(of, "doc_id", "left").select(
        "doc_id", own("copy_id"), copies.cast("long").alias("n_copies"), own("class_id"), zero("n_links", "n_links"),
        zero(F.coalesce("n_linked_docs", F.lit(0)) + copies - 1, "n_linked_docs"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        data, at = tb.buffers(batch.column(1))
        ids = batch.column(0)
        for i, j in tb.blocks(at):
            values, n = tb.shingle(*tb.hash_words(data, at[i:j + 1]))
            keep = np.flatnonzero(n)
            if not len(keep):
                continue
            sig = tb.minhash(values, (np.cumsum(n) - n)[keep], BANDS * ROWS)
            sizes = [len(np.unique(x)) for x in np.split(values, np.cumsum(n[keep])[:-1])]
            digests = [hashlib.blake2b(data[at[i + k]:at[i + k + 1]], digest_size=16).digest() for k in keep]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep + i)).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array([x.tobytes() for x in sig], pa.binary()),
                 pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["doc_id", "digest", "n", "sig", "low"])


def _survivors(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that connect all pairs of texts that pass the pruning in some bucket."""
    size = ROWS * 4
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.substring(c("sig"), i * size + 1, F.lit(size))))
    rows = classes.select("copy_id", F.explode(keys).alias("key"))
    crowds = rows.groupBy("key").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    # the lowest byte of each value is enough to compare; the posterior allows for chance matches
    rows = rows.join(crowds, "key").join(classes.select("copy_id", c("low").alias("sig")), "copy_id")
    n_blocks = F.ceil(c("crowd") / BLOCK_TEXTS)
    kernel = _Prune(_least_matches(threshold, tolerance))
    return _block_pairs(rows, "key", n_blocks, ["copy_id", "sig"]).mapInArrow(kernel, "a long, b long").distinct()


def _block_pairs(rows: DataFrame, key: str, n_blocks, columns: list[str]) -> DataFrame:
    """Rows of each key as pairs of blocks (one pair if there is one block), together and sorted in their partitions."""
    rows = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("copy_id", F.lit(11)), "n_blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), c("n_blocks") - 1)))
    rows = rows.select(c(key).alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "n_blocks", *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (key, i, j)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in range(3)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(k[:, a].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values the least number of matches that keeps a pair."""
    p = (np.arange(20_000) + 0.5) / 20_000
    p = p[p >= 1 / 256]
    far = p >= threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            w = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(w - w.max())
            if w[far].sum() / w.sum() >= tolerance:
                break
        out.append(m)
    return out


def _spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least item that the pairs (a, b) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Prune:
    def __init__(self, least: list[int]):
        self.least = least

    def __call__(self, batches):
        out_a, out_b = [], []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids = group.column("copy_id").to_numpy()
            # numpy rows are the texts, columns the values
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            if len(ids) == 2:
                a, b = self._lists(sig, np.array([0]), np.array([1]), 0, np.zeros(1, np.int64))
            else:
                block = group.column("block").to_numpy()
                a, b = self._matrix(sig, block if block.min() != block.max() else None)
            if len(a):
                root = ids[_spread(len(ids), a, b)]
                out_a.append(ids[root != ids])
                out_b.append(root[root != ids])
            if len(out_a) >= 512:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _edges(out_a, out_b)

    def _matrix(self, sig, block):
        n = len(sig)
        hits = np.zeros((n, n), np.uint8)
        for k in range(STEP):
            hits += sig[:, k, None] == sig[None, :, k]
        keep = np.triu(hits >= self.least[0], 1) if block is None else (hits >= self.least[0]) & (block[:, None] < block[None, :])
        a, b = np.nonzero(keep)
        return self._lists(sig, a, b, 1, hits[a, b].astype(np.int64))

    def _lists(self, sig, a, b, step, hits):
        for s in range(step, len(self.least)):
            k = slice(s * STEP, s * STEP + STEP)
            hits = np.concatenate([h + (sig[x, k] == sig[y, k]).sum(1) for h, x, y in zip(
                *(np.array_split(v, max(1, len(a) // 100_000)) for v in (hits, a, b)))])
            keep = hits >= self.least[s]
            a, b, hits = a[keep], b[keep], hits[keep]
        return a, b


def _edges(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _verified(docs: DataFrame, classes: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """For each text of a component and each pair of blocks it stands in: its links there and the root they lead to."""
    sized = classes.groupBy("copy_id").agg(F.sum("n").alias("n"), F.max("n_copies").alias("n_copies")).join(
        near, c("copy_id") == c("node")).select("copy_id", "n", "n_copies", "component")
    sized = store(sized, "members")
    sums = sized.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    # texts are shuffled at every size: members grow with the documents, so no plan rests on their being few
    rows = sized.join(sums, "component").hint("merge").join(docs, c("copy_id") == c("doc_id"))
    pairs = _block_pairs(rows, "component", c("parts"), ["copy_id", "n_copies", "text"])
    return pairs.mapInArrow(_Verify(threshold), "copy_id long, links long, linked_docs long, root long, whole boolean")


class _Verify:
    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches):
        for group in _groups(batches):
            ids, first, inverse = np.unique(group.column("copy_id").to_numpy(), return_index=True, return_inverse=True)
            sets: list[list[np.ndarray]] = [[] for _ in ids]
            for to, values in zip(inverse, (v for chunk in group.column("text").chunks for v in tb.text_shingles(chunk))):
                sets[to].append(values)
            whole = [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in sets]
            block = group.column("block").to_numpy()[first]
            linked = self._links(whole)
            # by the pair and not by the rows: if one of two blocks is empty, links within the other are not counted again
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            copies = group.column("n_copies").to_numpy()[first]
            root = ids[_spread(len(ids), *np.nonzero(np.triu(linked)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(linked.sum(1)), pa.array(linked @ copies), pa.array(root),
                 pa.array(np.full(len(ids), group.column("n_blocks")[0].as_py() == 1))],
                ["copy_id", "links", "linked_docs", "root", "whole"])

    def _links(self, sets: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(x) for x in sets], np.float64)
        owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = count > 1
        owner, at = owner[common[at]], (np.cumsum(common) - 1)[at[common[at]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        shared = np.zeros((len(sets), len(sets)), np.float64)
        # a strip of columns is a dense matrix of about 8 million cells at most
        wide = max(64, 8_000_000 // len(sets))
        for lo in range(0, int(common.sum()), wide):
            a, b = np.searchsorted(at, [lo, lo + wide])
            strip = np.zeros((len(sets), int(at[b - 1]) - lo + 1), np.float32)
            strip[owner[a:b], at[a:b] - lo] = 1
            shared += strip @ strip.T
        return shared >= self.threshold * (size[:, None] + size[None, :] - shared) - 1e-9
