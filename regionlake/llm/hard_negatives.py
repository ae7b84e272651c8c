"""Operator 13: hard negatives by exact integer inner products, in tiles of anchors and candidates.

Rows are dealt to groups by a hash of their number, anchors once more to groups of their own; a cell is one group of anchors
and one of candidates, each of a bounded number of rows.  Within a cell tiles are multiplied as int64 matrices by Strassen's
recursion (padded with zeros, seven products of halves), whose additions are exact.  Each anchor keeps heaps of its best
rows: first the positives of its own label, then, for each positive, the best rows of other labels within its window of
scores.  Heaps of tiles merge in the task and those of cells by rank, so an anchor never meets more than a few rows a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import store

c = F.col
#: rows of one side of a cell
GROUP = 8192
TILE = (512, 2048)
LEAF = 32
_LEAST = np.iinfo(np.int64).min
_FOUND = "place long, number int, anchor_id long, positive_id long, positive_score long, id long, score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven products of halves, padded with zeros to even sizes; exact wherever the result fits its type."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b.T, ((0, n % 2), (0, k % 2))).T
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), p1.dtype)
    out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _whole(vectors: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, shorter vectors padded with zeros; Python's numbers where int64 is too small."""
    lists = vectors.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    small = not len(flat) or np.abs(flat).max() < 2.0 ** 62 / scale
    out = np.zeros((len(size), dims), np.int64 if small else object)
    values = np.floor(flat * scale).astype(np.int64) if small else np.array([math.floor(x) * scale if abs(x) >= 2.0 ** 53 else
                                                                             math.floor(x * scale) for x in flat.tolist()], object)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as int64; one that needs more bits becomes the nearest int64."""
    most = lambda x: max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 63:
        return strassen(a.astype(np.int64), b.astype(np.int64).T)
    exact = strassen(a.astype(object), b.astype(object).T)
    return np.vectorize(lambda v: min(max(v, _LEAST + 1), (1 << 63) - 1), otypes=[np.int64])(exact)


class Heap:
    """The best ``k`` columns of each of ``m`` rows seen so far: by score, then by the order in which columns came."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score = np.full((m, k), _LEAST)
        self.column = np.full((m, k), -1)

    def push(self, score: np.ndarray, allowed: np.ndarray, first: int) -> None:
        """Add a tile whose columns are numbered from ``first``."""
        score = np.where(allowed, score, _LEAST)
        live = np.flatnonzero(score.max(axis=1, initial=_LEAST) > self.score[:, -1])
        if not len(live):
            return
        score = score[live]
        top = Heap(len(live), self.k)
        rows = np.arange(len(live))
        for j in range(min(self.k, score.shape[1])):
            best = score.argmax(axis=1)  # the first of equal ones
            top.score[:, j] = score[rows, best]
            top.column[:, j] = np.where(top.score[:, j] > _LEAST, best + first, -1)
            score[rows, best] = _LEAST
        self.merge(top, live)

    def merge(self, other: Heap, rows: np.ndarray) -> None:
        """Take in a heap of some rows whose columns all come later."""
        score = np.hstack([self.score[rows], other.score])
        column = np.hstack([self.column[rows], other.column])
        order = np.argsort(~score, axis=1, kind="stable")[:, :self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.column[rows] = np.take_along_axis(column, order, 1)


def _cell(dims: int, scale: int, k: int, window: tuple[int, int] | None):
    """Of a cell's anchors the best ``k`` rows of their label or, with a window of percents, of other labels for each positive."""
    def best(rows: pa.Table) -> pa.Table:
        is_anchor = rows["anchor"]
        a, x = rows.filter(is_anchor), rows.filter(pc.invert(is_anchor))
        x = x.sort_by([("vec_id", "ascending"), ("place", "ascending")])
        va, vx = _whole(a["vec"], dims, scale), _whole(x["vec"], dims, scale)
        la, lx, pa_, px = (t[name].to_numpy() for name in ("label", "place") for t in (a, x))
        goals = [None] if window is None else list(range(max((len(p) for p in a["positives"].to_pylist()), default=0)))
        given = None if window is None else a["positives"].to_pylist()
        out = []
        for i in range(0, len(la), TILE[0]):
            some = slice(i, min(i + TILE[0], len(la)))
            m = some.stop - i
            heaps = [Heap(m, k) for _ in goals]
            bounds = [] if window is None else [_bounds(given[some], g, window) for g in goals]
            for j in range(0, len(lx), TILE[1]):
                part = slice(j, min(j + TILE[1], len(lx)))
                score = scores(va[some], vx[part])
                same = la[some, None] == lx[None, part]
                if window is None:
                    heaps[0].push(score, same & (pa_[some, None] != px[None, part]), j)
                    continue
                for heap, (low, high) in zip(heaps, bounds):
                    heap.push(score, ~same & (score >= low[:, None]) & (score <= high[:, None]), j)
            for g, heap in zip(goals, heaps):
                row, at = np.nonzero(heap.column >= 0)
                column = pa.array(heap.column[row, at])
                row_ids = pa.array(row + i)
                number = 0 if g is None else g
                meant = [given[r + i][g] if g is not None else (None, None) for r in row.tolist()]
                meant = [(p["id"], p["score"]) if isinstance(p, dict) else p for p in meant]
                out.append(pa.Table.from_arrays([
                    a["place"].take(row_ids), pa.array(np.full(len(row), number, np.int32)), a["vec_id"].take(row_ids),
                    pa.array([p[0] for p in meant], pa.int64()), pa.array([p[1] for p in meant], pa.int64()),
                    x["vec_id"].take(column), pa.array(heap.score[row, at])],
                    ["place", "number", "anchor_id", "positive_id", "positive_score", "id", "score"]))
        if out:
            return pa.concat_tables(out)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], [x.split()[0] for x in _FOUND.split(", ")])

    return best


def _bounds(positives: list, g: int, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score allowed for positive ``g`` of each anchor; none where there is no such positive."""
    low, high = [], []
    for p in positives:
        s = p[g]["score"] if g < len(p) else None
        low.append(0 if s is None else -(-window[0] * s // 100))
        high.append(-1 if s is None else window[1] * s // 100)
    clip = lambda x: np.array([min(max(v, _LEAST + 1), (1 << 63) - 1) for v in x], np.int64)
    return clip(low), clip(high)


def _cells(rows: DataFrame, anchors: DataFrame, n: int, n_anchors: int, group: int) -> DataFrame:
    """Candidates once a group of anchors, anchors once a group of candidates."""
    wide, high = max(1, -(-n // group)), max(1, -(-n_anchors // group))
    dealt = lambda groups, salt: F.pmod(F.xxhash64("place", F.lit(salt)), F.lit(groups))
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    positives = c("positives") if "positives" in anchors.columns else F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    names = ("place", "vec_id", "label", "vec")
    a = anchors.select(*names, positives, F.lit(True).alias("anchor"), dealt(high, 1).alias("row"), each(wide).alias("column"))
    x = rows.select(*names, F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives"), F.lit(False).alias("anchor"),
                    dealt(wide, 2).alias("column"), each(high).alias("row"))
    return a.unionByName(x).groupBy("row", "column")


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 5,
                   window: tuple[int, int] = (80, 100), scale: int = 256, group: int = GROUP, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``vec_id`` (divisible by 100).  An anchor's positives are its best other rows of the same
    label; for each, the best rows of other labels whose score is within ``window`` percent of the positive's are returned.
    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id, null ids last.  Rows without
    label or vector, or with a null or non-finite component, take no part; shorter vectors are padded with zeros.  Repeated
    rows are rows of their own, also as positives of each other.  Scores that need more than 63 bits count as the nearest
    number that has them.
    """
    x = c(f"`{vec_col}`")
    rows = vectors.select(c(f"`{id_col}`").cast("long").alias("vec_id"), c(f"`{label_col}`").cast("long").alias("label"), x.alias("vec"))
    rows = rows.filter(c("label").isNotNull() & c("vec").isNotNull()).filter(F.forall(
        "vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = store(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    wanted = (c("vec_id") % 100 == 0) if anchor is None else anchor
    some = rows.filter(wanted)
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_anchors = some.count()
    found = _cells(rows, some, n, n_anchors, group).applyInArrow(_cell(dims, scale, positives, None), _FOUND)
    order = W.partitionBy("place").orderBy(c("score").desc(), c("id").asc_nulls_last())
    first = found.withColumn("n", F.row_number().over(order)).filter(c("n") <= positives).groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p"))
    first = first.select("place", F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    some = store(some.join(first, "place"), "anchors")
    found = _cells(rows, some, n, n_anchors, group).applyInArrow(_cell(dims, scale, negatives, window), _FOUND)
    order = W.partitionBy("place", "number").orderBy(c("score").desc(), c("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", c("id").alias("negative_id"), "positive_score", c("score").alias("negative_score"))
