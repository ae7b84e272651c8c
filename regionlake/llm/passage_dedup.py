"""Operator 7: passages that repeat anywhere in the corpus, found word by word wherever they begin and end.

A repeat is a run of ``min_words`` words or more (in lower case, whatever stands between them) that has an earlier occurrence,
by document id, then offset.  It is made of windows of just that many words:

1. Each window is marked by the least hash of its runs of ``min_words / 3`` words.  Equal windows have equal marks wherever
   they stand, and about eighteen neighbouring windows share theirs: a stretch, one row.
2. Equal stretches are grouped globally and the earliest is kept; all windows of the others are repeats.
3. A kept stretch can repeat in part only where its mark belongs to another stretch too.  Windows of such stretches (mostly
   those where a passage begins or ends) are grouped one by one; no window is lost.
4. Repeats that follow each other word by word are one passage, so its length is the true shared one.

Units of text (sentences, lines or paragraphs) only tidy where a passage begins: fewer than ``RAGGED`` words before a unit are
left in the text if the rest is still long enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textblocks as tb
from .tables import store, texts

c = F.col
_S = r"[\x20\x09\x0B-\x0D]"
UNITS = {
    "sentence": re.compile(rf"\n+|(?<=\.){_S}+|{_S}+(?=[A-ZÀ-ÖØ-Þ](?![A-ZÀ-ÖØ-Þ!]))"),
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(rf"\n(?:{_S}*\n)+"),
}
RAGGED = 5
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_PLACE = "doc_id long, pos int, start int, end int, unit int, last_unit int, head_pos int, head_start int, head_unit int"
_STRETCH = _PLACE + ", n int, mark long, h1 long, h2 int"
_WINDOW = _PLACE + ", h1 long, h2 int"


def _sums(words: np.ndarray, base: int):
    """A function that hashes the words from a to b (exclusive)."""
    steps = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), x, np.uint64)]))
    sums, back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * steps(base)[:-1], dtype=np.uint64)]), steps(pow(base, -1, 1 << 64))
    return lambda a, b: tb.mix((sums[b] - sums[a]) * back[a])


def _least(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w values in a row and its last place."""
    at, span = np.arange(len(x)), 1
    while span < w:
        step = min(span, w - span)
        right = x[step:] <= x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return x, at


class _Windows:
    """Stretches of all texts or, with a third column of their places (pos, n), the windows of some."""

    def __init__(self, min_words: int, units: str, single: bool):
        self.n, self.units, self.single = min_words, units, single

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = tb.buffers(batch.column(1))
            for i, j in tb.blocks(at):
                out = self._rows(data[at[i]:at[j]], at[i:j + 1] - at[i], ids[i:j], *(x.slice(i, j - i) for x in batch.columns[1:]))
                if out is not None:
                    yield out

    def _rows(self, data, at, ids, column, parts=None):
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        words, counts = tb.hash_words(lower, at)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[:max(0, len(owner) - self.n + 1)] == owner[self.n - 1:]
        if not inside.any():
            return None
        first = np.cumsum(counts) - counts
        start, end = self._places(data, at, owner)
        if self.single:
            begin = last = self._some(inside, first, parts)
            if not len(begin):
                return None
        else:
            k = -(-self.n // 3)
            i = np.arange(len(words) - k + 1)
            marks, place = _least(_sums(words, _BASES[0])(i, i + k), self.n - k + 1)
            window = np.flatnonzero(inside)
            cuts = np.flatnonzero(np.diff(place[window])) + 1
            begin, last = window[np.append(0, cuts)], window[np.append(cuts, len(window)) - 1]
        stop = last + self.n - 1
        head = self._heads(column, start, first, counts, np.unique(owner[begin]))
        unit = np.cumsum(head)
        heads = np.append(np.flatnonzero(head), len(head))
        h = heads[np.searchsorted(heads, begin)]
        has, base = h <= last, first[owner[begin]]
        h = np.where(has, h, 0)
        values = [ids[owner[begin]], begin - base, start[begin], end[stop], unit[begin], unit[stop], *(
            pa.array(x.astype(np.int32), mask=~has) for x in (h - base, start[h], unit[h]))]
        if self.single:
            h1, h2 = (_sums(words, x)(begin, begin + self.n) for x in _BASES[1:])
        else:
            # equal stretches also agree in where their words stand, so places in one tell those in the other
            gaps = np.append(np.diff(start), 0).astype(np.uint64)
            laid = words + tb.mix(gaps + np.uint64(1))
            h1, h2 = (tb.mix(_sums(laid, x)(begin, stop) + words[stop]) for x in _BASES[1:])
            values += [last - begin + 1, marks[begin].view(np.int64)]
        values += [h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        names = [x.split() for x in (_WINDOW if self.single else _STRETCH).split(", ")]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x).cast(kinds[k]) for x, (_, k) in zip(values, names)],
                                          [x for x, _ in names])

    @staticmethod
    def _some(inside, first, parts):
        take = np.zeros(len(inside), bool)
        for d, of in enumerate(parts.to_pylist()):
            for x in of:
                take[first[d] + x["pos"]:first[d] + x["pos"] + x["n"]] = True
        return np.flatnonzero(take & inside)

    def _heads(self, column, start, first, counts, docs):
        """Which words begin a unit."""
        head = np.zeros(len(start), bool)
        for d in docs.tolist():
            a, b = first[d], first[d] + counts[d]
            at = np.searchsorted(start[a:b], [0, *(m.end() for m in UNITS[self.units].finditer(column[d].as_py()))])
            head[a + at[at < b - a]] = True
        return head

    @staticmethod
    def _places(data, at, owner):
        """Where each word starts and ends in its text, in code points."""
        ink = np.concatenate([[False], ~tb._WS[data], [False]])
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        begin = np.flatnonzero(ink[1:] & (~ink[:-1] | edge))
        end = np.flatnonzero(ink[:-1] & (~ink[1:] | edge))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = points[at[owner]]
        return points[begin] - base, points[end] - base


def repeated_passages(docs: DataFrame, min_words: int = 51, units: str = "sentence", id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, n_units, first_doc_id, first_start) of each passage to remove.

    Offsets are code points of the original text, ``end`` exclusive; the first ones tell where the words that the passage
    begins with stand first, ``n_units`` in how many units it lies.  Null and empty texts have no words; rows without an id
    are left out.  A document repeated with the same id has each window twice at one place, and neither is earlier than the other.
    """
    docs = texts(docs, id_col, text_col).filter("doc_id IS NOT NULL").select(c("doc_id").cast("long"), "text")
    place = F.struct("doc_id", "start")
    stretches = store(docs.mapInArrow(_Windows(min_words, units, False), _STRETCH), "stretches")
    kept = store(stretches.groupBy("h1", "h2").agg(
        F.count("*").alias("times"), F.min("mark").alias("mark"), F.min(F.struct("doc_id", "start", "pos", "n")).alias("x")), "kept")
    first = F.struct(c("x.doc_id").alias("doc_id"), c("x.start").alias("start")).alias("first")
    whole = stretches.drop("mark").join(kept.filter("times > 1").select("h1", "h2", first), ["h1", "h2"]).filter(place > c("first"))
    torn = kept.groupBy("mark").agg(F.count("*").alias("ways")).filter("ways > 1").select("mark")
    parts = kept.select("mark", "x").join(torn, "mark").groupBy(c("x.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct(c("x.pos").alias("pos"), c("x.n").alias("n"))).alias("parts"))
    # texts are shuffled at every size, so no plan rests on repeats being few
    windows = store(docs.join(parts.hint("merge"), "doc_id").select("doc_id", "text", "parts").mapInArrow(
        _Windows(min_words, units, True), _WINDOW), "windows")
    known = windows.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").drop("times")
    single = store(windows.join(known, ["h1", "h2"]).filter(place > c("first")).withColumn("n", F.lit(1)).drop("h1", "h2"), "single")
    spans = whole.drop("h1", "h2").unionByName(single)
    before = W.partitionBy("doc_id").orderBy("pos")
    reach = F.max(c("pos") + c("n")).over(before.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((c("pos") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(before.rowsBetween(W.unboundedPreceding, W.currentRow)))
    a = F.struct("pos", "start", "unit", "first")
    moved = F.struct(c("first.doc_id").alias("doc_id"), (c("first.start") + c("head_start") - c("start")).alias("start"))
    h = F.struct(c("head_pos").alias("pos"), c("head_start").alias("start"), c("head_unit").alias("unit"), moved.alias("first"))
    runs = spans.groupBy("doc_id", "run").agg(
        F.max(F.struct((c("pos") + c("n")).alias("stop"), "end", "last_unit")).alias("z"), F.min(a).alias("a"),
        F.min(F.when(c("head_pos").isNotNull(), h)).alias("h"))
    runs = runs.select("doc_id", "z", F.when(c("h.pos") - c("a.pos") < RAGGED, c("h")).otherwise(c("a")).alias("a"))
    # the first of equal stretches may begin with words that stand earlier still
    earlier = single.select(place.alias("at"), c("first").alias("origin")).distinct()
    runs = runs.join(earlier, c("a.first") == c("at"), "left").withColumn("first", F.coalesce("origin", "a.first"))
    return runs.select(
        "doc_id", c("a.start").alias("start"), c("z.end").alias("end"), (c("z.stop") - c("a.pos") + min_words - 1).cast("long").alias("n_words"),
        (c("z.last_unit") - c("a.unit") + 1).cast("long").alias("n_units"), c("first.doc_id").alias("first_doc_id"), c("first.start").alias("first_start"))


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of all ``docs`` with their passages cut out; a text without any stays as it is (null as empty)."""
    cuts = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = texts(docs, id_col, text_col).join(cuts, "doc_id", "left")
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["left"], F.substring(
        c("text"), acc["at"] + 1, x["start"] - acc["at"])).alias("left"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"))
    rest = F.aggregate("cuts", zero, step, lambda acc: F.concat(acc["left"], F.substring(
        c("text"), acc["at"] + 1, F.char_length("text"))))
    return rows.select("doc_id", F.when(c("cuts").isNull(), c("text")).otherwise(rest).alias("text"))
