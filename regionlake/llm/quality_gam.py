"""Operator 8: quality classifier, a generalised additive model with pairwise interactions.

Sixteen numbers describe the form of a whole text.  Each is cut into bins; boosting visits the features in turn and fits a
tree of at most four leaves to the residuals over the bins of that one feature, so what is learned is a table per feature.
Then the pairs of features with the most left to explain get tables over two coarser bins in the same way.  A score is the
sum of the table entries of a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .folds import held_out, labelled, sample
from .tables import texts

FEATURES = ("log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "punctuation", "newline", "wide", "space",
            "distinct_words", "distinct_windows", "echo", "repeated_lines", "words_a_line", "words_a_stop")
_KINDS = 9
_NAMED = {b: 4 for b in b"#*$%&|<>"} | {ord("!"): 5, ord("\n"): 7}
_KIND = np.array([_NAMED.get(b, 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 else 8 if b > 127 else
                  0 if b in b" \t\r\v\f" else 6) for b in range(256)], np.uint8)
_LINE_END = np.arange(256) == 10


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, at = tb.buffers(column)
    parts = [_block(data, at[i:j + 1]) for i, j in tb.blocks(at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _block(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    length = np.diff(at)
    owner = np.repeat(np.arange(n), length)
    kinds = np.bincount(owner * _KINDS + _KIND[data[at[0]:at[-1]]], minlength=n * _KINDS).reshape(n, _KINDS)
    stops = np.bincount(owner[data[at[0]:at[-1]] == 46], minlength=n)
    words, count = tb.hash_words(data, at)
    whose = np.repeat(np.arange(n), count)
    same = (words[1:] == words[:-1]) & (whose[1:] == whose[:-1])
    windows, n_windows = tb.shingle(words, count)
    lines, n_lines = tb.hash_words(data, at, _LINE_END)
    chars, w = np.maximum(length, 1), np.maximum(count, 1)
    share = kinds / chars[:, None]
    return np.column_stack([
        np.log1p(count), (length - kinds[:, 0] - kinds[:, 7]) / w, share[:, 2:9], share[:, 0],
        tb.distinct(words, count) / w, tb.distinct(windows, n_windows) / np.maximum(n_windows, 1),
        np.bincount(whose[1:][same], minlength=n) / w, (n_lines - tb.distinct(lines, n_lines)) / np.maximum(n_lines, 1),
        np.log1p(count / np.maximum(n_lines, 1)), np.log1p(count / (stops + 1))])


@dataclass
class QualityModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 1

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.edges:
            return out
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            out += table[b]
        for j, k, table in self.pairs:
            out += table[bins[j] // self.coarse, bins[k] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, n_pairs: int = 6, bins: int = 48, rate: float = 0.15,
        ridge: float = 5.0) -> QualityModel:
    """The model of labelled rows.  Without rows, or with one label only, every score is the share of label 1 (0.5 of none)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.coarse = 4
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    total = np.full(len(y), model.base)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = residual()
            step = rate * _tree(np.bincount(at[j], g, size[j]), np.bincount(at[j], h, size[j]), ridge)
            model.tables[j] += step
            total += step[at[j]]
    coarse = [a // model.coarse for a in at]
    wide = [(s - 1) // model.coarse + 1 for s in size]
    g, h = residual()
    gain = {}
    for j, k in combinations(range(x.shape[1]), 2):
        cell = coarse[j] * wide[k] + coarse[k]
        a, b = (np.bincount(cell, v, wide[j] * wide[k]) for v in (g, h))
        gain[j, k] = float((a * a / (b + ridge)).sum())
    chosen = sorted(gain, key=gain.get, reverse=True)[:n_pairs]
    model.pairs = [(j, k, np.zeros((wide[j], wide[k]))) for j, k in chosen]
    for _ in range(rounds):
        for j, k, table in model.pairs:
            g, h = residual()
            cell = coarse[j] * wide[k] + coarse[k]
            grid = [np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h)]
            step = rate * _cross(*grid, ridge)
            table += step
            total += step[coarse[j], coarse[k]]
    return model


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins: the best cut, and the best cut of each side."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values over a grid: four quarters around the best crossing."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(s):
        low = s[:-1, :-1]
        return low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low

    if min(g.shape) < 2:
        return np.zeros(g.shape)
    gain = sum(p * p / (q + ridge) for p, q in zip(quarters(a), quarters(b)))
    i, j = (int(v) for v in np.unravel_index(np.argmax(gain), gain.shape))
    out = np.empty(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, part: int = 0,
          bound: int = 20_000) -> QualityModel:
    """Fit on at most ``bound`` labelled rows outside the held-out part, a sample drawn by a hash of the id."""
    rows = F.broadcast(sample(labelled(labels, label, parts, part), bound))  # at most bound rows of two numbers
    numbers = ", ".join(f"{n} double" for n in FEATURES)
    found = texts(docs).join(rows, "doc_id").select("doc_id", "label", "text").mapInArrow(
        _sampled, f"doc_id long, label int, {numbers}")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(bound).toPandas()
    return fit(table[list(FEATURES)].to_numpy(np.float64), table["label"].to_numpy(np.float64))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *(pa.array(v) for v in x.T)],
                                         ["doc_id", "label", *FEATURES])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 5, part: int = 0,
                   bound: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null and empty texts have all numbers 0 and get the score of those.  Labels that are null or neither 0 nor 1 teach
    nothing; labels without a document neither.  An id that several rows share gives each of them its own score.
    """
    score = score_column(train(docs, labels, "quality", parts, part, bound))
    return texts(docs).select(
        "doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def score_column(model: QualityModel):
    """A function of a text column that gives the score column."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(pa.array(text, pa.large_string(), from_pandas=True))))

    return score
