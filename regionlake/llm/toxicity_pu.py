"""Operator 10: toxicity by non-negative learning from positive and unlabelled texts.

Texts confirmed as toxic are the positives; everything else is unlabelled.  A text is the set of its words and of the first
four, five and six bytes of them, hashed.  Those that stand out among the positives become the inputs of a linear
classifier.  Its risk is  prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)):  the part of
the unlabelled risk that hidden positives cause is taken away again, and where a batch makes the rest negative, the
step goes the other way so that the classifier does not fit the unlabelled texts by heart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .folds import held_out, labelled, sample
from .tables import store, texts

c = F.col
PREFIXES = (4, 5, 6)
BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: the text of each word, and the hashed features of it (words by kinds)."""
    data, at = tb.buffers(column)
    data = _LOWER[data]
    for i, j in tb.blocks(at):
        words, counts, *short = tb.hash_words(data, at[i:j + 1], _GAP, PREFIXES)
        # each kind is hashed in its own way, so a short word and its prefix do not meet
        kinds = np.stack([tb.mix(v + np.uint64(k)) >> np.uint64(64 - BITS) for k, v in enumerate((words, *short))], 1)
        yield np.repeat(np.arange(i, j), counts), kinds.astype(np.int64)


def _present(owner: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once."""
    key = np.unique(np.repeat(owner, kinds.shape[1]) << BITS | kinds.ravel())
    return key >> BITS, key & (1 << BITS) - 1


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 4, part: int = 2,
                    positives: int = 8_000, unlabelled: int = 16_000, prior: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    At most ``positives`` toxic and ``unlabelled`` other rows are learned from, samples drawn by a hash of the id and none
    of the held-out part.  ``prior`` is the share of toxic documents; by default that among the labelled rows, or 0.1
    where these are all toxic.  A null or empty text has no feature and gets the score of ordinary text; without any
    positive every score is 0.  An id that several rows share gives each of them its own score.
    """
    model = train(docs, labels, parts, part, positives, unlabelled, prior)
    return texts(docs).mapInArrow(_Score(*model), "doc_id long, score double").select(
        "doc_id", held_out(c("doc_id"), parts, part).alias("held_out"), "score",
        (c("score") >= threshold).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, positives: int = 8_000,
          unlabelled: int = 16_000, prior: float | None = None, n_features: int = 1024):
    """Feature ids, their weights and the bias."""
    marked = labelled(labels, "toxic", parts, part)
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic:
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    if prior is None:
        prior = toxic / n if toxic < n else 0.1
    docs = texts(docs)
    some = docs.select("doc_id").filter(c("doc_id").isNotNull() & ~held_out(c("doc_id"), parts, part))
    known = sample(marked.filter("label = 1").select("doc_id"), positives).select("doc_id", F.lit(True).alias("positive"))
    other = sample(some.distinct(), unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # a toxic document may also stand among the unlabelled ones; at most positives + unlabelled ids are broadcast
    rows = docs.join(F.broadcast(known.union(other)), "doc_id").select("positive", "text")
    rows = store(rows, "pu_sample")
    seen = rows.mapInArrow(_count, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = (rows.filter(c("positive") == v).count() for v in (True, False))
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
    share = (c("p") + c("u")) / (n_p + n_u)
    stands_out = (c("p") / n_p - c("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = seen.filter("p >= 3").withColumn("z", stands_out).filter("z > 4").orderBy(c("z").desc(), "feature").limit(n_features)
    ids = np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64))
    table = rows.mapInArrow(_Inputs(ids), "positive boolean, inputs array<short>").toPandas()
    x = np.zeros((len(table), len(ids)), np.uint8)
    for i, inputs in enumerate(table["inputs"]):
        x[i, np.asarray(inputs, np.int64)] = 1
    return ids, *fit(x, table["positive"].to_numpy(bool), prior)


def fit(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 100, batch: int = 512, rate: float = 0.1,
        ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, by Adam over batches of both kinds."""
    rng = np.random.Generator(np.random.PCG64(3))
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    steps = max(1, len(u) // batch)
    t = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(u), steps):
            some = rng.choice(p, min(batch, len(p)), replace=False)
            xp, xu = (np.hstack([x[r], np.ones((len(r), 1), np.uint8)]).astype(np.float32) for r in (some, rows))
            zp, zu = xp @ w, xu @ w
            sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
            as_one = prior * (xp.T @ (sp - 1)) / len(xp)
            as_zero = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = as_one + as_zero if rest >= 0 else -as_zero
            g[:-1] += ridge * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        positive = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
        for owner, kinds in _features(batch.column(1)):
            text, feature = _present(owner, kinds)
            for k in (0, 1):
                counts[k] += np.bincount(feature[positive[text] == bool(k)], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(0))
    for some in np.array_split(at, max(1, len(at) // 100_000)):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[1, some]), pa.array(counts[0, some])],
                                         ["feature", "p", "u"])


def _chosen(ids: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among ids), each once."""
    place = np.full(1 << BITS, -1, np.int64)
    place[ids] = np.arange(len(ids))
    found = [np.zeros((0, 2), np.int64)]
    for owner, kinds in _features(column):
        at = place[kinds]
        word, kind = np.nonzero(at >= 0)
        found.append(np.unique(np.stack([owner[word], at[word, kind]], 1), axis=0))
    return tuple(np.concatenate(found).T)


class _Inputs:
    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def __call__(self, batches):
        for batch in batches:
            text, at = _chosen(self.ids, batch.column(1))
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(at, pa.int16()))], ["positive", "inputs"])


class _Score:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias

    def __call__(self, batches):
        for batch in batches:
            text, at = _chosen(self.ids, batch.column(1))
            z = self.bias + np.bincount(text, self.weights[at], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])
