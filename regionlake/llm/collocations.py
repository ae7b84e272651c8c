"""Operator 11: phrases whose words stand together more often than apart, counted in a dictionary of distinct chunks.

1. Texts are cut into pieces at punctuation and line ends.  A piece is parsed into chunks at its triggers, runs of
   ``max_words - 1`` words whose hash is divisible by ``every``: a chunk goes from one trigger to the end of the next one, so
   neighbouring chunks overlap by a trigger.  No chunk is a prefix of another one, and a repeated passage gives the same
   chunks wherever it stands.
2. Distinct chunks with the number of their parses are the dictionary, one row each, written in blocks.
3. Phrases are counted inside distinct chunks, times parses.  A phrase that begins in a chunk's last trigger belongs to the
   next chunk, so overlaps count once.  Blocks first add up hashes of their phrases; only phrases whose sum reaches
   ``min_count`` become rows, and these are counted by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks as bl
from . import textblocks as tb
from .tables import store

c = F.col
BLOCK = 2 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_CHUNK = "lang string, chunk string, open boolean"
_BLOCK = "block long, n_words long, langs array<string>, lang binary, sizes binary, data binary, open binary, times binary"
_COUNT = "lang string, phrase string, words int, n long"


def _edges(data: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in bytes; ``gap`` are the bytes between words and ``at`` where texts begin."""
    ink = np.concatenate([[False], ~gap[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    return np.flatnonzero(ink[1:] & (~ink[:-1] | edge)), np.flatnonzero(ink[:-1] & (~ink[1:] | edge))


def _up_to(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, kind=pa.string()) -> pa.Array:
    at = np.append(0, np.cumsum(size))
    taken = data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    offsets = at.astype(np.int32 if kind == pa.string() else np.int64)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


def _parse(max_words: int, every: int):
    """Chunks of each text; the words of a chunk are parted by single spaces."""
    width = max_words - 1

    def block(langs: pa.Array, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        words, counts = tb.hash_words(data, at, _BREAK | _BLANK)
        if not len(words):
            return None
        start, end = _edges(data, at, _BREAK | _BLANK)
        text = np.repeat(np.arange(len(counts)), counts)
        piece = np.cumsum(_BREAK[data])[start]
        fresh = np.append(True, (np.diff(piece) != 0) | (np.diff(text) != 0))
        number = np.cumsum(fresh)
        cut = fresh.copy()
        n = len(words) - width + 1
        if n > 0:
            value = np.zeros(n, np.uint64)
            for k in range(width):
                value = tb.mix(value + words[k:k + n])
            cut[:n] |= (value % np.uint64(every) == 0) & (number[:n] == number[width - 1:])
        first = np.flatnonzero(cut)
        after = np.append(first[1:], len(words))
        open_ = np.append(~fresh[first[1:]], False)
        last = after - 1 + np.where(open_, width, 0)
        size = end - start
        place = np.cumsum(size + 1) - size - 1
        line = np.full(place[-1] + size[-1], 32, np.uint8)
        line[np.repeat(place, size) + _up_to(size)] = data[np.repeat(start, size) + _up_to(size)]
        chunks = _slices(line, place[first], place[last] + size[last] - place[first])
        return pa.RecordBatch.from_arrays([langs.take(pa.array(text[first])), chunks, pa.array(open_)], ["lang", "chunk", "open"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tb.buffers(batch.column(1))
            for i, j in tb.blocks(at):
                out = block(batch.column(0).slice(i, j - i), data[at[i]:at[j]], at[i:j + 1] - at[i])
                if out is not None:
                    yield out

    return parse


def dictionary(docs: DataFrame, max_words: int = 3, every: int = 16, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, open, times): the distinct chunks; ``open`` ones end with the trigger of the next chunk."""
    rows = docs.select(F.coalesce(c(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(c(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_parse(max_words, every), _CHUNK).groupBy("lang", "chunk", "open").agg(F.count("*").alias("times"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, held, size = bl.numbers(), [], 0

    def block():
        rows = pa.Table.from_batches(held)
        data, at = tb.buffers(rows["chunk"].combine_chunks())
        data = data[at[0]:at[-1]]
        langs = rows["lang"].combine_chunks().dictionary_encode()
        n_words = int((data == 32).sum()) + len(rows)
        parts = (langs.indices.to_numpy(), np.diff(at), data, rows["open"].to_numpy(), rows["times"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([next(numbers)]), pa.array([n_words]), pa.array([langs.dictionary.to_pylist()], pa.list_(pa.string()))] + [
            pa.array([bl.squeeze(x)], pa.binary()) for x in parts], ["block", "n_words", "langs", "lang", "sizes", "data", "open", "times"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            held.append(batch.slice(i, 1024))
            size += held[-1].column(1).nbytes
            if size >= BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


class _Phrases:
    """All phrases of a block's chunks: language, first word, number of words, weight and hash of each."""

    def __init__(self, row: dict, max_words: int):
        self.number, self.langs = row["block"], row["langs"]
        lang, sizes, self.data, open_, times = (bl.expand(row[k], kind) for k, kind in (
            ("lang", np.int32), ("sizes", np.int64), ("data", np.uint8), ("open", bool), ("times", np.int64)))
        at = np.append(0, np.cumsum(sizes))
        words, counts = tb.hash_words(self.data, at, _BLANK)
        self.start, self.end = _edges(self.data, at, _BLANK)
        own = np.where(open_, counts - (max_words - 1), counts)
        up = _up_to(own)
        first = (np.repeat(np.cumsum(counts) - counts, own) + up).astype(np.int32)
        room = (np.repeat(counts, own) - up).astype(np.int32)
        del up
        of_lang, _ = tb.hash_words(*tb.buffers(pa.array([x.replace(" ", "_") or "_" for x in self.langs])), np.zeros(256, bool))
        lang = np.repeat(lang, own)
        weight = np.repeat(times, own)
        self.lang, self.first, self.words, self.weight, self.key = [], [], [], [], []
        value = tb.mix(of_lang)[lang]
        for k in range(1, max_words + 1):
            fits = room >= k
            lang, first, room, weight, value = (x[fits] for x in (lang, first, room, weight, value))
            value = tb.mix(value + words[first + k - 1])
            for out, x in ((self.lang, lang), (self.first, first), (self.words, np.full(len(first), k, np.int32)),
                           (self.weight, weight), (self.key, value)):
                out.append(x)
        self.lang, self.first, self.words, self.weight, self.key = map(
            np.concatenate, (self.lang, self.first, self.words, self.weight, self.key))


def _ask(max_words: int, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Phrases(row, max_words)
                keys, which = np.unique(x.key, return_inverse=True)
                # sums are only held against a small number
                yield bl.asked(x.number, keys, np.minimum(np.bincount(which, x.weight), 1 << 31), parts)

    return ask


def _count(max_words: int, min_count: int):
    """(lang, phrase, words, n) of a block's phrases that can reach ``min_count``, and without a phrase all its words."""
    def count(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            x = _Phrases(row, max_words)
            total = bl.answered(answers, np.uint32)[np.unique(x.key, return_inverse=True)[1]]
            live = np.flatnonzero(total >= min_count)
            begin, end = x.start[x.first[live]], x.end[x.first[live] + x.words[live] - 1]
            coded = [_slices(x.data, begin[i:i + 65_536], (end - begin)[i:i + 65_536]).dictionary_encode()
                     for i in range(0, len(live), 65_536)]
            if coded:
                merged = pa.chunked_array(coded).unify_dictionaries()
                phrases = merged.chunk(0).dictionary
                which = np.concatenate([y.indices.to_numpy() for y in merged.chunks])
                pairs, at, place = np.unique(x.lang[live].astype(np.int64) * len(phrases) + which, return_index=True, return_inverse=True)
                n = np.zeros(len(pairs), np.int64)
                np.add.at(n, place, x.weight[live])
                langs = pa.array(x.langs).take(pa.array(pairs // len(phrases)))
                out.append([langs, phrases.take(pa.array(pairs % len(phrases))), pa.array(x.words[live][at]), pa.array(n)])
            one = x.words == 1
            n = np.zeros(len(x.langs), np.int64)
            np.add.at(n, x.lang[one], x.weight[one])
            out.append([pa.array(x.langs, pa.string()), pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n), np.int32)), pa.array(n)])
        return pa.concat_tables([pa.Table.from_arrays(a, ["lang", "phrase", "words", "n"]) for a in out])

    return count


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, every: int = 16, text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to ``max_words`` words that stand ``min_count`` times or more in a
    language, and one row a language without a phrase and with 0 words: its number of words."""
    chunks = dictionary(docs, max_words, every, text_col, lang_col)
    packed = bl.store_blocks(chunks.mapInArrow(_pack, _BLOCK), "chunks", bl.text_bytes(docs, text_col))
    parts = 1 + (packed.agg(F.sum("n_words")).first()[0] or 0) * max_words // bl.PART
    sums = store(bl.totals(packed.mapInArrow(_ask(max_words, parts), bl.SENT)), "sums")
    rows = bl.with_answers(packed, sums, _count(max_words, min_count), _COUNT)
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((c("n") >= min_count) | (c("words") == 0))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, every: int = 16,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a is the count of a phrase and l, r those of the parts of its lowest-scoring cut; the score is floor(10**6 a a / (l r)),
    n the number of words of the language.  Phrases inside a longer one with ``share`` percent of their count or more are
    left out.  Counts are exact below 10**15.  A null text has no words, a null language is ``und``; an empty table gives no
    rows, repeated rows count as often as they stand.
    """
    counts = store(phrase_counts(docs, max_words, min_count, every, text_col, lang_col), "counts")
    parts = counts.filter("words > 0").select("lang", c("phrase").alias("part"), c("n").alias("f"))
    found = counts.filter("words > 1").select("lang", "phrase", "words", c("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.transform(F.sequence(F.lit(1), c("words") - 1), lambda k: F.struct(
        k.alias("cut"), joined(F.lit(1), k).alias("left"), joined(k + 1, c("words") - k).alias("right")))).alias("x")).select(
        "lang", "phrase", "words", "a", "x.*")
    side = lambda name, count: parts.select("lang", c("part").alias(name), c("f").alias(count))
    exact = lambda x: f"CAST({x} AS DECIMAL(15, 0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})")
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    inner = found.filter("words > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), c("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), c("words") - n + 1), lambda i: joined(i, n))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * c("longer") < share * c("a"), F.lit(True)))
    # first the best of each of 32 parts of a language, so that no task ranks all its phrases
    ranked = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("part"))
    best_order = [c("score").desc(), c("a").desc(), c("phrase")]
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best_order))).filter(c("rank") <= top)
    words = counts.filter("words = 0").select("lang", "n")
    return ranked.join(words, "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
