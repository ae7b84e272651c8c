"""Operator 12: strings of bytes that repeat in a later document, from suffix arrays of shards made by content.

1. Whole texts are packed into blocks.  Of each ``min_bytes`` window the least hash of its ``min_bytes // 2``-byte runs is
   its mark; neighbouring windows share theirs (a stretch), and equal windows have equal marks wherever they stand.
2. Marks are added up over all blocks.  A window whose mark stands in one document only is not repeated.
3. Of the other stretches each block sends a digest and the least id of its documents that have them to the shard of their
   mark.  If all stretches of a mark are equal, the least id of all is the first document of their windows.  Stretches of a
   very frequent mark are cut into their windows, and each goes to a shard of its own, so no shard grows with a phrase.
4. Stretches that share a mark with different ones send their bytes.  A shard sorts their suffixes by induced sorting:
   suffixes are classified, the leftmost smaller ones sorted by names that are paired recursively, all others induced from
   them in linear passes.  Where the permuted common prefix is ``min_bytes`` or longer, suffixes begin with one window;
   the least id of such a run is its first document.
5. Each block is told the first document of every window that it sent, and cuts those that have a smaller one than their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textblocks as tb
from .suffix_array import common_prefixes, suffix_array
from .tables import store

c = F.col
BLOCK = 4 << 20
#: digests and, in the second step, bytes a shard gets, as estimates
SHARD = 400_000, 4 << 20
#: stretches of one mark (in all blocks, or 256 blocks) above which they are sent window by window
FREQUENT = 16_384
#: what a block adds to the count of a mark, twice where several of its documents have it
_SEEN = 1 << 23
_PACKED = "block long, n_bytes long, ids binary, known binary, sizes binary, data binary"
_PIECES = "shard int, block long, pieces binary"
_DIGEST = np.dtype([("route", "<u4"), ("digest", "<u8")])
_FIRST = np.dtype([("first", "<i8"), ("met", "?")])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
_BASE = 0x9E3779B97F4A7C15


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, held, size = bl.numbers(), [], 0

    def block():
        rows = pa.concat_tables([pa.Table.from_arrays(x, ["id", "text"]) for x in held]).combine_chunks()
        text, ids = rows["text"].combine_chunks(), rows["id"].combine_chunks()
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        known = np.asarray(ids.is_valid())
        parts = (ids.fill_null(0).to_numpy(), known, np.diff(at), data)
        return pa.RecordBatch.from_arrays([pa.array([next(numbers)]), pa.array([len(data)])] + [
            pa.array([bl.squeeze(x)], pa.binary()) for x in parts], ["block", "n_bytes", "ids", "known", "sizes", "data"])

    for batch in batches:
        text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK - size, "right")) - 1)
            held.append([batch.column(0).slice(i, j - i), text.slice(i, j - i)])
            size += at[min(j, len(text))] - at[i]
            i = j
            if size >= BLOCK or i < len(text):
                yield block()
                held, size = [], 0
    if held:
        yield block()


class _Block:
    """A block's documents and the stretches of their windows."""

    def __init__(self, row: dict, min_bytes: int, frequent: int = FREQUENT):
        self.number = row["block"]
        kinds = {"ids": np.int64, "known": bool, "sizes": np.int64, "data": np.uint8}
        self.ids, self.known, self.sizes, self.data = (bl.expand(row[k], kind) for k, kind in kinds.items())
        self.ends = np.cumsum(self.sizes)
        self.least, self.frequent = min_bytes, frequent

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """mark, place in the block's bytes, number of windows and document of each; rows without an id have none."""
        out = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
        at = np.append(0, self.ends)
        for i, j in tb.blocks(at):
            for a in range(int(at[i]), int(at[j]), tb.BLOCK):
                b = min(int(at[j]), a + tb.BLOCK + self.least - 1)
                if b - a >= self.least:
                    out.append(self._piece(a, b))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _piece(self, a: int, b: int):
        n, k = self.least, max(1, self.least // 2)
        runs = _run_hashes(self.data[a:b], k)
        place = _least_of(runs, n - k + 1)
        good = np.ones(len(place), bool)
        i, j = np.searchsorted(self.ends, [a, b - 1], "right")
        ends = self.ends[i:j + 1] - a
        # windows that run over the end of a document, and documents without an id
        over = (ends[:, None] - 1 - np.arange(n - 1)).ravel()
        good[over[(over >= 0) & (over < len(good))]] = False
        for d in (np.flatnonzero(~self.known[i:j + 1]) + i).tolist():
            good[max(0, self.ends[d] - self.sizes[d] - a):max(0, self.ends[d] - a)] = False
        good = np.flatnonzero(good)
        if not len(good):
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        place = place[good]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(good) != 1)) + 1
        head = np.append(0, cut)
        first = good[head]
        return runs[place[head]], a + first, np.diff(np.append(head, len(good))), np.searchsorted(self.ends, a + first, "right")

    def shared(self, total: np.ndarray) -> _Stretches:
        """Stretches to compare, given the totals of the block's marks."""
        mark, place, n, doc = self.stretches()
        total = total[np.unique(mark, return_inverse=True)[1]]
        both = total >= 2 * _SEEN
        often = both & ((total % _SEEN > self.frequent) | (total >= 256 * _SEEN))
        once = both & ~often
        single = np.repeat(place[often], n[often]) + _up_to(n[often])
        digests = self._digests(place[once], n[once] + self.least - 1), self._digests(single, np.full(len(single), self.least))
        join = lambda a, b: np.concatenate([a[once], b])
        return _Stretches(self, join(mark, digests[1]), np.concatenate(digests), join(place, single), join(n, np.ones(len(single), np.int64)),
                          join(doc, np.repeat(doc[often], n[often])))

    def _digests(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes that begin in ascending order."""
        out = [np.zeros(0, np.uint64)]
        for i in range(0, len(place), 16_384):
            a, n = place[i:i + 16_384], size[i:i + 16_384]
            low = a[0]
            data = self.data[low:(a + n).max()].astype(np.uint64) + np.uint64(1)
            steps = lambda base: np.multiply.accumulate(np.append(np.uint64(1), np.full(len(data), base, np.uint64)))
            sums = np.append(np.uint64(0), np.cumsum(data * steps(_BASE)[:-1], dtype=np.uint64))
            value = (sums[a - low + n] - sums[a - low]) * steps(pow(_BASE, -1, 1 << 64))[a - low]
            out.append(tb.mix(value + n.astype(np.uint64)))
        return np.concatenate(out)


class _Stretches:
    """Occurrences (place, n windows, document) and the different stretches among them, each with one of its places."""

    def __init__(self, block: _Block, mark, digest, place, n, doc):
        self.block, self.place, self.n, self.doc = block, place, n, doc
        order = np.lexsort((digest, mark))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (mark[order[1:]] != mark[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        self.mark, self.digest, self.at, self.windows = mark[one], digest[one], place[one], n[one]

    def first(self) -> np.ndarray:
        out = np.full(len(self.mark), np.iinfo(np.int64).max)
        np.minimum.at(out, self.which, self.block.ids[self.doc])
        return out

    def texts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.windows[some] + self.block.least - 1
        return size, self.block.data[np.repeat(self.at[some], size) + _up_to(size)]

    def by_shard(self, shards: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretches in order of their shards, and where each shard begins."""
        some = np.arange(len(self.mark)) if some is None else some
        shard = (tb.mix(self.mark[some]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return some[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _up_to(n: np.ndarray) -> np.ndarray:
    """0, 1, … of each run of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _run_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, put together from runs of doubled length."""
    power = lambda e: np.uint64(pow(_BASE, e, 1 << 64))
    run, size, n = data.astype(np.uint64) + np.uint64(1), 1, len(data) - k + 1
    value, done = np.zeros(n, np.uint64), 0
    while True:
        if k & size:
            value += run[done:done + n] * power(done)
            done += size
        if 2 * size > k:
            return tb.mix(value)
        run, size = run[:-size] + run[size:] * power(size), 2 * size


def _least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w values in a row, the first one of those with equal upper bits."""
    bits = np.uint64(max(1, len(x) - 1).bit_length())
    x, span = x >> bits << bits | np.arange(len(x), dtype=np.uint64), 1
    while span < w:
        step = min(span, w - span)
        x, span = np.minimum(x[step:], x[:-step]), span + step
    return (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _marks(min_bytes: int, frequent: int, parts: int):
    """Of each block its different marks, how often each stands there, and whether in several documents."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, min_bytes, frequent)
                mark, _, _, doc = block.stretches()
                keys, which, count = np.unique(mark, return_inverse=True, return_counts=True)
                least, most = np.full(len(keys), len(block.ids)), np.full(len(keys), -1)
                np.minimum.at(least, which, doc)
                np.maximum.at(most, which, doc)
                yield bl.asked(block.number, keys, np.minimum(count, frequent + 1) + np.where(least < most, 2 * _SEEN, _SEEN), parts)

    return ask


def _sender(min_bytes: int, frequent: int, shards: int, body):
    """Rows of ``_PIECES``: for each shard what ``body`` says of the block's stretches that go there."""
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [], [], []
        for row in rows.to_pylist():
            block = _Block(row, min_bytes, frequent)
            x = block.shared(bl.answered(_about(answers, 0), np.uint32))
            order, cuts, pack = body(x, answers)
            for s in np.flatnonzero(np.diff(cuts)):
                for column, value in zip(out, (int(s), block.number, pack(order[cuts[s]:cuts[s + 1]]))):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int32(), pa.int64(), pa.binary()))],
                                    ["shard", "block", "pieces"])

    return send


def _about(answers: pa.Table, step: int) -> pa.Table:
    return answers.filter(pa.array(np.asarray(answers["step"]) == step))


def _ids(first: np.ndarray) -> bytes:
    """Ids as differences from the least one, in four bytes each if they fit."""
    low = first.min()
    apart = (first - low).astype(np.uint64)
    short = int(apart.max()) < 1 << 32
    return int(low).to_bytes(8, "little", signed=True) + bytes([short]) + apart.astype("<u4" if short else "<u8").tobytes()


def _read_ids(data: pa.Buffer, n: int) -> tuple[np.ndarray, int]:
    head = data[:9].to_pybytes()
    kind = np.dtype("<u4" if head[8] else "<u8")
    apart = np.frombuffer(data, kind, n, 9).astype(np.int64)
    return apart + int.from_bytes(head[:8], "little", signed=True), 9 + n * kind.itemsize


def _digests(shards: int):
    def body(x: _Stretches, answers: pa.Table):
        first = x.first()

        def pack(some: np.ndarray) -> bytes:
            head = np.empty(len(some), _DIGEST)
            head["route"], head["digest"] = x.mark[some].astype(np.uint32), x.digest[some]
            # not compressed here: small runs would compress the worse the more shards there are
            return len(some).to_bytes(4, "little") + head.tobytes() + _ids(first[some])

        return *x.by_shard(shards), pack

    return body


def _texts(shards: int, shards2: int):
    def body(x: _Stretches, answers: pa.Table):
        first, met = x.first(), _met(x, answers, shards)

        def pack(some: np.ndarray) -> bytes:
            size, data = x.texts(some)
            return len(some).to_bytes(4, "little") + size.astype("<u4").tobytes() + _ids(first[some]) + data.tobytes()

        return *x.by_shard(shards2, np.flatnonzero(met["met"])), pack

    return body


def _met(x: _Stretches, answers: pa.Table, shards: int) -> np.ndarray:
    """Per stretch the answer of the first step: the least id, and whether its mark has other stretches."""
    order, _ = x.by_shard(shards)
    out = np.empty(len(order), _FIRST)
    out[order] = bl.answered(_about(answers, 1), _FIRST)
    return out


def _compare(rows: pa.Table) -> pa.Table:
    """The least id of equal stretches, and whether their mark has others; answered to each block."""
    sizes, heads, firsts = [], [], []
    for x in rows["pieces"]:
        data = x.as_buffer()
        n = int.from_bytes(data[:4].to_pybytes(), "little")
        heads.append(np.frombuffer(data, _DIGEST, n, 4))
        firsts.append(_read_ids(data[4 + heads[-1].nbytes:], n)[0])
        sizes.append(n)
    head, first = np.concatenate(heads), np.concatenate(firsts)
    order = np.lexsort((head["digest"], head["route"]))
    route, digest = head["route"][order], head["digest"][order]
    fresh_mark = np.append(True, route[1:] != route[:-1])
    fresh = fresh_mark | np.append(True, digest[1:] != digest[:-1])
    group, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    mark = np.cumsum(fresh_mark) - 1
    ways = np.bincount(mark[starts])
    out = np.empty(len(order), _FIRST)
    out["first"][order] = np.minimum.reduceat(first[order], starts)[group]
    out["met"][order] = ways[mark] > 1
    answers = [bl.squeeze(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([rows["block"], rows["shard"], pa.array(answers, pa.binary())], schema=bl.ANSWERS)


def _sort(min_bytes: int):
    """The first document of each window of stretches that share a mark, answered to each block."""
    def sort(rows: pa.Table) -> pa.Table:
        sizes, firsts, texts = [], [], []
        for x in rows["pieces"]:
            data = x.as_buffer()
            n = int.from_bytes(data[:4].to_pybytes(), "little")
            sizes.append(np.frombuffer(data, "<u4", n, 4).astype(np.int64))
            data = data[4 + 4 * n:]
            first, after = _read_ids(data, n)
            firsts.append(first)
            texts.append(np.frombuffer(data, np.uint8, offset=after))
        size, first = np.concatenate(sizes), np.concatenate(firsts)
        at = np.append(0, np.cumsum(size))
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(texts))]).dictionary_encode()
        which, own = coded.indices.to_numpy(), coded.dictionary
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, which, first)
        windows = np.diff(np.frombuffer(own.buffers()[1], np.int64, len(own) + 1)) - min_bytes + 1
        start = np.cumsum(windows) - windows
        place = _least_by_suffix(own, least, min_bytes)
        answers, i = [], 0
        for s in sizes:
            n = s - min_bytes + 1
            answers.append(bl.squeeze(place[np.repeat(start[which[i:i + len(s)]], n) + _up_to(n)]))
            i += len(s)
        return pa.Table.from_arrays([rows["block"], rows["shard"], pa.array(answers, pa.binary())], schema=bl.ANSWERS)

    return sort


def _least_by_suffix(texts: pa.Array, least: np.ndarray, min_bytes: int) -> np.ndarray:
    """For each window of each text the smallest ``least`` of the texts that have it, from their suffix array."""
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    size, bytes_ = np.diff(at), np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
    # texts in a row, a 1 behind each and a 0 behind all; bytes are numbered from 2
    line = np.ones(len(bytes_) + len(texts) + 1, np.uint16)
    start = np.cumsum(size + 1) - size - 1
    line[np.repeat(start, size) + _up_to(size)] = bytes_.astype(np.uint16) + np.uint16(2)
    line[-1] = 0
    array = suffix_array(line)
    fresh = common_prefixes(line, array)[array] < min_bytes
    owner = np.append(np.repeat(least, size + 1), np.iinfo(np.int64).max)
    group = np.minimum.reduceat(owner[array], np.flatnonzero(fresh))
    out = np.empty(len(line), np.int64)
    out[array] = group[np.cumsum(fresh) - 1]
    n = size - min_bytes + 1
    return out[np.repeat(start, n) + _up_to(n)]


def _cut(min_bytes: int, frequent: int, shards: int, shards2: int):
    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            block = _Block(row, min_bytes, frequent)
            x = block.shared(bl.answered(_about(answers, 0), np.uint32))
            out.append(_result(block, _removed(x, answers, shards, shards2)))
        return pa.concat_tables(out)

    return cut


def _removed(x: _Stretches, answers: pa.Table, shards: int, shards2: int) -> np.ndarray:
    """Which of the block's bytes go."""
    block = x.block
    cover = np.zeros(len(block.data) + 1, np.int32)
    if len(x.mark):
        met = _met(x, answers, shards)
        at = np.cumsum(x.windows) - x.windows
        first = np.repeat(met["first"], x.windows)
        order, _ = x.by_shard(shards2, np.flatnonzero(met["met"]))
        n = x.windows[order]
        first[np.repeat(at[order], n) + _up_to(n)] = bl.answered(_about(answers, 2), np.int64)
        step = 1 << 15
        for i in range(0, len(x.n), step):  # half a million windows at a time
            n, up = x.n[i:i + step], _up_to(x.n[i:i + step])
            gone = first[np.repeat(at[x.which[i:i + step]], n) + up] < np.repeat(block.ids[x.doc[i:i + step]], n)
            window = (np.repeat(x.place[i:i + step], n) + up)[gone]
            cover[window] += 1
            cover[window + block.least] -= 1
    return np.cumsum(cover[:-1], dtype=np.int32) > 0


def _result(block: _Block, gone: np.ndarray) -> pa.Table:
    at = np.append(0, block.ends)
    taken = np.append(np.int32(0), np.cumsum(gone, dtype=np.int32))
    n_removed = (taken[at[1:]] - taken[at[:-1]]).astype(np.int64)
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = at[:-1][block.sizes > 0]
    edge[starts] = gone[starts]
    begin = np.flatnonzero(edge)
    last = gone.copy()
    last[:-1] &= ~gone[1:]
    last[starts[1:] - 1] = gone[starts[1:] - 1]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(block.ends, begin, "right")
    n_spans = np.bincount(doc, minlength=len(block.sizes))
    spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(n_spans)).astype(np.int32), pa.StructArray.from_arrays(
        [pa.array(begin - at[doc]), pa.array(end - at[doc])], ["start", "end"]))
    size = block.sizes - n_removed
    kept = pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(block.data[~gone]))])
    ids = pa.array(block.ids, mask=~block.known)
    return pa.Table.from_arrays([ids, pa.array(block.sizes), pa.array(n_removed), pa.array(n_spans), spans, kept.cast(pa.binary())],
                                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def without_repeats(docs: DataFrame, min_bytes: int = 50, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs, bytes) and kept (the rest).

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts in a document with a smaller id.  A null text
    is empty.  Rows that share an id are not earlier than each other; a row without an id stays whole and is earlier than
    none.  Kept bytes can begin or end within a character.  ``frequent`` (below 2**15) does not change the result.
    """
    total = bl.text_bytes(docs, text_col)
    rows = docs.select(c(f"`{id_col}`").cast("long").alias("id"), F.coalesce(c(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    packed = bl.store_blocks(rows.mapInArrow(_pack, _PACKED), "blocks", total)
    parts = 1 + total * 4 // min_bytes // bl.PART
    marks = store(bl.totals(packed.mapInArrow(_marks(min_bytes, frequent, parts), bl.SENT)).withColumn("step", F.lit(0)), "marks")
    shards = 1 + _number(marks, np.uint32, lambda x: x >= 2 * _SEEN) // SHARD[0]
    pieces = bl.with_answers(packed, marks, _sender(min_bytes, frequent, shards, _digests(shards)), _PIECES)
    equal = store(pieces.groupBy("shard").applyInArrow(_compare, bl.ANSWER).withColumn("step", F.lit(1)), "equal")
    shards2 = 1 + _number(equal, _FIRST, lambda x: x["met"]) * min_bytes * 3 // 2 // SHARD[1]
    known = marks.union(equal)
    pieces = bl.with_answers(packed, known, _sender(min_bytes, frequent, shards2, _texts(shards, shards2)), _PIECES)
    firsts = store(pieces.groupBy("shard").applyInArrow(_sort(min_bytes), bl.ANSWER).withColumn("step", F.lit(2)), "firsts")
    return bl.with_answers(packed, known.union(firsts), _cut(min_bytes, frequent, shards, shards2), RESULT)


def _number(answers: DataFrame, kind, which) -> int:
    """How many of all answers are of some kind."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(which(bl.expand(x.as_py(), kind)).sum()) for b in batches for x in b.column(0))])], ["n"])

    return answers.select("answer").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
