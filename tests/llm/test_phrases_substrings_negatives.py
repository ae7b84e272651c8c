"""Operators 11, 12 and 13 against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlake.llm.collocations import collocations, dictionary, phrase_counts
from regionlake.llm.hard_negatives import Heap, hard_negatives, scores, strassen
from regionlake.llm.substring_dedup import without_repeats
from regionlake.llm.suffix_array import common_prefixes, suffix_array


# ---------------------------------------------------------------- 11
def pieces(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", lower)]


def plain_counts(rows, most):
    out, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            for k in range(1, most + 1):
                out[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return out, total


def plain_collocations(rows, most=3, least=10, share=50, top=2000):
    counts, total = plain_counts(rows, most)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, b in found.items():
            for part in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                longer[part] = max(longer[part], b)
        scored = []
        for p, a in found.items():
            inside = p in longer and 100 * longer[p] >= share * a
            if not inside:
                score, cut = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def phrase_rows(n=400):
    rng = random.Random(11)
    vocabulary = ["New", "york", "city", "the", "é🙂", "of", "A", "b", "tab\x0bword", "x y", "."]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "!?", " \t "]
    rows = [(None, "en"), ("", None), (" . ", "de"), ("word " * 5000, "en")]
    for _ in range(n):
        text = "".join(rng.choices(vocabulary, [9, 8, 7, 6, 2, 3, 2, 2, 1, 1, 1])[0] + rng.choices(seps, [20, 2, 2, 1, 1, 1, 1, 1])[0]
                       for _ in range(rng.randrange(1, 40)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None])))
    return rows + rows[4:40]


@pytest.mark.parametrize("most,every", [(3, 16), (3, 2), (4, 3), (2, 1)])
def test_collocations(frame, most, every):
    rows = phrase_rows()
    found = collocations(frame(rows, "text string, lang string"), most, every=every)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(rows, most)


def test_collocations_top_and_odd_tables(frame, odd, empty):
    rows = phrase_rows()
    found = collocations(frame(rows, "text string, lang string"), top=3, min_count=2, share=100)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 3, 2, 100, 3)
    assert collocations(empty).collect() == []
    texts = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations(odd, min_count=2).collect()) == plain_collocations(texts, least=2)


def test_phrase_counts_are_exact_for_each_language(frame):
    rows = phrase_rows(60)
    counts, total = plain_counts(rows, 3)
    found = {(r.lang, r.phrase): r.n for r in phrase_counts(frame(rows, "text string, lang string"), min_count=2).collect()}
    assert {k: n for k, n in found.items() if k[1] is not None} == {
        (lang, " ".join(p)): n for lang, f in counts.items() for p, n in f.items() if n >= 2}
    assert {lang: n for (lang, p), n in found.items() if p is None and n} == {k: n for k, n in total.items() if n}


def test_chunks_repeat_with_their_passages(frame):
    passage = "one two three four five six seven eight nine ten eleven twelve " * 4
    rows = [("start here " + passage + "end", "en"), ("other words before it " + passage, "en"), (passage, "en")]
    chunks = dictionary(frame(rows, "text string, lang string"), every=3).collect()
    assert max(c.times for c in chunks) >= 3
    by_start = sorted(c.chunk for c in chunks if c.open)
    assert not any(b != a and b.startswith(a + " ") for a, b in zip(by_start, by_start[1:]))


# ---------------------------------------------------------------- 12
def plain_repeats(rows, k=50):
    first, texts = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - k + 1):
            if d is not None:
                first[b[i:i + k]] = min(first.get(b[i:i + k], d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if d is not None and first[b[i:i + k]] < d:
                gone[i:i + k] = b"\1" * k
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), len(spans), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_repeats(docs, *args, **kw):
    rows = without_repeats(docs, *args, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "spans", F.sha2("kept", 256).alias("h"))
    return sorted(((*r[:4], tuple((x.start, x.end) for x in r.spans), r.h) for r in rows.collect()), key=str)


def repeat_rows():
    rng = random.Random(12)
    parts = ["ab", "a", "the quick brown fox jumps over", "é🙂", "\x00x", "zzzz" * 10, " "]
    return [(rng.choice([None, *range(-3, 40)]), None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.randrange(0, 40))))
            for _ in range(90)]


@pytest.mark.parametrize("args", [(50,), (50, 2), (7,)])
def test_substrings(frame, args):
    rows = repeat_rows()
    assert found_repeats(frame(rows, "doc_id long, text string"), *args) == plain_repeats(rows, args[0])


def test_substrings_of_odd_tables(odd, empty):
    assert found_repeats(empty) == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_repeats(odd) == plain_repeats(rows)


@given(st.lists(st.integers(1, 4), max_size=80))
@settings(max_examples=150, deadline=None)
def test_suffix_array_and_common_prefixes(numbers):
    text = numbers + [0]
    array = suffix_array(np.array(text, np.uint16))
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = common_prefixes(np.array(text, np.uint16), array)
    for a, b in zip(array.tolist(), array.tolist()[1:]):
        same = next(i for i, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y)
        assert prefixes[b] == same


# ---------------------------------------------------------------- 13
def plain_negatives(rows, k=5, dims=None):
    whole = lambda v: [math.floor(256 * Fraction(x)) for x in v]
    rows = [(i, v, label) for i, v, label in rows if label is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    rows = [(n, i, whole(v), label) for n, (i, v, label) in enumerate(rows)]
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, i, v, label in rows:
        if i is None or i % 100:
            continue
        score = [(max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -2**63 + 1), j, other) for m, j, w, other in rows if m != n]
        for p, pid, _ in sorted((s for s in score if s[2] == label), key=key)[:k]:
            near = sorted((s for s in score if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=key)[:k]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j, _) in enumerate(near)]
    return sorted(out, key=str)


def found_negatives(frame, rows, kind="double", **kw):
    df = frame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted((tuple(r) for r in hard_negatives(df, **kw).collect()), key=str)


def vectors(n, dims, seed=13):
    rng = random.Random(seed)
    return [(i * 20, [round(rng.gauss(0.3, 0.5), 2) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("dims,group", [(64, 8192), (5, 16), (40, 50)])
def test_negatives(frame, dims, group):
    rows = vectors(150, dims)
    assert found_negatives(frame, rows, group=group) == plain_negatives(rows)


def test_negatives_of_odd_rows(frame):
    rows = vectors(60, 8)
    rows += [(0, rows[0][1], rows[0][2]), (0, rows[0][1], 2), (None, rows[0][1], 1), (100, None, 1), (200, [1.0], None), (300, [None, 1.0], 1),
             (400, [math.nan], 1), (500, [math.inf], 2), (600, [], 1), (700, [1.0, 2.0], 1), (-100, [0.5] * 12, 0), (55, [0.0] * 8, 0)]
    assert found_negatives(frame, rows) == plain_negatives(rows)
    assert found_negatives(frame, []) == []
    assert found_negatives(frame, [(100, [1.0], 1)]) == []


def test_negatives_with_large_numbers(frame):
    rows = [(100, [3e9, 1.0], 1), (1, [2e9, 5.0], 1), (2, [1.9e9, 7.0], 2), (3, [1e30, -1e30], 2), (4, [1.0, 1.0], 2), (200, [1e30, 1.0], 1)]
    assert found_negatives(frame, rows) == plain_negatives(rows)


@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_strassen(m, k, n, leaf):
    rng = np.random.default_rng(m * 10_000 + k * 100 + n)
    a, b = rng.integers(-2**28, 2**28, (m, k)), rng.integers(-2**28, 2**28, (k, n))
    assert (strassen(a, b, leaf) == a @ b).all()
    assert (scores(a, b.T) == a @ b).all()


def test_heaps_of_tiles_merge():
    rng = np.random.default_rng(5)
    score = rng.integers(0, 6, (9, 64))
    allowed = rng.random((9, 64)) < 0.4
    heap = Heap(9, 5)
    for j in range(0, 64, 10):
        heap.push(score[:, j:j + 10], allowed[:, j:j + 10], j)
    for i in range(9):
        want = sorted(((-score[i, j], j) for j in range(64) if allowed[i, j]))[:5]
        assert [j for j in heap.column[i].tolist() if j >= 0] == [j for _, j in want]
