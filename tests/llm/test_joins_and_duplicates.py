"""Operators 1, 5, 6 and 7 against plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from regionlake.llm import ngram_join, textblocks
from regionlake.llm.components import connected_components
from regionlake.llm.decontamination import contained_items
from regionlake.llm.line_dedup import dedup_lines, without_lines
from regionlake.llm.ngram_join import ngram_jaccard_join
from regionlake.llm.passage_dedup import repeated_passages, without_passages

VOCAB = [f"w{i}" for i in range(400)]


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_corpus(rng, n=40):
    texts = []
    for _ in range(n):
        w = rng.choices(VOCAB, k=rng.choice([3, 5, 12, 60, 200]))
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 4])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 3])):
                v[rng.randrange(len(v))] = rng.choice(VOCAB)
            texts.append(" ".join(v))
    return texts


def expected_groups(rows, threshold=0.8):
    sets = {i: shingles(t or "") for i, t in rows}
    text = dict(rows)
    root = {i: i for i in sets}
    links, docs = {i: set() for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            docs[a] += 1
            docs[b] += 1
            if text[a] != text[b]:
                links[a].add(text[b])
                links[b].add(text[a])
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), len(links[i]), docs[i]) for i in sets}


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join(frame, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    rows = list(enumerate(near_corpus(random.Random(3))))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_linked_docs) for r in ngram_jaccard_join(frame(rows)).collect()}
    assert got == expected_groups(rows)
    assert len({v[0] for v in got.values()}) < len(rows)


def test_jaccard_join_dense_group(frame, monkeypatch):
    """A group in which nearly all texts are linked and differ: links are counted over pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 16)
    rng = random.Random(5)
    base = rng.choices(VOCAB, k=150)
    texts = []
    for i in range(90):
        v = list(base)
        v[rng.randrange(150)] = f"own{i}"
        texts.append(" ".join(v))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_linked_docs) for r in ngram_jaccard_join(frame(rows)).collect()}
    assert got == expected_groups(rows)


@pytest.mark.parametrize(("n", "shingles_a_block"), [(2, 150), (5, 100)])
def test_jaccard_join_empty_blocks(frame, monkeypatch, n, shingles_a_block):
    """Few texts over several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles_a_block)
    base = random.Random(6).choices(VOCAB, k=150)
    rows = [(i, " ".join([*base[:-1], f"own{i}"])) for i in range(n)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_linked_docs) for r in ngram_jaccard_join(frame(rows)).collect()}
    assert got == expected_groups(rows)


def test_links_of_a_pair_with_an_empty_block():
    text = " ".join(VOCAB[:150])
    rows = {"key": [0, 0], "i": [0, 0], "j": [0, 0], "block": [0, 0], "n_blocks": [2, 2], "copy_id": [0, 1], "n_copies": [1, 1], "text": [text + " a", text + " b"]}
    count = lambda **change: next(ngram_join._Verify(0.8)([pa.RecordBatch.from_pydict(rows | change)])).column("links").to_pylist()
    assert count() == [1, 1] and count(j=[1, 1]) == [0, 0]


def test_jaccard_join_odd(odd, empty):
    rows = ngram_jaccard_join(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[None].class_id is None and by[None].n_links == 0
    assert by[2].class_id == 2 and by[3].class_id == 3 and by[6].class_id == 6
    assert by[5].class_id == 4 and by[4].n_links == 1
    assert by[1].n_copies == 2 and by[1].class_id == 1
    assert ngram_jaccard_join(empty).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = ngram_join._least_matches(0.8, 1e-6)
    assert len(least) == 8 and all(0 < m <= 16 * (k + 1) * 0.8 for k, m in enumerate(least))
    rng = np.random.default_rng(1)
    lost = sum((np.cumsum(rng.random(128) < 0.8).reshape(8, 16)[:, -1] < least).any() for _ in range(20_000))
    assert lost < 20


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["", "one", "a b\tc\n d  e f", None, "é ü x ß", " \n", "a b c d e f"]
    data, at = textblocks.buffers(pa.array(texts))
    hashes, counts = textblocks.hash_words(data, at)
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    sets = list(textblocks.text_shingles(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles((t or "").replace(" ", "_"))) for t in texts]
    assert set(sets[2]) == set(sets[6]) and len(hashes) == sum(counts)
    sliced = list(textblocks.text_shingles(pa.array(texts).slice(2, 3)))
    assert [s.tolist() for s in sliced] == [s.tolist() for s in sets[2:5]]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200, 200), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1:] or a[p + 1:] == b[p + 1:]


def expected_lines(rows, min_chars=20):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        keep = []
        for no, raw in enumerate(text.split("\n")):
            line = " ".join(raw.split()).lower()
            gone = bool(line) and (line in seen or len(line) >= min_chars and any(
                len(x) >= min_chars and within_one(line, x) for x in seen))
            if line:
                seen.setdefault(line, (doc, no))
            if not gone:
                keep.append(raw)
        out[doc] = "\n".join(keep)
    return out


def edited(rng, line):
    p = rng.randrange(len(line) + 1)
    return rng.choice([line[:p] + rng.choice("abcxyz") + line[p:], line[:p] + line[p + 1:], line[:p] + rng.choice("abcxyz") + line[p + 1:], line])


def test_line_dedup(frame):
    rng = random.Random(9)
    lines = [" ".join(rng.choices(VOCAB, k=rng.choice([2, 4, 6, 8, 130, 300]))) for _ in range(30)]
    pool = lines + ["", " ", "short", "shorts"] + [edited(rng, x) for x in lines for _ in range(4)] + [edited(rng, edited(rng, x)) for x in lines]
    pool += ["a" * 30, "a" * 31, "a" * 29 + "b", "ab" * 15, "ba" * 15, "A" * 30 + " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.choice([1, 3, 8])))) for i in range(80)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(rows)).collect()}
    assert got == expected_lines(rows)
    assert sum(r.n_near for r in dedup_lines(frame(rows)).collect()) > 10


def test_line_dedup_many_variants_of_one_line(frame):
    """Hundreds of lines that share one deletion variant: only the earliest stays."""
    base = "this line stands in the corpus in hundreds of forms"
    rows = [(i, base[:p] + ch + base[p:]) for i, (p, ch) in enumerate(itertools.product(range(len(base)), "qxz07"))]
    got = {r.doc_id: r.text for r in dedup_lines(frame(rows)).collect()}
    assert got == expected_lines(rows)


def test_line_dedup_odd(odd, empty):
    rows = dedup_lines(odd).collect()
    by = {r.doc_id: r.text for r in rows}
    assert len(rows) == 10 and by[1] == "" and by[2] == "" and by[3] == "" and by[6] == " \n \t\n"
    assert by[None].startswith("The mill") and by[7] == "" and by[4] and by[5]
    assert set(without_lines(odd).columns) == {*odd.columns, "n_near"}
    assert dedup_lines(empty).count() == 0


def test_decontamination(frame):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(VOCAB, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 30, 59, 120])]
    items += [(50, items[7][1]), (51, None), (52, "")]
    docs = []
    for i in range(120):
        w = rng.choices(VOCAB, k=rng.choice([0, 4, 50, 400]))
        part = rng.choice(items)[1] or ""
        part = part.upper().split() if rng.random() < 0.3 else part.split()
        if part and rng.random() < 0.6:
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.choice([0, -1])] = "other"
            p = rng.randrange(len(w) + 1)
            w[p:p] = part
        docs.append((i, " ".join(w)))
    want = set()
    for i, q in items:
        q = (q or "").lower()
        k = min(5, len(q.split()))
        if k:
            s = shingles(q, k)
            for d, t in docs:
                t = t.lower().split()
                n = len(s & {tuple(t[j:j + k]) for j in range(len(t) - k + 1)})
                if n / len(s) >= 0.8:
                    want.add((d, i, n, len(s)))
    found = contained_items(frame(docs), frame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()} == want and len(want) > 20


def test_decontamination_by_shuffles(frame, monkeypatch):
    from regionlake.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    docs, items = [(i, " ".join(VOCAB[i:i + 40])) for i in range(20)], [(0, " ".join(VOCAB[10:40])), (1, " ".join(VOCAB[30:45]))]
    found = contained_items(frame(docs), frame(items, "item_id long, text string"))
    want = {(d, i) for i, q in items for d, t in docs if len(shingles(q) & shingles(t)) >= 0.8 * len(shingles(q))}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want


def test_decontamination_odd(odd, empty, frame):
    items = frame([(1, "turned slowly all day. Nobody had counted"), (None, "x"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contained_items(odd, items).collect()} == {(1, 1), (7, 1)}
    assert contained_items(empty, items).count() == 0
    assert contained_items(odd, frame([], "item_id long, text string")).count() == 0


def test_passages(frame):
    rng = random.Random(8)

    def sentence():
        return " ".join(rng.choices(VOCAB, k=rng.randrange(6, 12))).capitalize() + "."

    passage = " ".join(sentence() for _ in range(8))
    docs = []
    for i in range(30):
        s = [sentence() for _ in range(6)]
        text = " ".join(s[:3]) + f" and{i} then " + (passage + " " if i % 3 == 0 else "") + f"it{i} went on. " + "\n".join(s[3:]) + "\nThe usual end."
        docs.append((i, text))
    found = repeated_passages(frame(docs)).collect()
    assert {r.doc_id for r in found} == {i for i in range(3, 30, 3)}
    for r in found:
        assert dict(docs)[r.doc_id][r.start:r.end].startswith(passage) and r.first_doc_id == 0
        assert dict(docs)[0][r.first_start:].startswith(passage)
    left = {r.doc_id: r.text for r in without_passages(frame(docs), repeated_passages(frame(docs))).collect()}
    assert passage in left[0] and all(passage not in left[i] for i in range(1, 30))
    assert left[1] == dict(docs)[1]


@pytest.mark.parametrize("units", ["line", "paragraph"])
def test_passages_of_lines_and_paragraphs(frame, units):
    text = " ".join(VOCAB[:60])
    gap = "\n" if units == "line" else "\n \n"
    docs = [(1, "One" + gap + text), (2, text.upper() + gap + "Two é"), (3, "Zwö" + gap + text + gap + "end")]
    got = {(r.doc_id, r.start, r.end) for r in repeated_passages(frame(docs), units=units).collect()}
    at = len("Zwö" + gap)
    assert got == {(2, 0, len(text)), (3, at, at + len(text))}


def test_passages_odd(odd, empty):
    got = {(r.doc_id, r.first_doc_id) for r in repeated_passages(odd, min_words=20).collect()}
    assert got == {(5, 4), (7, 1)} or got == {(7, 1)}
    assert without_passages(odd, repeated_passages(odd, min_words=20)).count() == 10
    assert repeated_passages(empty).count() == 0


def test_passages_begin_and_end_anywhere(frame):
    """Runs that start and end within sentences, in one line without full stop or capital, and none that is a word too short."""
    rng = random.Random(9)
    fill = lambda n: " ".join(f"z{rng.random()}" for _ in range(n))
    shared = {n: " ".join(rng.choices(VOCAB, k=n)) for n in (50, 51, 60, 79)}
    docs, want = [], set()
    for n, (i, words) in enumerate(shared.items()):
        for copy in range(3):
            a, b = fill(20 + 7 * n + copy) + f" É{copy} ", " " + fill(30)
            docs.append((10 * i + copy, a + (words.upper() if copy == 2 else words) + b))
            if copy and i > 50:
                want.add((10 * i + copy, len(a), len(a) + len(words), i, 10 * i))
    # the first document shares only the middle of what the later two share
    middle, around = " ".join(rng.choices(VOCAB, k=40)), [" ".join(rng.choices(VOCAB, k=15)) for _ in range(2)]
    docs += [(1, middle), (2, fill(60) + " " + " ".join([around[0], middle, around[1]])), (3, " ".join([around[0], middle, around[1]]) + " " + fill(60))]
    want.add((3, 0, len(" ".join([around[0], middle, around[1]])), 70, 2))
    found = repeated_passages(frame(docs)).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in found} == want
    for r in found:
        assert dict(docs)[r.first_doc_id][r.first_start:].lower().startswith(dict(docs)[r.doc_id][r.start:r.end].lower())
    # every window of 51 words that a plain search finds, and no other
    rng, docs = random.Random(10), []
    pool = [" ".join(rng.choices(VOCAB[:60], k=rng.randrange(30, 90))) for _ in range(12)]
    for i in range(60):
        docs.append((i, " ".join(" ".join(p[rng.randrange(8):]) for p in (x.split() for x in rng.sample(pool, 3)))))
    seen, want = {}, set()
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 50):
            if seen.setdefault(tuple(w[k:k + 51]), (i, k)) != (i, k):
                want |= {(i, x) for x in range(k, k + 51)}
    got = set()
    for r in repeated_passages(frame(docs)).collect():
        at = len(dict(docs)[r.doc_id][:r.start].split())
        got |= {(r.doc_id, x) for x in range(at, at + r.n_words)}
    trimmed = want - got
    assert got <= want and want and not trimmed
