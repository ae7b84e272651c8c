"""The pipeline's stages, each on what the one before it kept, against plain Python."""

from collections import Counter

import corpus_pipeline
import pytest
from test_joins_and_duplicates import expected_groups, expected_lines, shingles
from test_scores_and_scans import expected_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from regionlake.llm.tables import store, table

    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), f"test_{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    assert all(set(df.columns) == set(corpus_pipeline.COLUMNS) for df in steps[:-1])


def test_quality_keeps_clean_documents(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) <= set(before) and all(after[i].text == before[i].text for i in after)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} & set(before)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()} & set(before)
    assert len(good & set(after)) >= 0.97 * len(good) and len(bad & set(after)) <= 0.2 * len(bad)


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = expected_lines([(i, r.text) for i, r in before.items()])
    want = {i: t for i, t in want.items() if t.split() or t == before[i].text}
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicates(steps):
    before, after = rows(steps[2]), rows(steps[3])
    groups = expected_groups([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (group, *_) in groups.items() if group == i}


def test_decontamination(spark, steps):
    before, after = rows(steps[3]), rows(steps[4])
    items = [shingles(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, r in before.items() if any(len(s & shingles(r.text.lower())) >= 0.8 * len(s) for s in items)}
    assert set(after) == set(before) - dirty


def test_mix(steps):
    before, mix = rows(steps[4]), steps[5].collect()
    size = {i: len(r.text.split()) for i, r in before.items()}
    total, taken, largest = Counter(), Counter(), Counter()
    for i, r in before.items():
        total[r.source] += size[i]
        largest[r.source] = max(largest[r.source], size[i])
    for r in mix:
        assert r.text == before[r.doc_id].text and r.size == size[r.doc_id] and r.taken == r.copies * r.size and 1 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, target in expected_targets(total).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6


def test_odd_tables(spark, odd, empty, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd, empty):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == names
        last = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
        assert last.count() >= 0


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
