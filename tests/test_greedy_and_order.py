"""Ordered scans and greedy selection against brute force, on both sides of the group limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionlake.operators import greedy, lines, metering, ordered, regions

BOX = "page_no long, idx int, id string, x double, y double, w double, h double, confidence double, kind string"


def boxes(rng, n, pages=2, copies=0):
    rows = []
    for i in range(n):
        x, y = rng.integers(0, 60, 2)
        w, h = rng.integers(5, 60, 2)
        rows.append((int(rng.integers(0, pages)), i, f"b{i}", float(x), float(y), float(w), float(h),
                     float(rng.integers(0, 20)) / 20, "display"))
    rows += [(0, n + i, f"c{i}", 3.0, 3.0, 30.0, 20.0, 0.5, "inline") for i in range(copies)]
    rows.append((0, n + copies, "flat", 3.0, 3.0, 0.0, 20.0, 0.9, "inline"))
    return rows


def inter(a, b):
    dx = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    dy = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])
    return dx * dy if dx > 0 and dy > 0 else 0.0


def iou(a, b):
    i = inter(a, b)
    u = a[5] * a[6] + b[5] * b[6] - i
    return i / u if u > 0 else 0.0


def overlap(a, b):
    i = inter(a, b)
    return i / min(a[5] * a[6], b[5] * b[6]) if i else 0.0


@pytest.mark.parametrize("limit", [1000, 4])
@pytest.mark.parametrize("seed", [0, 1])
def test_nms(spark, limit, seed):
    rows = boxes(np.random.default_rng(seed), 50, copies=12)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if not any(k[0] == r[0] and iou(k, r) > 0.5 for k in kept):
            kept.append(r)
    got = greedy.nms(spark.createDataFrame(rows, BOX), limit=limit).collect()
    assert sorted(r.id for r in got) == sorted(r[2] for r in kept)


def test_nms_cases(spark):
    def run(*items):
        rows = [(1, i, str(i), float(x), float(y), 50.0, 20.0, conf, "inline") for i, (x, y, conf) in enumerate(items)]
        return sorted(r.confidence for r in greedy.nms(spark.createDataFrame(rows, BOX)).collect())

    assert run((100, 100, 0.9), (102, 101, 0.85)) == [0.9]
    assert run((100, 100, 0.9), (130, 100, 0.85)) == [0.85, 0.9]
    assert run((100, 100, 0.8), (101, 101, 0.95)) == [0.95]


@pytest.mark.parametrize("limit", [1000, 4])
@pytest.mark.parametrize("seed", [2, 3])
def test_merge_overlaps(spark, limit, seed):
    rows = boxes(np.random.default_rng(seed), 40, copies=9)
    want = []
    for page in {r[0] for r in rows}:
        todo = sorted((r for r in rows if r[0] == page), key=lambda r: r[1])
        while todo:
            seed_row, rest = todo[0], todo[1:]
            group = [seed_row] + [r for r in rest if overlap(seed_row, r) > 0.3]
            x, y = min(r[3] for r in group), min(r[4] for r in group)
            want.append((page, seed_row[1], x, y, max(r[3] + r[5] for r in group) - x,
                         max(r[4] + r[6] for r in group) - y, len(group)))
            todo = [r for r in rest if r not in group]
    got = greedy.merge_overlaps(spark.createDataFrame(rows, BOX), limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_blocks_equal_windows(spark, keys):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.3), int(rng.integers(0, 9)), i, int(rng.integers(-5, 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, i int, v int")
    out = ordered.scan(df, keys, ["o", "i"], number="n", previous={"p": "v"}, sums={"s": "v"}, maxs={"m": "v"}, limit=10, blocks=7)
    pdf = pd.DataFrame(rows, columns=["k", "o", "i", "v"]).sort_values(["o", "i"])
    g = pdf.groupby("k" if keys else (pdf.k * 0), sort=False)
    pdf = pdf.assign(n=g.cumcount() + 1, p=g.v.shift(), s=g.v.cumsum(), m=g.v.cummax())
    want = {r.i: (r.n, None if pd.isna(r.p) else int(r.p), r.s, r.m) for r in pdf.itertuples()}
    assert {r.i: (r.n, r.p, r.s, r.m) for r in out.collect()} == want


@pytest.mark.parametrize("limit", [1000, 10])
def test_scan_over_more_tasks(spark, limit):
    """Rows dealt to many tasks, or cut into many blocks, give what a window gives; keys may be null, tables empty."""
    rng = np.random.default_rng(9)
    rows = [(int(k) or None, i, int(rng.integers(-5, 50))) for i, k in enumerate(rng.integers(0, 40, 600))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    columns = dict(number="n", previous={"p": "v"}, sums={"s": "v"}, maxs={"m": "v"}, limit=limit)
    out = ordered.scan(df, ["k"], ["i"], task_rows=20, **columns)
    want = {}
    for k in {r[0] for r in rows}:
        seen = []
        for _, i, v in (r for r in rows if r[0] == k):
            want[i] = (len(seen) + 1, seen[-1] if seen else None, sum(seen) + v, max([*seen, v]))
            seen.append(v)
    assert {r.i: (r.n, r.p, r.s, r.m) for r in out.collect()} == want
    if limit == 1000:
        assert out.rdd.getNumPartitions() == 30
    assert ordered.scan(df.filter("i < 0"), ["k"], ["i"], task_rows=20, **columns).isEmpty()


@pytest.mark.parametrize("limit", [1000, 5])
def test_reading_order(spark, limit):
    rows = boxes(np.random.default_rng(7), 40)
    got = {(r.page_no, r.id): (r.line_no, r.position) for r in regions.reading_order(spark.createDataFrame(rows, BOX), limit=limit).collect()}
    for page in {r[0] for r in rows}:
        here = sorted((r for r in rows if r[0] == page), key=lambda r: (r[4], r[2]))
        line, lines_ = 1, []
        for a, b in zip([None, *here], here):
            line += a is not None and b[4] - a[4] > 20
            lines_.append((line, b[3], b[2]))
        for pos, (ln, _, i) in enumerate(sorted(lines_), 1):
            assert got[page, i] == (ln, pos)


@pytest.mark.parametrize("limit", [10_000, 20])
def test_text_line_context(spark, limit):
    rng = np.random.default_rng(11)
    rows = boxes(rng, 20, pages=3)
    text = [(p, i, float(rng.integers(0, 120)), float(rng.integers(4, 20))) for p in (0, 1) for i in range(15)]
    out = lines.text_line_context(
        spark.createDataFrame(rows, BOX), spark.createDataFrame(text, "page_no long, line_no int, line_y double, line_h double"), limit=limit)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        here = [t for t in text if t[0] == r[0]]
        y, h, mid = r[4], r[6], r[4] + r[6] / 2
        g = got[r[2]]
        assert g.n_lines == len(here)
        assert g.space_above == (not any(y - h * 0.5 < t[2] + t[3] < y for t in here))
        assert g.space_below == (not any(y + h < t[2] < y + h * 1.5 for t in here))
        assert g.overlaps_line == any(not (y + h < t[2] or y > t[2] + t[3]) for t in here)
        assert g.n_near == sum(abs(mid - (t[2] + t[3] / 2)) < t[3] * 2 for t in here)
        best = min(here, key=lambda t: (abs(mid - (t[2] + t[3] / 2)), t[1]), default=None)
        assert g.near_no == (best[1] if best else None)


def _chain(times, gap=60):
    last, out = None, set()
    for t, e in sorted(times):
        if last is None or t - last >= gap:
            last = t
            out.add(e)
    return out


@pytest.mark.parametrize("limit", [1000, 5])
def test_rate_limit(spark, limit):
    rng = np.random.default_rng(13)
    rows, want, e = [], set(), 0
    for mail in ("a@b.c", "d@e.f"):
        times = []
        for _ in range(80):
            times.append((int(rng.integers(0, 1500)), e))
            e += 1
        rows += [(mail, ev, t) for t, ev in times]
        want |= _chain(times)
    df = spark.createDataFrame(rows, "email string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = metering.send_rate_limit(df, limit=limit)
    assert {r.event_id for r in got.filter("accepted").collect()} == want
    assert got.count() == len(rows)


@pytest.mark.parametrize("limit", [1000, 3])
def test_merge_by_position(spark, limit):
    rng = np.random.default_rng(17)
    make = lambda n, off: [(1, off + i, f"r{off + i}", float(rng.integers(0, 2)), 0.0, 1.0, 1.0,
                            None if rng.random() < 0.1 else float(rng.integers(0, 60)) / 60, bool(rng.random() < 0.5)) for i in range(n)]
    schema = "page_no long, seq int, id string, x double, y double, w double, h double, confidence double, has_crop boolean"
    old, new = make(6, 0), make(40, 100)
    best = {}
    for r in old:
        best[r[3]] = r
    for r in new:
        cur = best.get(r[3])
        conf = lambda v: -1.0 if v[7] is None else v[7]
        if cur is None or (not cur[8] and r[8]) or conf(r) > conf(cur) + 0.01:
            best[r[3]] = r
    got = regions.merge_by_position(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), limit=limit)
    assert sorted(r.id for r in got.collect()) == sorted(r[2] for r in best.values())


def test_overlap_pairs_and_viewports(spark):
    rows = boxes(np.random.default_rng(19), 60)
    df = spark.createDataFrame(rows, BOX)
    got = {(r.id_a, r.id_b) for r in regions.overlap_pairs(df, cell=16).collect()}
    assert got == {tuple(sorted((a[2], b[2]))) for a in rows for b in rows if a[2] < b[2] and a[0] == b[0] and inter(a, b) > 0}
    views = [(1, 0, 10.0, 10.0, 20.0, 20.0), (2, 1, 0.0, 0.0, 5.0, 5.0)]
    out = regions.regions_in_viewports(df, spark.createDataFrame(views, "viewport_id int, page_no long, vx double, vy double, vw double, vh double"), 2, 16)
    want = {(v[0], r[2]) for v in views for r in rows if v[1] == r[0] and r[3] <= v[2] + v[4] + 2 and r[3] + r[5] >= v[2] - 2
            and r[4] <= v[3] + v[5] + 2 and r[4] + r[6] >= v[3] - 2}
    assert sorted((r.viewport_id, r.id) for r in out.collect()) == sorted(want)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_plain_pages_need_no_sweep(spark):
    """Regions of pages with few lines look through them; one page with many lines is swept, with the same answers."""
    rng = np.random.default_rng(29)
    rows = spark.createDataFrame(boxes(rng, 20, pages=3), BOX)
    schema = "page_no long, line_no int, line_y double, line_h double"
    text = lambda n: [(p, i, float(rng.integers(0, 120)), float(rng.integers(4, 20))) for p in (0, 1) for i in range(n[p])]
    few = spark.createDataFrame(text((5, lines.FEW_LINES)), schema)
    assert "Window" not in _plan(lines.text_line_context(rows, few))
    many = spark.createDataFrame(text((5, lines.FEW_LINES + 1)), schema)
    both = lines.text_line_context(rows, many)
    assert "Window" in _plan(both)
    swept = lines._swept(rows, many, ["page_no"], 100)
    assert both.dtypes == swept.dtypes
    assert sorted(both.collect()) == sorted(swept.select(both.columns).collect())


def test_regions_meet_few_viewports_without_cells(spark):
    """Regions are not spread over cells for pages with few viewports; pages with many give the same rows by cells."""
    df = spark.createDataFrame(boxes(np.random.default_rng(31), 30), BOX)
    views = [(i, i % 2, i * 5.0, i * 4.0, 20.0, 15.0) for i in range(15)]
    views = spark.createDataFrame(views, "viewport_id int, page_no long, vx double, vy double, vw double, vh double")
    found = lambda few: regions.regions_in_viewports(df, views, 2, 16, few)
    assert "_cx" not in _plan(found(8)) and "_cx" in _plan(found(7))
    assert found(8).columns == found(7).columns == found(0).columns
    assert sorted(found(8).collect()) == sorted(found(7).collect()) == sorted(found(0).collect())
