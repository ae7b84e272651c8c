"""Python stages hold a few pages or texts at a time, however many rows a batch has."""

import numpy as np
import pandas as pd

from regionlake import fixtures
from regionlake.raster import jobs


class Caught:
    """Stands for a DataFrame and hands out the function that would run in the tasks."""

    dtypes = [("page_no", "int")]

    def select(self, *names):
        return self

    def repartition(self, *by):
        return self

    def mapInPandas(self, fn, schema):
        return fn

    mapInArrow = mapInPandas


def test_documents_become_pages_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "table", lambda *a: Caught())
    render = fixtures.document_pages(spark, "")
    long = "\n".join(["a line of text"] * (24 * 150))
    texts = pd.DataFrame({"doc_id": range(52), "text": ["short"] * 50 + [long, ""]})
    pieces = list(render(iter([texts])))
    assert max(len(p) for p in pieces) <= fixtures.PAGES_AT_ONCE
    pages = pd.concat(pieces)
    assert len(pages) == 50 + 150 + 1 and pages["page_no"].max() == 149
    assert set(pages["data"].map(len)) == {720 * 320}


def test_glyphs_of_pages(spark, tmp_path):
    """Every character has its pattern, white space and the rest of a line are blank."""
    text = "aé∑𝒳\t z \n\n" + "xy" * 50
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row, = fixtures.document_pages(spark, str(tmp_path)).collect()
    page = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width)
    want = np.full_like(page, 255)
    lines = ["aé∑𝒳\t z ", "", ("xy" * 50)[:80], ("xy" * 50)[80:]]
    for i, line in enumerate(lines):
        for j, ch in enumerate(line):
            for y in range(14):
                for x in range(4):
                    if not ch.isspace() and (ord(ch) * 2654435761) >> ((y // 2 * 4 + x) % 28) & 1:
                        want[i * 30 + y, j * 4 + x] = 0
    assert (page == want).all()


def test_results_of_pages_leave_in_small_pieces():
    big = lambda gray, row: iter([{"bits": bytes(1 << 20)}])
    run = jobs.per_page(Caught(), ["page_no"], big, "bits binary")
    pages = pd.DataFrame({"page_no": range(40), "width": 2, "height": 2, "channels": 1, "data": [bytes(4)] * 40})
    pieces = list(run(iter([pages])))
    assert max(len(p) for p in pieces) <= 5 and list(pd.concat(pieces)["page_no"]) == list(range(40))


class State:
    """One key's state of `applyInPandasWithState`, outside a stream."""

    hasTimedOut, exists = False, False

    def update(self, values):
        self.get, self.exists = values, True

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at > self.mark


def walk(known, rows, ttl, mark):
    """Code verification of one trigger, attempt by attempt."""
    known = sorted(known + [[t, e, code, False] for t, e, code, is_try, _ in rows if not is_try], key=lambda s: s[:2])
    out = []
    for t, e, code, is_try, mail in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if is_try:
            before = [s for s in known if (s[0], s[1]) <= (t, e)]
            sent = before[-1] if before and t < before[-1][0] + ttl else None
            outcome = ("invalid_email" if not mail else "invalid_code" if len(code) != 6 else
                       "missing" if sent is None or sent[3] else "mismatch" if code != sent[2] else "ok")
            if sent is not None and len(code) == 6 and code == sent[2]:
                sent[3] = True
            out.append((e, sent and sent[1], outcome))
    live = [s for s in known if s[0] + ttl > mark]
    return out, live or known[-1:]


def verifier():
    """The function that `stream_code_verification` runs on a key."""
    from unittest.mock import MagicMock

    from pyspark.sql import functions as F

    from regionlake.streaming import jobs as streams

    frame = MagicMock()
    for name in ("select", "union", "withWatermark", "withColumns"):
        getattr(frame, name).return_value = frame
    frame.groupBy.return_value.applyInPandasWithState = lambda fn, *rest: fn
    return streams.stream_code_verification(frame, frame)


def test_codes_against_a_walk(spark):
    """Random triggers with equal times, late, repeated and malformed codes, over state."""
    rng = np.random.default_rng(5)
    verify, ttl = verifier(), 600_000_000
    for _ in range(60):
        state, known, event = State(), [], 0
        for trigger in range(4):
            rows = []
            for _ in range(rng.integers(1, 25)):
                event += 1
                t = int(trigger * 900 + rng.integers(0, 900) // 60 * 60) * 1_000_000
                rows.append((t, event, ["111111", "222222", "12345"][rng.integers(0, 3)], bool(rng.random() < 0.6), bool(rng.random() < 0.9)))
            state.mark = max(0, trigger * 900 - 700) * 1000
            frame = pd.DataFrame(rows, columns=["t", "event_id", "code", "is_try", "good_mail"])
            got, = verify(("a",), iter([frame.iloc[::2], frame.iloc[1::2]]), state)
            want, known = walk(known, rows, ttl, state.mark * 1000)
            assert [(e, None if s is pd.NA else s, o) for e, s, o in zip(got["event_id"], got["send_id"], got["outcome"])] == want
            import json

            assert json.loads(state.get[0]) == [list(s) for s in known]


def test_codes_take_time_in_proportion(spark):
    """An address with a hundred thousand sends and attempts; held against each other they took minutes."""
    import time

    n = 100_000
    frame = pd.DataFrame({"t": np.arange(n) * 1000, "event_id": np.arange(n), "code": "123456", "is_try": np.arange(n) % 2 == 1, "good_mail": True})
    state, began = State(), time.time()
    state.mark = 0
    got, = verifier()(("a",), iter([frame]), state)
    assert (got["outcome"] == "ok").all() and time.time() - began < 20


def test_segments_leave_in_small_pieces(spark):
    """A batch of pairs that differ everywhere; pieces are bounded and together they are the whole batch."""
    from regionlake.operators import corpus

    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 300))
    a, b = pd.Series([word() for _ in range(400)]), pd.Series([word() for _ in range(400)])
    pieces = list(corpus._segment_pieces(iter([(a, b)])))
    assert max(sum(map(len, p)) for p in pieces) < corpus.SEGMENTS_AT_ONCE + 600
    assert sum(map(len, pieces)) == 400
    # a Spark batch of many pairs comes back whole and in place
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        rows = corpus.diff_pairs(spark.createDataFrame(pd.DataFrame({"original": a, "modified": b})).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    for r in rows:
        assert "".join(d.text for d in r.diff if d.type != "added") == r.original
        assert "".join(d.text for d in r.diff if d.type != "removed") == r.modified


def test_exports_make_their_documents_once(spark, tmp_path):
    """Choosing file ranges from a sample once made every document a second time."""
    from pyspark.sql import functions as F

    from regionlake.sources import exports

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(n):
        made.add(1)
        return f"text {n}"

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("part_no"), content("id").alias("content"))
    exports.write_export(docs, str(tmp_path / "out"))
    assert made.value == 200
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"text {n}" for n in range(200))


def test_segments_of_pages_without_rows_of_pixels(spark):
    """`projection_regions` gives what the table of pixel rows gives, and makes no such table."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        page = np.full((rng.integers(1, 160), rng.integers(1, 120)), 255, np.uint8)
        for _ in range(rng.integers(0, 5)):
            y, x = rng.integers(0, page.shape[0]), rng.integers(0, page.shape[1])
            page[y:y + rng.integers(1, 40), x:x + rng.integers(1, 90)] = 0
        rows.append((i, page.shape[1], page.shape[0], 1, bytearray(page.tobytes())))
    pages = spark.createDataFrame(rows, "page_no int, width int, height int, channels int, data binary")
    got = jobs.projection_regions(pages)
    want = jobs.row_segments(jobs.row_profiles(pages))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chosen_pages_move_texts_and_no_pixels(spark, tmp_path):
    """Only the pages asked for are set, behind all shuffles; keys of pages need no page to be set."""
    texts = ["short", "", "\n" * 30, "a line\n" * 100 + "x" * 161, "y" * 80 * 24, "y" * 80 * 24 + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    everything = {(r.doc_id, r.page_no): bytes(r.data) for r in fixtures.document_pages(spark, str(tmp_path)).collect()}
    keys = fixtures.document_page_keys(spark, str(tmp_path))
    assert sorted(tuple(r) for r in keys.collect()) == sorted(everything)
    wanted = [(3, 4), (3, 1), (5, 1), (0, 0), (99, 0), (4, 7)]
    some = fixtures.document_pages(spark, str(tmp_path), spark.createDataFrame(wanted, "doc_id bigint, page_no int"))
    assert some._jdf.queryExecution().optimizedPlan().toString().startswith("MapInPandas")
    assert {(r.doc_id, r.page_no): bytes(r.data) for r in some.collect()} == {k: everything[k] for k in wanted if k in everything}


def test_crops_are_moved_compressed(spark):
    """Copies meet as compressed bytes, and the recogniser sees whole ones."""
    from regionlake.operators import lifecycle

    crops = [("a", 3, bytearray(200_000)), ("b", 3, bytearray(200_000)), ("c", 4, bytearray(b"xyz" * 9)), ("d", 5, bytearray()), ("e", 6, None)]
    rows = spark.createDataFrame(crops, "id string, width int, data binary")
    keyed = rows.withColumn("content_hash", lifecycle.content_hash(rows["data"]))
    assert lifecycle._pack(keyed, "data").selectExpr("max(length(data))").first()[0] < 1000
    seen = lambda: lambda row: f"{row['width']}:{len(row['data'])}:{sum(row['data'])}:{sorted(row)}"
    got = lifecycle.recognize_unique(rows, seen, delay_seconds=0.0)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    names = "['data', 'id', 'width']"
    total = 9 * sum(b"xyz")
    assert {r.id: r.latex for r in got.collect()} == {
        "a": f"3:200000:0:{names}", "b": f"3:200000:0:{names}", "c": f"4:27:{total}:{names}", "d": f"5:0:0:{names}"}


def test_rows_of_a_key_are_put_in_order_without_a_frame(monkeypatch):
    """Chunks of one key become plain columns by time and event; no frame is joined or sorted for them."""
    from regionlake.streaming import jobs as stream

    chunks = [pd.DataFrame({"t": [5, 1], "event_id": [2, 9], "days": [30, 40]}), pd.DataFrame({"t": [1, 0], "event_id": [8, 3], "days": [5, 7]})]
    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    event_id, days = stream._columns_in_order(iter(chunks), "event_id", "days")
    assert event_id.tolist() == [3, 8, 9, 2] and days.tolist() == [7, 5, 40, 30]
    assert stream._columns_in_order(iter(chunks[:1]), "event_id")[0].tolist() == [9, 2]


def test_pages_are_made_where_they_are_looked_at(spark, tmp_path):
    """Page queries move texts, never pixels: one Python stage makes a page and looks at it, with the rows of the table of pages."""
    import pytest

    from regionlake.plans import raster_queries as q

    texts = [(1, "a line\n\n" + "word " * 600), (2, ""), (3, "∑ x = y\n" * 30)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = fixtures.document_pages(spark, str(tmp_path))
    on_table = {
        "page_quality": jobs.page_quality(pages, q.KEYS), "find_components": jobs.find_components(pages, q.KEYS, q.NATIVE),
        "merged_components": jobs.merged_components(pages, q.KEYS, q.NATIVE),
        "binarize_pages": jobs.binarize_pages(pages, q.KEYS, q.NATIVE),
        "projection_regions": jobs.projection_regions(pages, q.KEYS), "quality_report": jobs.quality_report(jobs.page_quality(pages, q.KEYS)),
        "thumbnails": q.content(jobs.resize_pages(pages, width=150, keys=q.KEYS)),
        "prepare_crops": q.content(jobs.prepare_crops(q._crops(spark, str(tmp_path)))),
    }
    for name, want in on_table.items():
        got = getattr(q, name)(spark, str(tmp_path))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1, name
        assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str), name
    with pytest.raises(ValueError):
        jobs.page_quality(fixtures.pages_to_make(spark, str(tmp_path)), ["page_no"])


def test_made_pages_are_looked_at_one_piece_at_a_time():
    made = []

    def make(batches):
        for pdf in batches:
            for n in pdf["n"]:
                made.append(n)
                yield pd.DataFrame({"page_no": [n], "width": 2, "height": 2, "channels": 1, "data": [bytes(4)]})

    big = lambda gray, row: iter([{"bits": bytes(jobs.PIECE_BYTES)}])
    run = jobs.per_page(jobs.PagesToMake(Caught(), make, "page_no int"), ["page_no"], big, "bits binary")
    pieces = run(iter([pd.DataFrame({"n": range(40)})]))
    next(pieces)
    assert len(made) <= 2


def test_sharpness_of_bytes_is_that_of_numbers():
    from regionlake.raster import kernels as k

    for seed, (h, w) in enumerate([(1, 1), (2, 5), (3, 3), (40, 50)]):
        gray = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)
        assert k.quality(gray) == k.quality(gray.astype(np.float64))
        assert (k.sharpen(gray) == k.sharpen(gray.astype(np.float64))).all()


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """A task of a window or a join by id has as many rows over a larger table; with the session's partitions it had more."""
    import re

    from pyspark.sql import functions as F

    from regionlake.operators import ordered
    from regionlake.plans import region_queries as q

    def lineitem(pages, path):
        spark.range(pages * 4).selectExpr(
            "id div 4 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber", "1D AS l_quantity",
            "2D AS l_extendedprice", "0.1D AS l_discount", "0D AS l_tax", "if(id % 4 = 0, 'A', 'N') AS l_returnflag",
        ).write.parquet(f"{path}/lineitem.parquet")
        return str(path)

    task_rows, pages = 250_000, 500_000
    large, small = lineitem(pages, tmp_path / "large"), lineitem(50, tmp_path / "small")
    tasks = fixtures.regions(spark, large).groupBy(F.spark_partition_id()).count()
    assert tasks.agg(F.max("count")).first()[0] < 1.2 * task_rows
    got = q.status_counts(spark, large)
    # plans alone need no count of groups
    monkeypatch.setattr(ordered, "group_sizes", lambda df, keys: (df.count(), 4), raising=False)
    for query in (q.status_counts, q.attach_recognitions, q.pending_regions, q.delete_by_ids, q.select_by_ids):
        plan = lambda path: query(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", plan(large)) == ["8", "8"], query.__name__
        assert "REPARTITION_BY_NUM" not in plan(small), query.__name__
    state = "array(1, 2, 3, 4), i -> page_no % 4 <> 0 AND (page_no + i) % 5 > 1"
    want = spark.range(pages).withColumnRenamed("id", "page_no").selectExpr(
        "page_no", "4L AS shown", f"CAST(size(filter({state})) AS BIGINT) AS done", "0L AS processing")
    want = want.selectExpr("*", "4 - done AS pending", "1L AS display", "3L AS inline")
    got = got.select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_pages_are_recognised_without_moving_pixels(spark, tmp_path):
    from regionlake.operators import lifecycle
    from regionlake.plans import raster_queries as q

    texts = [(1, "a line\n" * 30), (2, "a line\n" * 30), (3, ""), (4, "x = y"), (5, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    want = lifecycle.recognize_unique(q._crops(spark, sf), q.make_test_recognizer, delay_seconds=0.0)
    names = ["id", "success", "latex", "error", "attempts"]
    got = q.recognize(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*names).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # one stage makes and recognises: no column of pixels, packed or not, is in the plan
    assert plan.count("MapInPandas") == 1 and "data#" not in plan and "MapInArrow" not in plan
    seen = lambda: lambda row: f"{sorted(row)} {len(row['data'])}"
    texts = {r.latex for r in jobs.recognize_pages(fixtures.pages_to_make(spark, sf), q.KEYS, seen, delay_seconds=0.0).collect()}
    assert texts == {f"['channels', 'data', 'height', 'id', 'width'] {320 * 720}"}
    calls = lambda: lambda row: 1 / 0
    assert {(r.success, r.attempts) for r in jobs.recognize_pages(
        fixtures.pages_to_make(spark, sf), q.KEYS, calls, delay_seconds=0.0, max_attempts=2).collect()} == {(False, 2)}
