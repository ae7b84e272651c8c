"""Streams with several triggers give what their batch twins give, and forget what can no longer matter."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from regionlake.operators import metering
from regionlake.streaming import jobs

START = datetime(2024, 1, 1)
USERS = "user_id long, email string, email_verified boolean, expires_at timestamp, is_admin boolean, simulate_mode string"


def source(spark, path, parts, schema):
    """A stream of one trigger for each part, rows in no order within it."""
    import time

    for k, rows in enumerate(parts):
        rows = list(rows)
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, tmp_path, mode="append"):
    out = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query


def events(days, per_day=6, users=4):
    rng = random.Random(1)
    return [(d * 100 + i, START + timedelta(days=d, seconds=rng.randrange(86_400)), rng.randrange(users)) for d in days for i in range(per_day)]


EVENTS = "event_id long, ts timestamp, user_id long"


def test_quota_equals_batch_over_triggers(spark, tmp_path):
    rows = events(range(40))
    users = spark.createDataFrame([(0, None, False, None, False, None), (1, "a@b.cd", True, None, False, "none"),
                                   (2, None, False, None, True, None)], USERS)
    parts = [[r for r in rows if lo <= (r[1] - START).days < lo + 10] for lo in range(0, 40, 10)]
    got, _ = drain(jobs.stream_quota_decisions(source(spark, tmp_path / "in", parts, EVENTS), users, START), tmp_path)
    want = metering.quota_decisions(spark.createDataFrame(rows, EVENTS), users, START).collect()
    assert {r.event_id: r.allowed for r in got} == {r.event_id: r.allowed for r in want}
    assert len(set(r.allowed for r in want)) == 2


def test_quota_late_event_changes_its_own_day_only(spark, tmp_path):
    at = lambda d, h: START + timedelta(days=d, hours=h)
    parts = [[(1, at(5, 1), 7)], [(2, at(4, 1), 7)], [(3, at(5, 2), 7)]]
    users = spark.createDataFrame([], USERS)
    got, _ = drain(jobs.stream_quota_decisions(source(spark, tmp_path / "in", parts, EVENTS), users, START, "3 days"), tmp_path)
    want = metering.quota_decisions(spark.createDataFrame(sum(parts, []), EVENTS), users, START).collect()
    assert {r.event_id: r.allowed for r in got} == {r.event_id: r.allowed for r in want} == {1: True, 2: True, 3: False}


def test_usage_months_and_removed_state(spark, tmp_path):
    rows = events(range(0, 330, 3))
    parts = [[r for r in rows if lo <= (r[1] - START).days < lo + 66] for lo in range(0, 330, 66)]
    updates = jobs.stream_usage(source(spark, tmp_path / "in", parts, EVENTS))
    query = jobs.upsert_counts(updates, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sum(op["numRowsRemoved"] for p in query.recentProgress for op in p["stateOperators"]) > 0
    assert jobs.late_rows(query) == 0
    want = spark.createDataFrame(rows, EVENTS)
    for period in ("day", "month"):
        expected = want.groupBy("user_id", F.date_trunc(period, "ts").alias("period_start")).count().collect()
        got = jobs.latest_counts(spark, str(tmp_path / "out"), period).select("user_id", "period_start", "n").collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in expected}
    jobs.compact_counts(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert jobs.latest_counts(spark, str(tmp_path / "one")).count() == jobs.latest_counts(spark, str(tmp_path / "out")).count()


def test_late_rows_are_counted(spark, tmp_path):
    parts = [events([50]), events([60]), events([1], per_day=5)]
    query = jobs.upsert_counts(jobs.stream_usage(source(spark, tmp_path / "in", parts, EVENTS)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert jobs.late_rows(query) > 0


CODES = "event_id long, email string, ts timestamp, code string, is_try boolean"


@pytest.mark.parametrize("triggers", [1, 4])
def test_codes_equal_batch(spark, tmp_path, triggers):
    rng = random.Random(triggers)
    rows, last = [], {}
    for i in range(400):
        email = rng.choice(["a@b.cd", "x@y.zz", "broken"])
        t = START + timedelta(seconds=i * 40)
        if rng.random() < 0.3:
            last.setdefault(email, []).append(f"{rng.randrange(10**6):06d}")
            rows.append((i, email, t, last[email][-1], False))
        else:
            known = last.get(email, ["000000"])
            rows.append((i, email, t, rng.choice([known[-1], known[-1], known[-2:][0], "12345", None]), True))
    step = len(rows) // triggers
    stream = source(spark, tmp_path / "in", [rows[k * step:(k + 1) * step] for k in range(triggers)], CODES)
    got, _ = drain(jobs.stream_code_verification(stream.filter("NOT is_try"), stream.filter("is_try")), tmp_path)
    batch = spark.createDataFrame(rows, CODES)
    want = metering.verify_codes(batch.filter("NOT is_try"), batch.filter("is_try")).collect()
    assert {r.event_id: (r.outcome, r.send_id) for r in got} == {r.event_id: (r.outcome, r.send_id) for r in want}
    assert {r.outcome for r in want} >= {"ok", "missing", "mismatch", "invalid_code", "invalid_email"}


def test_superseded_code_is_a_mismatch(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    parts = [[(1, "a@b.cd", at(0), "111111", False)], [(2, "a@b.cd", at(100), "222222", False)], [(3, "a@b.cd", at(200), "111111", True)]]
    stream = source(spark, tmp_path / "in", parts, CODES)
    got, _ = drain(jobs.stream_code_verification(stream.filter("NOT is_try"), stream.filter("is_try")), tmp_path)
    assert [(r.event_id, r.send_id, r.outcome) for r in got] == [(3, 2, "mismatch")]


def test_rate_limit_equals_batch_and_forgets(spark, tmp_path):
    rng = random.Random(4)
    schema = "event_id long, email string, ts timestamp"
    rows = [(i, f"u{rng.randrange(3)}@x.yz", START + timedelta(seconds=i * 17)) for i in range(300)] + [
        (900, "z@x.yz", START + timedelta(days=3)), (901, "z@x.yz", START + timedelta(days=9))]
    parts = [rows[:100], rows[100:200], rows[200:300], rows[300:301], rows[301:]]
    got, query = drain(jobs.stream_rate_limit(source(spark, tmp_path / "in", parts, schema)), tmp_path)
    want = metering.send_rate_limit(spark.createDataFrame(rows, schema)).collect()
    assert {r.event_id: r.accepted for r in got} == {r.event_id: r.accepted for r in want}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_entitlements_equal_batch(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, days int"
    rng = random.Random(5)
    rows = [(i, rng.randrange(5), START + timedelta(days=i), rng.choice([30, 90, None])) for i in range(90)]
    parts = [rows[:30], rows[30:60], rows[60:]]
    got, _ = drain(jobs.stream_entitlements(source(spark, tmp_path / "in", parts, schema)), tmp_path)
    want = metering.renewal_chain(spark.createDataFrame(rows, schema)).collect()
    assert {(r.event_id, r.expires_at) for r in got} == {(r.event_id, r.expires_at) for r in want}


def test_bound_address_leaves_the_code_unused(spark):
    at = lambda s: START + timedelta(seconds=s)
    sends = spark.createDataFrame([(1, "a@b.cd", at(0), "111111", True), (2, "a@b.cd", at(5), "222222", False)],
                                  "event_id long, email string, ts timestamp, code string, accepted boolean")
    tries = spark.createDataFrame([(3, "a@b.cd", at(10), "111111", 9), (4, "a@b.cd", at(20), "111111", 8)],
                                  "event_id long, email string, ts timestamp, code string, user_id long")
    bound = spark.createDataFrame([("a@b.cd", 8)], "email string, user_id long")
    got = {r.event_id: r.outcome for r in metering.verify_codes(sends, tries, bound=bound).collect()}
    assert got == {3: "bound", 4: "ok"}
    assert {r.event_id: r.outcome for r in metering.verify_codes(sends, tries).collect()} == {3: "ok", 4: "missing"}


def test_quota_of_users_known_from_events_only(spark):
    rows = spark.createDataFrame([(1, START, 5), (2, START, 6)], EVENTS)
    users = spark.createDataFrame([(6, None, False, None, True, None)], USERS)
    got = {r.user_id: (r.tier, r.today_usage, r.can_use) for r in metering.quota_status(rows, users, START).collect()}
    assert got == {5: ("anonymous", 1, False), 6: ("admin", 1, True)}


def test_recognition_state(spark, tmp_path):
    """Over three triggers each content is recognised once, as in batch; after its time to live it is recognised again."""
    import time

    def make():
        def run(row):
            if bytes(row["data"]) == b"bad":
                raise ValueError("no")
            return "x" + bytes(row["data"]).decode()

        return run

    schema = "id string, data binary, confidence double"
    row = lambda i, data, sure=0.9: (i, bytearray(data), sure)
    parts = [[row("a", b"1"), row("b", b"1"), row("c", b"bad")], [row("d", b"1"), row("e", b"2"), row("f", b"3", 0.1)], [row("g", b"2"), row("h", b"bad")]]
    src = source(spark, tmp_path / "in", parts, schema)
    run = lambda: jobs.stream_recognitions(src, str(tmp_path / "store"), str(tmp_path / "cp"), make, ttl_seconds=8, delay_seconds=0.0)
    query = run()
    query.awaitTermination()
    rows = [r for k in range(3) for r in spark.read.parquet(str(tmp_path / "store" / f"version={k}")).collect()]
    assert sorted((r.content_hash for r in rows if r.fresh)) == sorted({r.content_hash for r in rows})
    batch = spark.createDataFrame([r for p in parts for r in p], schema).filter("confidence >= 0.5")
    from regionlake.operators import lifecycle

    want = {(r.id, r.success, r.latex, r.error) for r in lifecycle.recognize_unique(batch, make, delay_seconds=0.0).collect()}
    assert {(r.id, r.success, r.latex, r.error) for r in jobs.recognised(spark, str(tmp_path / "store")).collect()} == want
    time.sleep(9)
    spark.createDataFrame([row("z", b"1")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = run()
    query.awaitTermination()
    again = [r for r in spark.read.parquet(str(tmp_path / "store" / "version=3")).collect()]
    assert [(r.id, r.latex, r.fresh) for r in again] == [("z", "x1", True)]


def test_pages_wait_for_their_text(spark, tmp_path):
    """Hints that come with their page, in a later trigger, before it, or never."""
    import numpy as np

    from regionlake.params import DetectionParams

    blank = np.full((100, 120), 255, np.uint8)
    drawn = blank.copy()
    drawn[40:60, 20:100] = 0
    pixels = {"with": drawn, "late": drawn, "never": drawn, "plain": drawn, "plain late": drawn, "empty": blank, "end": blank}
    schema = "path string, width int, height int, channels int, data binary"
    images = spark.createDataFrame([(k, 120, 100, 1, bytearray(v.tobytes())) for k, v in pixels.items()], schema)
    at = lambda m: START + timedelta(minutes=m)
    pages = source(spark, tmp_path / "pages", [[("with", at(0)), ("late", at(1)), ("plain", at(1))], [("never", at(2)), ("plain late", at(3)), ("empty", at(3))],
                                               [("end", at(300))], [("end", at(301))]], "path string, ts timestamp")
    hints = source(spark, tmp_path / "hints", [[("with", at(0), True), ("plain", at(1), False)], [("late", at(2), True), ("empty", at(3), True)],
                                               [("plain late", at(4), False), ("other", at(300), True)], [("other", at(301), True)]], "path string, ts timestamp, hint boolean")
    p = DetectionParams(target_dpi=72.0, source_dpi=72.0)
    jobs.stream_page_results(pages, hints, lambda keys: images.join(keys, "path"), str(tmp_path / "out"), str(tmp_path / "cp"), p=p).awaitTermination()
    rows = {r.path: (r.hint, r.skipped, r.n_regions > 0) for r in spark.read.parquet(str(tmp_path / "out" / "pages" / "version=*")).collect()}
    rows.pop("end", None)
    assert rows == {"with": (True, False, True), "late": (True, False, True), "plain": (False, True, False), "never": (None, False, True),
                    "plain late": (False, True, False), "empty": (True, False, False)}


def test_contents_share_a_state_group():
    """A trigger asks for each content once, in a few groups, and copies take the result of the first."""
    import pandas as pd

    class Seen(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def getMapState(self, name, key, value, ttl):
            return seen

    seen, calls = Seen(), []

    def make():
        def fn(row):
            calls.append(row["id"])
            if row["data"] == b"bad":
                raise ValueError("unreadable")
            return row["data"].decode()
        return fn

    once = jobs._RecogniseOnce(make, 60, {"delay_seconds": 0.0, "max_attempts": 1})
    once.init(Handle())
    rows = pd.DataFrame({"id": [1, 2, 3, 4], "content_hash": ["a", "b", "a", None], "data": [b"x", b"bad", b"x", None], "bucket": 7})
    for fresh in ([True, True, False, True], [False] * 4):
        out, = once.handleInputRows((7,), iter([rows]), None)
        assert list(out["fresh"]) == fresh and list(out["latex"])[:3] == ["x", None, "x"] and list(out["success"]) == [True, False, True, False]
    assert calls == ["a", "b", None]
