"""Structured Streaming forms of metering, codes, entitlements and recognition.

Stateful steps keep a few numbers per user or address and walk the rows that a trigger brings for it in time order.  The rows
of one key in one trigger are a few numbers each and are sorted in one worker; ``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` on the source bounds them.  Rows older than the watermark are not decided (``late_rows`` counts
them); rows that come out of order but within it are decided by the state they find for their own day, month or code.  Where
triggers come in time order each job gives the same answer as its batch twin, whatever the order within a trigger.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..lineage import cut
from ..operators import corpus, lifecycle, metering
from ..params import DetectionParams
from ..raster import jobs as raster

c = F.col
MICROS_PER_DAY = 86_400_000_000


# ---------------------------------------------------------------- T1
def stream_usage(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Uses per user and day, in update mode; a day's state goes when the watermark has passed its end.

    Months are not windows of one length, so `latest_counts` adds them up from the days.
    """
    at = F.window("ts", "1 day")
    return events.withWatermark("ts", watermark).groupBy(at.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", c("w.start").alias("period_start"), "n")


def upsert_counts(updates: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write each trigger's updates as a new version; `latest_counts` reads the newest one per key."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(**options)


def latest_counts(spark, path: str, period: str = "day") -> DataFrame:
    """Counts per user and day or calendar month, from the newest version of each day."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    days = rows.groupBy("user_id", "period_start").agg(F.max_by("n", "version").alias("n"))
    if period == "day":
        return days
    return days.groupBy("user_id", F.date_trunc("month", "period_start").alias("period_start")).agg(F.sum("n").alias("n"))


def compact_counts(spark, path: str, to: str) -> None:
    """Write the newest version of each day as the only one, below a new path."""
    latest_counts(spark, path).withColumn("version", F.lit(0)).write.parquet(f"{to}/version=0")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the triggers that the query still remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


# ---------------------------------------------------------------- T2-T5
def _in_order(chunks: Iterator[pd.DataFrame], *more: str) -> pd.DataFrame:
    """Rows of one key in one trigger, by time and event."""
    rows = pd.concat(list(chunks), ignore_index=True)
    return rows.sort_values(["t", "event_id", *more], kind="stable")


def _columns_in_order(chunks: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    """Columns of the rows of one key in one trigger, by time and event.  Most keys bring a few rows, so no frame is made for them."""
    parts = list(chunks)
    get = lambda name: parts[0][name].to_numpy() if len(parts) == 1 else np.concatenate([p[name].to_numpy() for p in parts])
    order = np.lexsort((get("event_id"), get("t")))
    return [get(name)[order] for name in names]


def _latest(sent_t: np.ndarray, sent_id: np.ndarray, t: np.ndarray, event_id: np.ndarray) -> np.ndarray:
    """Place of the last send that is not after each (time, event), -1 for none; both sides are in order."""
    later = np.repeat([False, True], [len(sent_t), len(t)])
    order = np.lexsort((later, np.concatenate([sent_id, event_id]), np.concatenate([sent_t, t])))
    return (np.cumsum(~later[order]) - 1)[later[order]]


def _forget_at(state: GroupState, millis: int) -> None:
    """Drop the state when the watermark has reached this time."""
    state.setTimeoutTimestamp(max(int(millis), state.getCurrentWatermarkMs() + 1))


def _next_month(micros: int) -> int:
    at = datetime.fromtimestamp(micros / 1_000_000, timezone.utc)
    year, month = divmod(at.year * 12 + at.month, 12)
    return int(datetime(year, month + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def stream_quota_decisions(events: DataFrame, users: DataFrame, now: datetime, lateness: str = "2 days") -> DataFrame:
    """Allow or deny each event against the limits of its user; denied events are not counted.

    State holds the uses of each day and month that rows can still come for, so an event of an earlier day changes that day
    and its month only.
    """
    tiers = users.select("user_id", "is_admin", metering.effective_tier(F.lit(now)).alias("tier"))
    limit = lambda which: metering.tier_limit(F.coalesce("tier", F.lit("anonymous")), which)
    rows = events.withWatermark("ts", lateness).join(tiers, "user_id", "left").select(
        "user_id", "event_id", "ts", F.unix_micros("ts").alias("t"), F.date_format("ts", "yyyyMM").cast("int").alias("month"),
        limit(0).alias("day_limit"), limit(1).alias("month_limit"), F.coalesce("is_admin", F.lit(False)).alias("is_admin"))

    def decide(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        used, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        event_id, *columns = _columns_in_order(chunks, "event_id", "t", "month", "day_limit", "month_limit", "is_admin")
        allowed = []
        for t, m, day_limit, month_limit, admin in zip(*(v.tolist() for v in columns)):
            day, month = f"d{t // MICROS_PER_DAY}", f"m{m}"
            room = used.get(day, 0) < day_limit and used.get(month, 0) < month_limit
            for k in (day, month):
                used[k] = used.get(k, 0) + int(room)
            allowed.append(bool(admin or room))
            last = max(last, int(t))
        # no row can come any more for days and months that end before the watermark
        mark = state.getCurrentWatermarkMs()
        first = datetime.fromtimestamp(mark / 1000, timezone.utc)
        oldest = {"d": mark * 1000 // MICROS_PER_DAY, "m": first.year * 100 + first.month}
        state.update((json.dumps({k: n for k, n in used.items() if int(k[1:]) >= oldest[k[0]]}), last))
        _forget_at(state, _next_month(last))
        yield pd.DataFrame({"user_id": key[0], "event_id": event_id, "allowed": allowed})

    return rows.groupBy("user_id").applyInPandasWithState(
        decide, "user_id bigint, event_id bigint, allowed boolean", "used string, last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_rate_limit(sends: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Accept a send unless one was accepted for its address less than ``seconds`` before.

    A send older than the last accepted one is rejected.  State goes once no send can be too soon after it.
    """
    micros = seconds * 1_000_000
    rows = sends.withWatermark("ts", lateness).select("email", "event_id", "ts", F.unix_micros("ts").alias("t"))

    def decide(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _in_order(chunks)
        accepted = []
        for t in rows["t"]:
            ok = last is None or t - last >= micros
            last = int(t) if ok else last
            accepted.append(ok)
        state.update((last,))
        _forget_at(state, (last + micros) // 1000 + 1)
        yield pd.DataFrame({"email": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": accepted})

    return rows.groupBy("email").applyInPandasWithState(
        decide, "email string, event_id bigint, accepted boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_entitlements(redeemed: DataFrame, lateness: str = "2 days") -> DataFrame:
    """T5: expiry after each redemption (user_id, event_id, ts, days).  An expiry that has passed is forgotten."""
    rows = redeemed.withWatermark("ts", lateness).filter(c("days").isNotNull()).select(
        "user_id", "event_id", "ts", F.unix_micros("ts").alias("t"), "days")

    def extend(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        expiry = state.get[0] if state.exists else 0
        event_id, at, length = _columns_in_order(chunks, "event_id", "t", "days")
        out = []
        for t, days in zip(at.tolist(), length.tolist()):
            expiry = int(max(expiry, t) + days * MICROS_PER_DAY)
            out.append(expiry)
        state.update((expiry,))
        _forget_at(state, expiry // 1000 + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": event_id,
                            "expires_at": pd.DatetimeIndex(np.array(out, "datetime64[us]")).tz_localize("UTC")})

    return rows.groupBy("user_id").applyInPandasWithState(
        extend, "user_id bigint, event_id bigint, expires_at timestamp", "expiry bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_code_verification(sends: DataFrame, attempts: DataFrame, ttl_seconds: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """T4: the outcome of each attempt, as in `metering.verify_codes`: against the latest code sent before it, used once.

    State holds the sends of an address that can still be meant, each with a mark when it is used.
    """
    shape = lambda df, is_try: df.select("email", "ts", "event_id", "code", F.lit(is_try).alias("is_try"))
    both = shape(sends, False).union(shape(attempts, True)).withWatermark("ts", lateness)
    rows = both.withColumns({"t": F.unix_micros("ts"), "code": F.coalesce("code", F.lit("")), "good_mail": F.coalesce(
        metering.valid_email(c("email")), F.lit(False))})
    ttl = ttl_seconds * 1_000_000

    def verify(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        known = json.loads(state.get[0]) if state.exists else []
        rows = _in_order(chunks, "is_try")
        is_try = rows["is_try"].to_numpy(bool)
        # sends first: an attempt is held against all that came up to this trigger
        new = rows.loc[~is_try, ["t", "event_id", "code"]].assign(used=False)
        sends = pd.concat([pd.DataFrame(known, columns=["t", "event_id", "code", "used"]).astype(
            {"t": "int64", "event_id": "int64", "code": object, "used": bool}), new]).sort_values(["t", "event_id"], kind="stable")
        sent_t, sent_id, sent_code, used = (sends[n].to_numpy() for n in sends.columns)
        used = used.copy()
        tries = rows.loc[is_try]
        t, code, good_mail = (tries[n].to_numpy() for n in ("t", "code", "good_mail"))
        n = len(tries)
        at = _latest(sent_t, sent_id, t, tries["event_id"].to_numpy())
        near = np.maximum(at, 0)
        some = (at >= 0) & (t < (sent_t[near] + ttl if len(sends) else 0))
        good = tries["code"].str.len().to_numpy() == 6
        same = some & (code == sent_code[near] if len(sends) else False)
        # a code is used even where the address turns out to be malformed, as in the batch twin
        first = np.full(len(sends), n)
        hits = np.flatnonzero(same & good)
        np.minimum.at(first, at[hits], hits)
        spent = some.copy()
        spent[some] = used[at[some]] | (first[at[some]] < np.flatnonzero(some))
        used[at[hits]] = True
        outcome = np.select([~good_mail.astype(bool), ~good, ~some | spent, ~same], ["invalid_email", "invalid_code", "missing", "mismatch"], "ok")
        send_id = pd.array(np.zeros(n, np.int64), dtype="Int64")
        send_id[some] = sent_id[at[some]]
        send_id[~some] = pd.NA
        mark = state.getCurrentWatermarkMs() * 1000
        # a send that is out of time still hides the ones before it
        from_ = min(int(np.searchsorted(sent_t, mark - ttl, side="right")), max(len(sends) - 1, 0))
        state.update((json.dumps([list(s) for s in zip(*(v[from_:].tolist() for v in (sent_t, sent_id, sent_code, used)))]),))
        _forget_at(state, (int(sent_t[-1]) + ttl) // 1000 + 1 if len(sends) else 0)
        yield pd.DataFrame({"email": key[0], "event_id": tries["event_id"].to_numpy(), "send_id": send_id, "outcome": outcome})

    return rows.groupBy("email").applyInPandasWithState(
        verify, "email string, event_id bigint, send_id bigint, outcome string", "sends string", "append",
        GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- T6, T7
# state by key lives in the RocksDB store; a step with a processing-time clock asks for one more empty trigger forever
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
CONTENT_BUCKETS = 1024
SEEN = "success boolean, latex string, error string, attempts int"


class _RecogniseOnce(StatefulProcessor):
    """The result of each content of a bucket, kept until its time to live has passed; a content without one is recognised."""

    def __init__(self, make_recognizer: Callable, ttl_seconds: float, options: dict):
        self.make, self.ttl, self.options = make_recognizer, int(ttl_seconds * 1000), options

    def init(self, handle) -> None:
        self.fn = None
        self.seen = handle.getMapState("seen", "content_hash string", SEEN, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            hashes = [h or "" for h in pdf["content_hash"]]
            known, fresh = {}, []
            for h, data in zip(hashes, pdf["data"]):
                had = known.get(h) or self.seen.getValue((h,))
                new = had is None
                if new:
                    self.fn = self.fn or self.make()
                    had = lifecycle.attempt(self.fn, {"id": h or None, "data": data}, **self.options)
                    self.seen.updateValue((h,), had)
                known[h] = tuple(had)
                fresh.append(new)
            out = pd.DataFrame({"id": pdf["id"].astype(str).to_numpy(), "content_hash": pdf["content_hash"].to_numpy()})
            for i, name in enumerate(("success", "latex", "error", "attempts")):
                out[name] = [known[h][i] for h in hashes]
            out["fresh"] = fresh
            yield out

    def close(self) -> None:
        pass


def recognise_stream(crops: DataFrame, make_recognizer: Callable, min_confidence: float = 0.5, ttl_seconds: float = 7 * 86_400, **options) -> DataFrame:
    """T6 as rows: (id, content_hash, success, latex, error, attempts, fresh) of each crop above the threshold.

    State is one result per content, dropped ``ttl_seconds`` after it was made; ``fresh`` marks the crop whose content was
    recognised just now.  ``options`` go to `lifecycle.attempt`.  The query needs the settings of KEYED_STATE.  Contents are
    grouped in buckets by their hash, as a group of its own for each costs far more than its look-up.
    """
    keyed = crops.filter(c("confidence") >= min_confidence).select(c("id").cast("string").alias("id"), "data", lifecycle.content_hash(c("data")).alias("content_hash"))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("content_hash"), F.lit(CONTENT_BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        _RecogniseOnce(make_recognizer, ttl_seconds, options), "id string, content_hash string, " + SEEN + ", fresh boolean", "append", "ProcessingTime")


def stream_recognitions(crops: DataFrame, store_path: str, checkpoint: str, make_recognizer: Callable, min_confidence: float = 0.5,
                        ttl_seconds: float = 7 * 86_400, **options) -> StreamingQuery:
    """Crops as they arrive, each content recognised once while its state lives; results are written by version.

    A repeated trigger overwrites its own version, and `recognised` reads the newest result of each crop.  Nothing that was
    written is read again.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_path}/version={batch_id}")

    conf = crops.sparkSession.conf
    before = {k: conf.get(k) for k in KEYED_STATE}
    rows = recognise_stream(crops, make_recognizer, min_confidence, ttl_seconds, **options)
    try:
        for k, v in KEYED_STATE.items():
            conf.set(k, v)  # a query takes its settings when it starts
        return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def recognised(spark, store_path: str) -> DataFrame:
    """The newest result of `stream_recognitions` for every crop."""
    names = ("content_hash", "success", "latex", "error", "attempts")
    rows = spark.read.option("basePath", store_path).parquet(f"{store_path}/version=*")
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "version").alias("r")).select("id", *(c(f"r.{n}") for n in names))


def pages_with_hints(pages: DataFrame, hints: DataFrame, keys: Sequence[str] = ("path",), lateness: str = "10 minutes") -> DataFrame:
    """Pages (keys, ts) with what their text says (keys, ts, hint): a page waits for its hint, and passes with a null one
    when the watermark shows that none can come any more.

    Both streams can be late by ``lateness``, and a hint counts if it is stamped within that time of its page.  State holds
    keys and times only.
    """
    keys = list(keys)
    left = pages.select(*keys, "ts").withWatermark("ts", lateness)
    right = hints.select(*(c(k).alias(f"_{k}") for k in keys), c("ts").alias("_ts"), "hint").withWatermark("_ts", lateness)
    near = F.expr(f"_ts BETWEEN ts - INTERVAL {lateness} AND ts + INTERVAL {lateness}")
    same = [c(k) == c(f"_{k}") for k in keys]
    for condition in same:
        near = near & condition
    return left.join(right, near, "left_outer").select(*keys, "ts", "hint")


def stream_page_results(pages: DataFrame, hints: DataFrame, load: Callable[[DataFrame], DataFrame | raster.PagesToMake], path: str, checkpoint: str,
                        keys: Sequence[str] = ("path",), lateness: str = "10 minutes", p: DetectionParams = DetectionParams()) -> StreamingQuery:
    """T7 with late text: regions of pages whose text shows mathematics or never came, and one result row for every page.

    ``load`` gives the pixels of some keys, or pages to make, so pixels never wait in state.  ``path/regions`` gets the regions, ``path/pages``
    (keys, hint, skipped, n_regions), by version; a page without mathematics has an empty result.
    """
    keys = list(keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch.dropDuplicates(keys))  # used twice below
        todo = batch.filter(F.coalesce("hint", F.lit(True))).select(*keys)
        found = raster.detect_regions(load(todo), keys, p=p)
        found.write.mode("overwrite").parquet(f"{path}/regions/version={batch_id}")
        n = batch.sparkSession.read.parquet(f"{path}/regions/version={batch_id}").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_regions"))
        rows = batch.join(n, keys, "left").select(*keys, "hint", (~F.coalesce("hint", F.lit(True))).alias("skipped"),
                                                  F.coalesce("n_regions", F.lit(0)).alias("n_regions"))
        rows.write.mode("overwrite").parquet(f"{path}/pages/version={batch_id}")

    return pages_with_hints(pages, hints, keys, lateness).writeStream.foreachBatch(step).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pages(pages: DataFrame, hints: DataFrame | None = None, keys: Sequence[str] = ("path",),
                 p: DetectionParams = DetectionParams()) -> DataFrame:
    """Regions of pages as they arrive; pages whose text shows no mathematics are skipped (F8)."""
    if hints is not None:
        pages = pages.join(hints.filter("NOT hint").select(*keys), list(keys), "left_anti")
    return raster.detect_regions(pages, keys, p=p)


def skip_pages_without_math(pages: DataFrame, items: DataFrame, keys: Sequence[str], order: str = "line_no") -> DataFrame:
    """F8 applied: drop pages whose text layer is there and shows no mathematics, before any pixel is read."""
    plain = corpus.page_math_hint(items, keys, order).filter("NOT hint")
    return pages.join(plain.select(*keys), list(keys), "left_anti")

