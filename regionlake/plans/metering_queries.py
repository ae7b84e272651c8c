"""Queries over usage, codes, accounts, history and stored results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import latex as lx
from ..operators import filters, lifecycle, metering
from .registry import (ATTEMPTS, HISTORY, RECOGNITIONS, REDEMPTIONS, REPLIES, SENDS, STORE, USERS, query)

c = F.col
NOW = datetime(2024, 1, 20, 12)
NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
CODE = r"^ACTV-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}\z"


@query("usage_by_period", """SELECT user_id, 'day' AS period, CAST(CAST(ts AS DATE) AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT user_id, 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY ALL
  UNION ALL SELECT user_id, 'total', 'total', count(*) FROM events GROUP BY ALL""")
def usage_by_period(spark, sf):
    return metering.usage_by_period(fx.usage(spark, sf))


_TIER = f"""t AS (SELECT *, CASE WHEN is_admin AND simulate_mode <> 'none' THEN simulate_mode WHEN is_admin THEN 'admin'
    WHEN expires_at > {NOW_SQL} THEN 'paid' WHEN email IS NOT NULL AND email_verified THEN 'registered' ELSE 'anonymous' END AS tier FROM users_fx),
  l AS (SELECT *, CASE tier WHEN 'admin' THEN 999999 WHEN 'paid' THEN 200 WHEN 'registered' THEN 10 ELSE 1 END AS dl,
    CASE tier WHEN 'admin' THEN 999999 WHEN 'paid' THEN 5000 WHEN 'registered' THEN 100 ELSE 3 END AS ml FROM t)"""


@query("quota_status", f"""WITH {USERS}, {_TIER},
  u AS (SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-20') AS d, count(*) AS m FROM events
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY user_id),
  j AS (SELECT l.*, coalesce(d, 0) AS d, coalesce(m, 0) AS m FROM l LEFT JOIN u USING (user_id))
  SELECT user_id, tier, d AS today_usage, m AS month_usage, CASE WHEN is_admin THEN 999999 ELSE greatest(0, dl - d) END AS today_remaining,
    CASE WHEN is_admin THEN 999999 ELSE greatest(0, ml - m) END AS month_remaining, is_admin OR (dl > d AND ml > m) AS can_use,
    CAST(CASE WHEN expires_at > {NOW_SQL} AND NOT (is_admin AND simulate_mode = 'none') THEN ceil(epoch(expires_at - {NOW_SQL}) / 86400.0) END AS BIGINT) AS days_remaining FROM j""")
def quota_status(spark, sf):
    return metering.quota_status(fx.usage(spark, sf), fx.users(spark, sf), NOW)


@query("quota_decisions", f"""WITH {USERS}, {_TIER},
  d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
  k AS (SELECT d.user_id, day, is_admin, ml, least(n, dl) AS cap FROM d JOIN l USING (user_id)),
  s AS (SELECT *, sum(cap) OVER (PARTITION BY user_id, date_trunc('month', day) ORDER BY day) AS run FROM k),
  e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events)
  SELECT event_id, is_admin OR r <= least(run, ml) - least(run - cap, ml) AS allowed FROM e JOIN s USING (user_id, day)""")
def quota_decisions(spark, sf):
    return metering.quota_decisions(fx.usage(spark, sf), fx.users(spark, sf), NOW).select("event_id", "allowed")


_REDEEM = f"""first AS (SELECT code, min((ts, event_id)) AS f FROM redemptions_fx GROUP BY code),
  o AS (SELECT r.*, CASE WHEN NOT regexp_matches(r.code, '^ACTV-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}$') THEN 'bad_format'
      WHEN i.code IS NULL THEN 'unknown' WHEN (r.ts, r.event_id) > f THEN 'used' WHEN days IS NULL THEN 'no_plan' ELSE 'ok' END AS outcome, days
    FROM redemptions_fx r JOIN first USING (code) LEFT JOIN issued_fx i ON i.code = r.code LEFT JOIN plans_fx USING (amount))"""


@query("redeem_codes", f"WITH {REDEMPTIONS}, {_REDEEM} SELECT event_id, user_id, code, outcome, CASE WHEN outcome = 'ok' THEN days END AS days FROM o")
def redeem_codes(spark, sf):
    return metering.redeem_codes(fx.redemptions(spark, sf), fx.issued_codes(spark, sf), CODE).select(
        "event_id", "user_id", "code", "outcome", "days")


@query("renewal_chain", f"""WITH {REDEMPTIONS}, ok AS (SELECT event_id, user_id, ts, days FROM redemptions_fx JOIN plans_fx USING (amount)),
  d AS (SELECT *, sum(days) OVER w AS run FROM ok WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  m AS (SELECT *, max(ts - to_days(CAST(run - days AS INT))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS base FROM d)
  SELECT event_id, user_id, base + to_days(CAST(run AS INT)) AS expires_at,
    CAST(ceil(epoch_us(base + to_days(CAST(run AS INT))) / 86400000000.0 - epoch_us(ts) / 86400000000.0 - 1e-9) AS BIGINT) AS days_left FROM m""")
def renewal_chain(spark, sf):
    days = F.element_at(F.create_map(*[F.lit(x) for x in (5, 30, 14, 90, 40, 365)]), c("amount"))
    rows = fx.redemptions(spark, sf).filter("amount <> 7").withColumn("days", days)
    return metering.renewal_chain(rows).select("event_id", "user_id", "expires_at", "days_left")


@query("send_rate_limit", f"""WITH RECURSIVE {SENDS},
  r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS n FROM sends_fx),
  walk AS (SELECT email, n, event_id, ts AS last, true AS accepted FROM r WHERE n = 1
    UNION ALL SELECT r.email, r.n, r.event_id, CASE WHEN r.ts >= walk.last + INTERVAL 60 SECONDS THEN r.ts ELSE walk.last END,
      r.ts >= walk.last + INTERVAL 60 SECONDS FROM walk JOIN r ON r.email = walk.email AND r.n = walk.n + 1)
  SELECT event_id, email, accepted FROM walk""")
def send_rate_limit(spark, sf):
    return metering.send_rate_limit(fx.sends(spark, sf)).select("event_id", "email", "accepted")


@query("verify_codes", f"""WITH {ATTEMPTS},
  a AS (SELECT x.event_id, x.email, x.ts, x.code, (SELECT max_by((s.event_id, s.ts, s.code), (s.ts, s.event_id)) FROM sends_fx s
      WHERE s.email = x.email AND (s.ts < x.ts OR (s.ts = x.ts AND s.event_id < x.event_id))) AS s FROM attempts_fx x),
  b AS (SELECT *, CASE WHEN ts < s[2] + INTERVAL 600 SECONDS THEN s[1] END AS send_id FROM a),
  u AS (SELECT send_id, min((ts, event_id)) AS used FROM b WHERE send_id IS NOT NULL AND code = s[3] GROUP BY send_id)
  SELECT event_id, CASE WHEN b.send_id IS NULL OR coalesce((ts, event_id) > used, false) THEN 'missing' WHEN code <> s[3] THEN 'mismatch' ELSE 'ok' END AS outcome
  FROM b LEFT JOIN u ON u.send_id = b.send_id""")
def verify_codes(spark, sf):
    return metering.verify_codes(fx.sends(spark, sf), fx.attempts(spark, sf)).select("event_id", "outcome")


@query("email_conflicts", f"""WITH {USERS}, f AS (SELECT email, min(user_id) AS bound_to FROM users_fx GROUP BY email)
  SELECT email, user_id, bound_to FROM users_fx JOIN f USING (email) WHERE user_id <> bound_to""")
def email_conflicts(spark, sf):
    return metering.email_conflicts(fx.users(spark, sf))


@query("account_lookup", f"""WITH {USERS}, asked AS (SELECT DISTINCT concat('u', CAST(user_id % 200 AS VARCHAR), CASE WHEN user_id % 9 = 0 THEN '.example.com' ELSE '@example.com' END) AS email FROM events),
  b AS (SELECT email, min(user_id) AS user_id FROM users_fx WHERE email_verified GROUP BY email)
  SELECT email, user_id, CASE WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'invalid' WHEN user_id IS NULL THEN 'unknown' ELSE 'found' END AS outcome
  FROM asked LEFT JOIN b USING (email)""".replace("\\\\", "\\"))
def account_lookup(spark, sf):
    u = c("user_id")
    asked = fx.usage(spark, sf).select(F.concat(
        F.lit("u"), (u % 200).cast("string"), F.when(u % 9 == 0, ".example.com").otherwise("@example.com")).alias("email")).distinct()
    return metering.account_lookup(asked, fx.users(spark, sf))


@query("history_search", f"""WITH {HISTORY} SELECT id, created_at, source FROM history_fx WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-18 23:59:59'
  AND is_favorite AND (contains(lower(latex), 'en') OR coalesce(contains(lower(source), 'en'), false))""")
def history_search(spark, sf):
    return filters.search_history(
        fx.history(spark, sf), "EN", datetime(2024, 1, 5), datetime(2024, 1, 18, 23, 59, 59), True).select("id", "created_at", "source")


@query("history_stats", f"""WITH {HISTORY} SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-01') AS this_month,
  count(*) FILTER (is_favorite) AS favorites FROM history_fx""")
def history_stats(spark, sf):
    return lifecycle.history_stats(fx.history(spark, sf), NOW)


@query("history_page", f"WITH {HISTORY} SELECT id, created_at FROM history_fx ORDER BY created_at DESC, id LIMIT 20")
def history_page(spark, sf):
    return lifecycle.history_page(fx.history(spark, sf), 20).select("id", "created_at")


@query("source_groups", f"""WITH {HISTORY} SELECT coalesce(source, '未分类') AS group_name, count(*) AS n, source IS NULL AS unnamed
  FROM history_fx GROUP BY source""")
def source_groups(spark, sf):
    return lifecycle.group_by_source(fx.history(spark, sf))


@query("toggle_favorites", f"""WITH {HISTORY} SELECT id, CASE WHEN id % 6 = 0 THEN NOT is_favorite ELSE is_favorite END AS is_favorite
  FROM history_fx WHERE id % 11 <> 0""")
def toggle_favorites(spark, sf):
    h = fx.history(spark, sf)
    changes = h.filter("id % 6 = 0 OR id % 11 = 0").select(
        "id", (c("id") % 11 == 0).alias("is_deleted"), (~c("is_favorite")).alias("is_favorite"))
    return lifecycle.merge_tables(h, changes).select("id", "is_favorite")


@query("recognition_summary", f"""WITH {RECOGNITIONS} SELECT page_no, count(*) AS total, count(*) FILTER (status = 'done') AS successful,
  count(*) FILTER (status = 'error') AS failed, round(avg(elapsed_ms), 6) AS mean_ms, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms,
  round(count(*) FILTER (status = 'done') / count(*), 6) AS completion_rate FROM recognitions_fx WHERE status <> 'pending' GROUP BY page_no""")
def recognition_summary(spark, sf):
    return lifecycle.recognition_summary(fx.recognitions(spark, sf), ["page_no"]).withColumns(
        {"mean_ms": F.round("mean_ms", 6), "completion_rate": F.round("completion_rate", 6)})


@query("errors_by_message", f"WITH {RECOGNITIONS} SELECT error, count(*) AS n FROM recognitions_fx WHERE status = 'error' GROUP BY error")
def errors_by_message(spark, sf):
    return lifecycle.errors_by_message(fx.recognitions(spark, sf))


@query("completed_results", f"WITH {RECOGNITIONS} SELECT id, latex FROM recognitions_fx WHERE status = 'done' AND latex <> ''")
def completed_results(spark, sf):
    return filters.filter_completed(fx.recognitions(spark, sf)).select("id", "latex")


@query("latest_version", f"""WITH {STORE} SELECT content_hash, max_by(id, (ts, id)) AS id, max(ts) AS ts FROM store_fx GROUP BY content_hash""")
def latest_version(spark, sf):
    rows = fx.store(spark, sf).select("content_hash", "id", "ts")
    return lifecycle.latest_version(rows, ["content_hash"], ["ts", "id"])


@query("apply_edits", f"""WITH {REPLIES} SELECT id, CASE WHEN contains(reply, chr(92)) OR contains(reply, '{{') THEN reply ELSE 'x' END AS latex,
  CASE WHEN contains(reply, chr(92)) OR contains(reply, '{{') THEN concat('$', reply, '$') ELSE reply END AS markdown FROM replies_fx""")
def apply_edits(spark, sf):
    rows = fx.replies(spark, sf).select("id", F.lit("x").alias("latex"), F.lit("$x$").alias("markdown"), c("reply").alias("edit"))
    return lifecycle.apply_edit(rows).select("id", "latex", "markdown")


@query("reuse_detections", f"""WITH {STORE}, s AS (SELECT content_hash, options_key, max(ts) AS stored_at FROM store_fx WHERE id % 2 = 0 AND ts >= {NOW_SQL} - INTERVAL 10 DAYS GROUP BY ALL),
  w AS (SELECT id, content_hash, options_key FROM store_fx WHERE id % 2 = 1)
  SELECT id, stored_at IS NOT NULL AS reused FROM w LEFT JOIN s USING (content_hash, options_key)""")
def reuse_detections(spark, sf):
    s = fx.store(spark, sf)
    wanted = s.filter("id % 2 = 1").select("id", "content_hash", "options_key")
    return lifecycle.reuse_detections(wanted, s.filter("id % 2 = 0"), NOW, 10 * 86_400).select("id", "reused")


@query("retain_newest", f"""WITH {STORE} SELECT owner, id FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, id) AS n FROM store_fx
  WHERE ts >= {NOW_SQL} - INTERVAL 15 DAYS) WHERE n <= 50""")
def retain_newest(spark, sf):
    return lifecycle.retain_newest(fx.store(spark, sf), 50, 15 * 86_400, NOW).select("owner", "id")


@query("trim_to_budget", f"""WITH {STORE}, t AS (SELECT owner, id, sum(bytes) OVER (PARTITION BY owner) AS total,
    sum(bytes) OVER (PARTITION BY owner ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM store_fx)
  SELECT owner, id FROM t WHERE total <= 100000 OR kept <= 80000""")
def trim_to_budget(spark, sf):
    return lifecycle.trim_to_budget(fx.store(spark, sf), 100_000).select("owner", "id")


@query("cache_stats", f"""WITH {STORE} SELECT owner, count(*) AS entries, min(ts) AS oldest_ts, min_by(id, (ts, id)) AS oldest_id,
  CAST(sum(bytes) AS BIGINT) AS bytes FROM store_fx GROUP BY owner""")
def cache_stats(spark, sf):
    return lifecycle.cache_stats(fx.store(spark, sf))


@query("provider_fallback", f"""WITH {REPLIES}, p AS (SELECT id // 4 AS id, provider, reply FROM replies_fx),
  v AS (SELECT *, CASE WHEN provider = 'backend' THEN 0 ELSE list_position(['zhipu', 'gemini', 'simpletex', 'siliconflow', 'qwen', 'local', 'anthropic', 'openai'], provider) END AS rank FROM p),
  k AS (SELECT id, min((rank, provider, reply)) FILTER (rank IS NOT NULL AND provider <> 'gemini' AND length(reply) > 12) AS b FROM v GROUP BY id)
  SELECT id, b[2] AS provider, b[3] AS reply FROM k""")
def provider_fallback(spark, sf):
    rows = fx.replies(spark, sf).select(F.floor(c("id") / 4).alias("id"), "provider", "reply")
    return lifecycle.provider_fallback(rows, F.length("reply") > 12, excluded=["gemini"])


@query("fallback_methods")
def fallback_methods(spark, sf):
    """Each method keeps the replies it can turn into valid LaTeX."""
    out = lifecycle.first_valid(fx.replies(spark, sf), "reply", [
        ("extract", lx.extract_latex), ("spans", lx.extract_all_math), ("plain", lx.normalize_latex)],
        lambda s: lx.likely_latex(s) & lx.validate_latex(s)).withColumnRenamed("result", "latex")
    return out.select("id", "method", "latex", "error")


@query("run_summary", """SELECT f_name AS file, CAST(sum(ms) AS BIGINT) AS elapsed_ms, CAST(sum(p) AS BIGINT) AS pages, CAST(sum(f) AS BIGINT) AS formulas,
  grouping(f_name) = 1 AS overall, round(sum(ms) / sum(p), 6) AS per_page_ms FROM (SELECT concat('file-', CAST(l_suppkey AS VARCHAR)) AS f_name, l_partkey % 900 AS ms, l_linenumber AS p,
    CAST(l_quantity AS BIGINT) AS f FROM lineitem) GROUP BY ROLLUP (f_name)""")
def run_summary(spark, sf):
    runs = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("file-"), c("l_suppkey").cast("string")).alias("file"), (c("l_partkey") % 900).alias("elapsed_ms"),
        c("l_linenumber").cast("bigint").alias("pages"), c("l_quantity").cast("bigint").alias("formulas"))
    return lifecycle.run_summary(runs).withColumn("per_page_ms", F.round("per_page_ms", 6))
