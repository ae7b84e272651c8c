"""Usage, quotas, codes and entitlements in batch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..params import MAX_FOLD_ROWS, PLAN_DAYS, TIER_LIMITS
from .ordered import has_hot_group, hot_groups, scan

c = F.col
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"


def period_keys(ts: Column) -> dict[str, Column]:
    """X18."""
    return {"day": F.to_date(ts), "month": F.date_format(ts, "yyyy-MM")}


def days_remaining(expiry: Column, now: Column) -> Column:
    """Whole days left, rounded up; 0 when past."""
    micros = F.unix_micros(expiry) - F.unix_micros(now)
    return F.greatest(F.lit(0).cast("bigint"), F.ceil(micros / 86_400_000_000))


def valid_email(email: Column) -> Column:
    """X20."""
    return email.rlike(EMAIL)


def masked_email(email: Column) -> Column:
    """A key for look-ups that does not show the address."""
    return F.sha2(F.lower(email), 256)


# ---------------------------------------------------------------- G7, G8
def usage_by_period(events: DataFrame) -> DataFrame:
    """Uses per user and day; months and totals add up from these rows, so events are shuffled once."""
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda period, key: days.groupBy("user_id", key.alias("key")).agg(F.sum("n").alias("n")).select(
        "user_id", F.lit(period).alias("period"), "key", "n")
    return (
        days.select("user_id", F.lit("day").alias("period"), c("day").cast("string").alias("key"), "n")
        .unionByName(one("month", F.date_format("day", "yyyy-MM")))
        .unionByName(one("total", F.lit("total"))))


def effective_tier(now: Column) -> Column:
    """Admin unless simulating (no mode is no simulation), then paid until expiry, then registered with a verified address."""
    simulating = F.coalesce(c("simulate_mode"), F.lit("none")) != "none"
    base = (
        F.when(c("is_admin") & ~simulating, "admin")
        .when(c("expires_at") > now, "paid")
        .when(c("email").isNotNull() & c("email_verified"), "registered").otherwise("anonymous"))
    return F.when(c("is_admin") & simulating, c("simulate_mode")).otherwise(base)


def tier_limit(tier: Column, which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for t, v in TIER_LIMITS.items() for x in (t, v[which])]), tier)


def quota_status(events: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """Usage today and this month against the limits of the user's tier; users known from events alone are anonymous."""
    at = F.lit(now)
    month = F.date_trunc("month", at)
    used = events.filter(c("ts") >= month).filter(c("ts") < F.add_months(month, 1)).groupBy("user_id").agg(
        F.count_if(F.to_date("ts") == F.to_date(at)).alias("today_usage"), F.count(F.lit(1)).alias("month_usage"))
    rows = users.join(used, "user_id", "full_outer").withColumn("is_admin", F.coalesce("is_admin", F.lit(False))).withColumns({
        "tier": effective_tier(at), "today_usage": F.coalesce("today_usage", F.lit(0).cast("bigint")),
        "month_usage": F.coalesce("month_usage", F.lit(0).cast("bigint")),
        "is_paid": F.coalesce(c("expires_at") > at, F.lit(False)) & ~(c("is_admin") & (F.coalesce(c("simulate_mode"), F.lit("none")) == "none")),
    })
    left = lambda which, used_: F.greatest(F.lit(0).cast("bigint"), tier_limit(c("tier"), which) - c(used_))
    rows = rows.withColumns({"_today": left(0, "today_usage"), "_month": left(1, "month_usage")})
    all_ = F.lit(TIER_LIMITS["admin"][0]).cast("bigint")
    return rows.select(
        "user_id", "tier", "today_usage", "month_usage",
        F.when(c("is_admin"), all_).otherwise(c("_today")).alias("today_remaining"),
        F.when(c("is_admin"), all_).otherwise(c("_month")).alias("month_remaining"),
        (c("is_admin") | ((c("_today") > 0) & (c("_month") > 0))).alias("can_use"),
        F.when(c("is_paid"), days_remaining(c("expires_at"), at)).alias("days_remaining"))


def quota_decisions(events: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """Allow or deny every event against the user's limits; denied events are not counted.

    With d a day's limit and m the month's, the uses allowed up to a day are min(m, sum over days of min(n, d)), so an
    event's rank within its day decides.  Admins are always allowed.
    """
    tiers = users.select("user_id", "is_admin", effective_tier(F.lit(now)).alias("tier"))
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.join(tiers, "user_id", "left").withColumns({
        "tier": F.coalesce("tier", F.lit("anonymous")), "is_admin": F.coalesce("is_admin", F.lit(False)),
        "month": F.date_trunc("month", "day")})
    days = days.withColumn("_cap", F.least(c("n"), tier_limit(c("tier"), 0)))
    days = scan(days, ["user_id", "month"], ["day"], sums={"_sum": "_cap"})
    total = F.least(c("_sum"), tier_limit(c("tier"), 1))
    prior = F.least(c("_sum") - c("_cap"), tier_limit(c("tier"), 1))
    grants = days.select("user_id", "day", "is_admin", (total - prior).alias("_allowed"))
    ranked = scan(events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], number="_rank")
    return ranked.join(grants, ["user_id", "day"]).select(
        *events.columns, (c("is_admin") | (c("_rank") <= c("_allowed"))).alias("allowed"))


# ---------------------------------------------------------------- J8
def account_lookup(emails: DataFrame, users: DataFrame) -> DataFrame:
    """Account bound to each address, with a reason when there is none."""
    bound = users.filter("email IS NOT NULL AND email_verified").groupBy("email").agg(F.min("user_id").alias("user_id"))
    return emails.join(bound, "email", "left").withColumn(
        "outcome", F.when(~valid_email(c("email")), "invalid").when(c("user_id").isNull(), "unknown").otherwise("found"))


def email_conflicts(claims: DataFrame, order: Sequence[str] = ("user_id",)) -> DataFrame:
    """Users who claim an address that an earlier claim bound to somebody else."""
    first = claims.groupBy("email").agg(F.min_by("user_id", F.struct(*order)).alias("bound_to"))
    return claims.join(first, "email").filter(c("user_id") != c("bound_to")).select("email", "user_id", "bound_to")


# ---------------------------------------------------------------- J9
def verify_codes(sends: DataFrame, attempts: DataFrame, ttl_seconds: int = 600, bound: DataFrame | None = None) -> DataFrame:
    """Outcome of each attempt against the latest code sent for its address; a code works once.

    One pass along time per address carries the latest send to the attempts after it.  Sends with ``accepted`` false
    (see `send_rate_limit`) replace no code.  With ``bound`` (email, user_id), a right code for an address that belongs to
    another account than the attempt's ``user_id`` is "bound" and stays unused.
    """
    if "accepted" in sends.columns:
        sends = sends.filter(F.coalesce("accepted", F.lit(False)))
    user = "cast(null as bigint)" if bound is None else "user_id"
    shape = lambda df, is_try: df.select("email", "ts", "event_id", "code", F.lit(is_try).alias("is_try"), (
        F.expr(user) if is_try else F.lit(None).cast("bigint")).alias("_user"))
    both = shape(sends, False).unionByName(shape(attempts, True))
    both = both.withColumn("_sent", F.when(~c("is_try"), F.struct("ts", "event_id", "code")))
    rows = scan(both, ["email"], ["ts", "event_id", "is_try"], maxs={"_last": "_sent"}).filter("is_try")
    if bound is None:
        rows = rows.withColumn("_taken", F.lit(False))
    else:
        owner = bound.groupBy("email").agg(F.min("user_id").alias("_owner"))
        rows = rows.join(owner, "email", "left").withColumn("_taken", c("_owner").isNotNull() & ~c("_owner").eqNullSafe(c("_user")))
    live = c("_last").isNotNull() & (c("ts") < c("_last.ts") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    good_form = F.coalesce(c("code"), F.lit("")).rlike(r"^.{6}\z")
    rows = rows.withColumns({
        "send_id": F.when(live, c("_last.event_id")), "_form": good_form, "_mail": valid_email(c("email")),
        "_match": live & good_form & (c("code") == c("_last.code"))})
    first = rows.filter("_match AND NOT _taken").groupBy("email", "send_id").agg(F.min(F.struct("ts", "event_id")).alias("_used"))
    rows = rows.join(first, ["email", "send_id"], "left")
    spent = F.coalesce(F.struct("ts", "event_id") > c("_used"), F.lit(False))
    outcome = (
        F.when(~c("_mail"), "invalid_email").when(~c("_form"), "invalid_code")
        .when(c("send_id").isNull() | spent, "missing").when(~c("_match"), "mismatch").when(c("_taken"), "bound").otherwise("ok"))
    return rows.select("event_id", "email", "ts", "send_id", outcome.alias("outcome"))


# ---------------------------------------------------------------- J10
def plans(spark) -> DataFrame:
    return spark.createDataFrame(list(PLAN_DAYS.items()), "amount int, days int")


def redeem_codes(redemptions: DataFrame, issued: DataFrame, pattern: str) -> DataFrame:
    """Outcome of each redemption; the first use of an existing code wins, days follow from the amount."""
    rows = redemptions.withColumn("code", F.upper(F.trim("code")))
    known = issued.select(F.upper(F.trim("code")).alias("code")).distinct().withColumn("_known", F.lit(True))
    first = rows.groupBy("code").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    days = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in PLAN_DAYS.items() for x in kv]), c("amount").cast("int"))
    joined = rows.join(known, "code", "left").join(first, "code")
    outcome = (
        F.when(~c("code").rlike(pattern), "bad_format").when(c("_known").isNull(), "unknown")
        .when(F.struct("ts", "event_id") > c("_first"), "used")
        .when(days.isNull(), "no_plan").otherwise("ok"))
    return joined.withColumns({"outcome": outcome, "_days": days}).select(
        "event_id", "ts", "user_id", "code", "amount", "outcome", F.when(c("outcome") == "ok", c("_days")).alias("days"))


# ---------------------------------------------------------------- W8
def renewal_chain(redeemed: DataFrame) -> DataFrame:
    """Expiry after each accepted redemption: it extends from the later of now and the current expiry.

    expiry_i = D_i + max over j <= i of (t_j - D_(j-1)), with D the running sum of seconds bought.
    """
    rows = redeemed.filter(c("days").isNotNull()).withColumn("_len", c("days").cast("bigint") * 86_400_000_000)
    rows = scan(rows, ["user_id"], ["ts", "event_id"], sums={"_d": "_len"})
    rows = rows.withColumn("_start", F.unix_micros("ts") - (c("_d") - c("_len")))
    rows = scan(rows, ["user_id"], ["ts", "event_id"], maxs={"_base": "_start"})
    rows = rows.withColumn("expires_at", F.timestamp_micros(c("_d") + c("_base")))
    return rows.select(*redeemed.columns, "expires_at", days_remaining(c("expires_at"), c("ts")).alias("days_left"))


# ---------------------------------------------------------------- W9
def send_rate_limit(sends: DataFrame, seconds: int = 60, limit: int = MAX_FOLD_ROWS) -> DataFrame:
    """Accept a send unless one was accepted for the same address less than ``seconds`` before.

    A pause of that length always restarts the chain, so each run between pauses is decided alone: short runs by a fold
    over their sorted times, long ones by following "next accepted" links, doubled in every round.
    """
    micros = seconds * 1_000_000
    rows = sends.withColumn("_t", F.unix_micros("ts"))
    # of several sends at one instant only the first can be accepted
    times = rows.groupBy("email", "_t").agg(F.min("event_id").alias("event_id"))
    times = scan(times, ["email"], ["_t"], previous={"_before": "_t"})
    times = times.withColumn("_gap", F.coalesce((c("_t") - c("_before") >= micros).cast("int"), F.lit(1)))
    times = scan(times, ["email"], ["_t"], sums={"_run": "_gap"}).select("email", "_run", "_t", "event_id")

    def fold(part: DataFrame) -> DataFrame:
        packed = part.groupBy("email", "_run").agg(F.array_sort(F.collect_list(F.struct("_t", "event_id"))).alias("_l"))
        first = F.slice("_l", 1, 1)
        kept = F.aggregate(F.slice("_l", 2, F.greatest(F.lit(1), F.size("_l") - 1)), first, lambda acc, r: F.when(
            r["_t"] >= F.element_at(acc, -1)["_t"] + micros, F.concat(acc, F.array(r))).otherwise(acc))
        return packed.select(F.explode(kept).alias("k")).select("k.event_id")

    key = ["email", "_run"]
    if not has_hot_group(times, key, limit):
        accepted = fold(times)
    else:
        hot = hot_groups(times, key, limit)
        accepted = fold(times.join(hot, key, "left_anti")).unionByName(
            _follow_links(times.join(hot, key, "left_semi"), micros))
    return rows.join(accepted.withColumn("_ok", F.lit(True)), "event_id", "left").select(
        *sends.columns, F.coalesce("_ok", F.lit(False)).alias("accepted"))


def _follow_links(times: DataFrame, micros: int) -> DataFrame:
    key = ["email", "_run"]
    times = cut(times)
    # next accepted = first time at or after t + limit: one sweep from the end over times and questions
    ask = times.select(*key, (c("_t") + micros).alias("_at"), c("event_id"), F.lit(0).alias("_kind"))
    have = times.select(*key, c("_t").alias("_at"), c("event_id"), F.lit(1).alias("_kind"))
    both = ask.unionByName(have).withColumn(
        "_mark", F.when(c("_kind") == 1, F.struct((-c("_at")).alias("a"), c("event_id").alias("e"))))
    swept = scan(both, key, [c("_at").desc(), c("_kind").desc(), c("event_id")], maxs={"_next": "_mark"})
    links = cut(swept.filter("_kind = 0 AND _next IS NOT NULL").select("event_id", c("_next.e").alias("next_id")))
    reached = cut(times.groupBy(*key).agg(F.min_by("event_id", "_t").alias("event_id")).select("event_id"))
    while not links.isEmpty():
        more = reached.join(links, "event_id").select(c("next_id").alias("event_id"))
        reached = cut(reached.unionByName(more).distinct())
        links = cut(links.join(links.select(c("event_id").alias("next_id"), c("next_id").alias("_far")), "next_id").select(
            "event_id", c("_far").alias("next_id")))
    return reached
