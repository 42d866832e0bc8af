"""Vendor subscription ledger (H1-H9) as a fold over subscription events.

Events: (vendor_id, seq, ts, kind in trial|pay|grant|suspend|resume|cancel|
refund, plan, days, notes), processed per vendor in (ts, seq) order, exactly as
the payment and management calls would have run them one by one. An event that
the log holds more than once, in all its columns, was delivered again: it
counts once.

* Whether an event is accepted depends on a small state of its vendor: is
  there a subscription yet, and how many launch-rate slots are in use, which
  in turn depends on which payments were accepted before and on refunds. Each
  event moves that state; `ranking.transition_scan` composes the moves, split
  over range partitions.
* The access end date is the fold end = max(end, t) + d over accepted
  trial / payment / grant events: a segmented prefix scan
  (`ranking.extend_scan`), no per-vendor task.
* Status, plan, period start, last payment are arg-max aggregates
  (partial aggregation, so a hot vendor is combined map-side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranking import extend_scan, rank_within, transition_scan

# ---- fixed values: plans, prices (naira), lengths (days) -------------------
PLAN_PRICES = {"launch": 5000, "monthly": 10000, "annual": 100000}
PLAN_DAYS = {"launch": 30, "monthly": 30, "annual": 365}
TRIAL_DAYS = 30
LAUNCH_LIMIT = 3
GRANT_MIN_DAYS, GRANT_MAX_DAYS = 1, 365
EPOCH = "1970-01-01 00:00:00"
DAY_US = 86_400_000_000
LIVE_STATUSES = ("trial", "active")


def _us(ts: Column) -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ, independent of the
    session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def _ts(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit(EPOCH).cast("timestamp_ntz"))


def plan_pricing(spark) -> DataFrame:
    """H4: the plan dimension (3 rows, fixed size: safe to broadcast)."""
    rows = [(p, PLAN_PRICES[p], PLAN_DAYS[p]) for p in PLAN_PRICES]
    return spark.createDataFrame(rows, "plan string, amount int, days int").select(
        "plan", F.col("amount").cast("decimal(12,2)").alias("amount"), "days")


KINDS = ("trial", "pay", "grant", "suspend", "resume", "cancel", "refund")


def _moves() -> Column:
    """How an event moves a vendor's state: 0 is no subscription, 1 + c is
    one with c launch-rate slots in use. The first trial creates the
    subscription, a launch payment takes a free slot, a refund of the launch
    plan frees the last one taken; nothing else moves the state."""
    states = range(LAUNCH_LIMIT + 2)
    table = lambda f: F.array(*[F.lit(f(s)) for s in states])
    launch = F.col("plan") == "launch"
    return (F.when(F.col("kind") == "trial", table(lambda s: max(s, 1)))
             .when((F.col("kind") == "pay") & launch, table(lambda s: s and min(s + 1, LAUNCH_LIMIT + 1)))
             .when((F.col("kind") == "refund") & launch, table(lambda s: s and max(s - 1, 1)))
             .otherwise(table(lambda s: s)))


def _by_plan(values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("plan"))


def classify_events(events: DataFrame) -> DataFrame:
    """Accept or reject each event; adds accepted, reason, d_days, amount.

    A refund names a plan: it gives back a launch-rate slot, if one is in
    use; refunds of other plans are noted and change nothing here. The result
    is cut off its lineage, as several tables are derived from it, and keeps
    the rows' places in the ledger's order (_pid, _mid) for their scans."""
    placed = transition_scan(events.distinct(), ["vendor_id"], ["ts", "seq"], _moves(), LAUNCH_LIMIT + 2, 0, "_at", keep_place=True)
    kind = F.col("kind")
    known = F.coalesce(F.col("plan").isin(*PLAN_PRICES), F.lit(False))
    reason = (F.when(kind.isNull() | ~kind.isin(*KINDS), F.lit("invalid_action"))
               .when((kind == "trial") & (F.col("_at") > 0), F.lit("subscription_exists"))
               .when(kind == "trial", F.lit(None))
               .when(F.col("_at") == 0, F.lit("subscription_not_found"))
               .when(kind.isin("pay", "refund") & ~known, F.lit("invalid_plan"))
               .when((kind == "pay") & (F.col("plan") == "launch") & (F.col("_at") > LAUNCH_LIMIT), F.lit("launch_limit_reached"))
               .when((kind == "refund") & (F.col("plan") == "launch") & (F.col("_at") == 1), F.lit("nothing_to_refund"))
               .when((kind == "grant") & (F.col("days").isNull() | ~F.col("days").between(GRANT_MIN_DAYS, GRANT_MAX_DAYS)),
                     F.lit("invalid_days")))
    d_days = (F.when(kind == "trial", F.lit(TRIAL_DAYS))
               .when(kind == "pay", _by_plan(PLAN_DAYS))
               .when(kind == "grant", F.col("days")))
    ok = F.col("reason").isNull()
    out = (placed.withColumn("reason", reason).withColumn("accepted", ok)
           .withColumn("d_days", F.when(ok, d_days))
           .withColumn("amount", F.when((kind == "pay") & ok, _by_plan(PLAN_PRICES).cast("decimal(12,2)")))
           .drop("_at"))
    return checkpointed(out)


def renewal_periods(classified: DataFrame) -> DataFrame:
    """H2 (+H5 ends): accepted trial / pay / grant events with the access
    period each produces: end = max(end_prev, ts) + d;
    period_start = end - d (for payments: greatest(previous end, ts))."""
    ext = classified.filter(F.col("accepted") & F.col("d_days").isNotNull())
    ext = ext.withColumn("_t", _us(F.col("ts"))).withColumn("_dus", F.col("d_days").cast("long") * DAY_US)
    sc = extend_scan(ext, ["vendor_id"], ["ts", "seq"], "_t", "_dus", "_end", placed=True)
    return (sc.withColumn("period_end", _ts(F.col("_end")))
              .withColumn("period_start", _ts(F.col("_end") - F.col("_dus")))
              .drop("_t", "_dus", "_end"))


def launch_cap(classified: DataFrame) -> DataFrame:
    """H3: verdict of every payment event."""
    return (classified.filter(F.col("kind") == "pay")
            .select("vendor_id", "seq", "ts", "plan", "accepted", "reason", "amount"))


def grant_days(classified: DataFrame, periods: DataFrame) -> DataFrame:
    """H5: verdict of every grant, with the new access end when accepted."""
    g = classified.filter(F.col("kind") == "grant").select("vendor_id", "seq", "ts", "days", "accepted", "reason")
    e = periods.filter(F.col("kind") == "grant").select("vendor_id", "seq", F.col("period_end").alias("access_ends_at"))
    return g.join(e, ["vendor_id", "seq"], "left")


def subscription_state(classified: DataFrame, periods: DataFrame) -> DataFrame:
    """H6 + H7: final row per vendor with a subscription."""
    acc = classified.filter(F.col("accepted") & (F.col("kind") != "refund"))     # a refund leaves the subscription as it is
    o = F.struct("ts", "seq")
    kind = F.col("kind")
    st = acc.groupBy("vendor_id").agg(
        F.min(F.when(kind == "trial", F.col("ts"))).alias("access_started_at"),
        F.max_by(F.col("plan"), F.when(kind == "pay", o)).alias("_paid_plan"),
        F.max_by(kind, F.when(kind.isin("trial", "pay", "suspend", "resume", "cancel"), o)).alias("_last_kind"),
        F.max(F.when(kind == "cancel", o)).alias("_last_cancel"),
        F.max(F.when(kind == "grant", o)).alias("_last_grant"),
        F.max(F.when(kind == "pay", F.col("ts"))).alias("last_payment_at"),
        F.max(o)["ts"].alias("updated_at"),
        F.count(F.when(kind == "pay", 1)).alias("n_payments"))
    pr = periods.groupBy("vendor_id").agg(
        F.max("period_end").alias("access_ends_at"),
        F.max_by(F.col("period_start"), F.when(kind.isin("trial", "pay"), F.struct("ts", "seq"))).alias(
            "current_period_start"))
    j = st.join(pr, "vendor_id", "inner")
    plan = F.coalesce(F.col("_paid_plan"), F.lit("trial"))
    # granted days revive a cancelled subscription, but not a suspended one
    revived = F.coalesce(F.col("_last_grant") > F.col("_last_cancel"), F.lit(False))
    status = (F.when(F.col("_last_kind") == "suspend", F.lit("suspended"))
               .when((F.col("_last_kind") == "cancel") & ~revived, F.lit("cancelled"))
               .when(plan == "trial", F.lit("trial")).otherwise(F.lit("active")))
    return j.select("vendor_id", plan.alias("plan"), status.alias("status"), "access_started_at",
                    "current_period_start", "access_ends_at", "last_payment_at", "updated_at", "n_payments")


def live_intervals(classified: DataFrame) -> DataFrame:
    """When each vendor's subscription was live: disjoint [live_from, live_to)
    per vendor_id, from the ledger's accepted events.

    After every event the row holds a status and an access end until the next
    event; it is live up to that end, if the status is. The end is the fold
    of `renewal_periods`: an event without days keeps an end behind its own
    time, and an end before it may as well move up to it, as access is over
    by then. The status is that of the last event that sets one; granted days
    revive a cancelled subscription. All of it is one `extend_scan`."""
    acc = classified.filter(F.col("accepted") & (F.col("kind") != "refund"))
    acc = acc.withColumn("_t", _us(F.col("ts"))).withColumn("_dus", F.col("d_days").cast("long") * DAY_US)
    acc = acc.select("vendor_id", "ts", "seq", "kind", "_pid", "_mid", "_t", "_dus", F.col("_t").alias("_next"))
    grant = F.col("kind") == "grant"
    sc = extend_scan(acc, ["vendor_id"], ["ts", "seq"], "_t", "_dus", "_end",
                     last={"_mode": F.when(~grant, F.struct("ts", "seq", "kind")), "_grant": F.when(grant, F.struct("ts", "seq"))},
                     following={"_next": "_t"}, placed=True)
    set_at = F.struct(F.col("_mode.ts").alias("ts"), F.col("_mode.seq").alias("seq"))
    live = F.col("_mode.kind").isin("trial", "pay", "resume") | ((F.col("_mode.kind") == "cancel") & F.coalesce(F.col("_grant") > set_at, F.lit(False)))
    until = F.least(F.col("_end"), F.coalesce(F.col("_next"), F.col("_end")))
    return (sc.filter(live & (until > F.col("_t")))
              .select("vendor_id", _ts(F.col("_t")).alias("live_from"), _ts(until).alias("live_to")))


def subscription_status(state: DataFrame) -> DataFrame:
    """H6: status per vendor."""
    return state.select("vendor_id", "plan", "status")


def live_subscriptions(state: DataFrame, at) -> DataFrame:
    """H8: trial/active with access_ends_at > at."""
    at_c = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    return state.filter(F.col("status").isin(*LIVE_STATUSES) & (F.col("access_ends_at") > at_c))


def start_trials(vendors: DataFrame, subscriptions: DataFrame, at) -> DataFrame:
    """H1: every vendor without a subscription gets a 30-day trial from `at`;
    existing subscriptions are untouched (anti join, then union)."""
    at_c = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    new = (vendors.select(F.col("id").alias("vendor_id"))
           .join(subscriptions.select("vendor_id"), "vendor_id", "left_anti")
           .select("vendor_id", F.lit("trial").alias("plan"), F.lit("trial").alias("status"),
                   at_c.alias("access_started_at"), at_c.alias("current_period_start"),
                   F.timestamp_add("DAY", F.lit(TRIAL_DAYS), at_c).alias("access_ends_at"),
                   F.lit(True).alias("is_new")))
    old = subscriptions.select("vendor_id", "plan", "status", "access_started_at", "current_period_start",
                               "access_ends_at", F.lit(False).alias("is_new"))
    return old.unionByName(new)


def payment_history(periods: DataFrame) -> DataFrame:
    """H9: accepted payments per vendor, newest first (rank 1 = newest)."""
    pays = periods.filter(F.col("kind") == "pay").withColumn(
        "notes", F.nullif(F.trim(F.col("notes")), F.lit("")))
    pays = pays.withColumn("_neg_us", -_us(F.col("ts")))
    return rank_within(pays, ["vendor_id"], ["_neg_us", -F.col("seq")]).select(
        "vendor_id", "seq", "plan", "amount", "period_start", "period_end", "notes", "rank")
