"""Subscription ledger queries (H1-H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import subscriptions as H
from ..sources import loaders as L
from .queries import query

LIVE_AT = "2024-01-20 00:00:00"
TRIALS_AT = "2024-02-01 00:00:00"


def _cls(t):
    return H.classify_events(t.subscription_events())


@query("renewal_periods")
def q_renewal_periods(t):
    """H2: access period of every accepted trial, payment and grant."""
    return H.renewal_periods(_cls(t)).select("vendor_id", "seq", "kind", "plan", "d_days", "amount",
                                             "period_start", "period_end")


@query("launch_cap")
def q_launch_cap(t):
    """H3: verdict of every payment (launch cap, unknown plan, no subscription)."""
    return H.launch_cap(_cls(t)).drop("ts")


@query("plan_pricing")
def q_plan_pricing(t):
    """H4: accepted payments and revenue per plan, priced from the plan table."""
    c = _cls(t).filter((F.col("kind") == "pay") & F.col("accepted"))
    return (c.groupBy("plan").agg(F.count(F.lit(1)).alias("n_payments"),
                                  F.sum("amount").cast("decimal(18,2)").alias("revenue")))


@query("grant_days")
def q_grant_days(t):
    """H5: verdict and new access end of every grant."""
    c = _cls(t)
    return H.grant_days(c, H.renewal_periods(c)).drop("ts")


@query("subscription_status")
def q_subscription_status(t):
    """H6: plan and status per vendor."""
    c = _cls(t)
    return H.subscription_status(H.subscription_state(c, H.renewal_periods(c)))


@query("subscription_state")
def q_subscription_state(t):
    """H7: final subscription row per vendor."""
    c = _cls(t)
    return H.subscription_state(c, H.renewal_periods(c))


@query("live_subscriptions")
def q_live_subscriptions(t):
    """H8: vendors whose subscription is live on 2024-01-20."""
    c = _cls(t)
    return H.live_subscriptions(H.subscription_state(c, H.renewal_periods(c)), LIVE_AT).select(
        "vendor_id", "status", "access_ends_at")


@query("start_trials")
def q_start_trials(t):
    """H1: trials for vendors with no paid subscription yet, at 2024-02-01."""
    c = _cls(t)
    st = H.subscription_state(c, H.renewal_periods(c)).filter(F.col("n_payments") > 0)
    return H.start_trials(L.normalize_vendors(t.vendors()), st, TRIALS_AT)


@query("payment_history")
def q_payment_history(t):
    """H9: accepted payments per vendor, newest first."""
    return H.payment_history(H.renewal_periods(_cls(t)))
