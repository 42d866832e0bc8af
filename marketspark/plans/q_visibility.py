"""Visibility queries (F1-F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import subscriptions as H
from ..operators import visibility as V
from ..sources import loaders as L
from .inputs import intake
from .queries import query

AT = "2024-01-20 00:00:00"
VENDOR_VIEWER = V.Viewer("vendor", "su14", "v14")


def _state(t):
    c = H.classify_events(t.subscription_events())
    return H.subscription_state(c, H.renewal_periods(c))


def _payments(t):
    c = H.classify_events(t.subscription_events())
    return H.renewal_periods(c).filter(F.col("kind") == "pay")


@query("visible_vendors")
def q_visible_vendors(t):
    """vendors a vendor-role viewer sees at AT."""
    return V.visible_vendors(L.normalize_vendors(t.vendors()), _state(t), VENDOR_VIEWER, AT).select("id")


@query("visible_products")
def q_visible_products(t):
    """products an anonymous viewer sees at AT."""
    return V.visible_products(L.normalize_products(t.products()), _state(t), V.Viewer("anon"), AT).select(
        "id", "vendor")


@query("visible_orders")
def q_visible_orders(t):
    """orders of one customer."""
    it = intake(t)
    return V.visible_orders(it.orders(), V.Viewer("authenticated", "u5")).select("id", "user_id")


@query("visible_vendor_orders")
def q_visible_vendor_orders(t):
    """vendor orders a vendor-role viewer sees."""
    it = intake(t)
    return V.visible_vendor_orders(it.vendor_orders(), V.Viewer("vendor", "su3", "v3")).select("id", "vendor_id")


@query("visible_promotions")
def q_visible_promotions(t):
    """promotions the public sees at AT."""
    return V.visible_promotions(t.promotions(), V.Viewer("anon"), AT).select("id", "promotion_type")


@query("visible_subscriptions")
def q_visible_subscriptions(t):
    """subscriptions a vendor-role viewer sees at AT."""
    return V.visible_subscriptions(_state(t), VENDOR_VIEWER, AT).select("vendor_id", "status")


@query("visible_payments")
def q_visible_payments(t):
    """subscription payments a vendor-role viewer sees."""
    return V.visible_payments(_payments(t), VENDOR_VIEWER).select("vendor_id", "seq")


@query("visibility_counts")
def q_visibility_counts(t):
    """F8: rows every viewer may read in every table, at AT."""
    c = H.classify_events(t.subscription_events())
    periods = H.renewal_periods(c)
    it = O.intake(t.order_requests(), L.normalize_products(t.products()), H.live_intervals(c))
    return V.visibility_counts(t.viewers(), L.normalize_vendors(t.vendors()), L.normalize_products(t.products()),
                               it.lines.select("request_id", "user_id", F.col("vendor").alias("vendor_id")), t.promotions(),
                               H.subscription_state(c, periods), periods.filter(F.col("kind") == "pay"), AT)


@query("check_changes")
def q_check_changes(t):
    """verdict of every proposed write under the table policies."""
    return V.check_changes(t.proposed_changes())


@query("canonical_lines_visible")
def q_canonical_lines_visible(t):
    """D4 with F2: the placement call runs with the caller's rights, so it
    re-prices against the catalogue a signed-in shopper may read at AT
    (products of vendors with a live subscription)."""
    cat = V.visible_products(L.normalize_products(t.products()), _state(t),
                             V.Viewer("authenticated", "u1"), AT)
    it = O.intake(t.order_requests(), cat)
    return it.lines.select("request_id", "product_id", "vendor", "name", "price",
                           F.col("qty").cast("bigint").alias("qty"))
