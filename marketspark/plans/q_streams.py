"""Streaming forms (M1-M6): each query feeds its input table to a file
source in four time-ordered file sets, runs the Structured Streaming job on
each, and returns what the sink holds. Results equal the batch twins', so
the twins' SQL is their oracle (o_streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import tracking as E
from ..session import stored
from ..sources import loaders as L
from ..streaming import streams as M
from .inputs import intake, live
from .queries import query


@query("stream_order_intake")
def q_stream_order_intake(t):
    """M1: vendor orders from the request stream (twin: split_by_vendor)."""
    products = L.normalize_products(t.products())
    spans = live(t).persist()
    base = M.replay_to_sink(t.order_requests(), "intake", "requested_at", M.stream_order_intake, "append", M.intake_batch(products, spans))
    spans.unpersist()
    return M.read_all(t.spark, f"{base}/sink", "id string")


@query("stream_cart_state")
def q_stream_cart_state(t):
    """M2: cart lines from the cart event stream (twin: cart_state)."""
    base = M.replay_to_sink(t.cart_events(), "cart", "ts", M.stream_cart_state, "update", M.cart_batch)
    return (M.read_carts(t.spark, f"{base}/sink")
             .select("user_id", "product_id", "qty", "added_at", "added_seq", "name", "price"))


@query("stream_subscriptions")
def q_stream_subscriptions(t):
    """M3: subscription rows from the event stream, which a clock tick ends
    (twin: subscription_state)."""
    events = t.subscription_events()
    base = M.replay_to_sink(events.unionByName(M.tick(events)), "subs", "ts", M.stream_subscriptions, "update", M.ledger_batch)
    return M.read_latest(t.spark, f"{base}/sink", ["vendor_id"], M.SUB_OUT).drop("n_late", "row_kind", "late_seq", "late_kind")


@query("stream_status")
def q_stream_status(t):
    """M4: vendor orders with the status changes of the change stream
    (twin: apply_status_changes)."""
    ch = t.status_changes().withColumnRenamed("request_id", "order_key")
    base = M.replay_to_sink(ch, "status", "ts", M.stream_status, "update", restart=False)
    latest = M.read_latest(t.spark, f"{base}/sink", ["order_key", "vendor_id"],
                           "order_key string, vendor_id string, status string, status_note string, ts timestamp_ntz", single=True)
    vo = stored(intake(t).vendor_orders().select("id", "order_id", "vendor_id", "request_id", "status", "status_note", "updated_at"), "vendor-orders")
    return E.set_latest(vo, latest.select("order_key", "vendor_id", F.struct("status", "status_note", "ts").alias("_c"))).select("id", "order_id", "vendor_id", "status", "status_note", "updated_at")


@query("stream_wishlist")
def q_stream_wishlist(t):
    """M5: wishlist members from the toggle stream (twin: wishlist_state)."""
    base = M.replay_to_sink(t.wishlist_events(), "wish", "ts", M.stream_wishlist, "update")
    counts = M.read_latest(t.spark, f"{base}/sink", ["user_id", "product_id"],
                           "user_id string, product_id string, n_toggles long, "
                           "last struct<ts:timestamp_ntz,seq:long>")
    return M.wishlist_from_counts(counts)


@query("stream_promo_tag")
def q_stream_promo_tag(t):
    """M6: impressions tagged as views stream in (twin: promo_impressions)."""
    base = M.replay_to_sink(t.page_views(), "promo", "ts", lambda s: M.stream_promo_tag(s, t.promotions()))
    return M.read_all(t.spark, f"{base}/sink", "event_id long, promotion_id string, promotion_type string")
