"""Order tracking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import tracking as E
from ..operators.visibility import Viewer
from ..operators.visibility import visible_orders
from ..session import discard, scratch_path, stored
from ..sources import loaders as L
from ..sources.sinks import read_mart, rewrite_days, write_mart
from .inputs import intake
from .queries import query


def _vo(t):
    return intake(t).vendor_orders()


def _updated(t):
    """Vendor orders after the sellers' status updates."""
    return _changed(t, _vo(t))


def _changed(t, vendor_orders):
    return E.apply_status_changes(vendor_orders, t.status_changes().withColumnRenamed("request_id", "order_key"))[0]


# columns of a vendor order that its page does not show
DETAILS = ("customer_name", "customer_email", "customer_phone", "customer_address", "n_items")


@query("my_orders")
def q_my_orders(t):
    """Every shopper's vendor orders, newest first, with the lines and the seller's note."""
    # the intake, the status changes and the ranking each end before the next begins, so what they shuffle is not on disk at once
    placed = stored(_vo(t).drop(*DETAILS), "vendor-orders")
    updated = stored(_changed(t, placed), "updated-orders")
    discard(placed)
    return _pages(t, updated)


def _pages(t, vendor_orders):
    line = lambda x: F.concat_ws(" ", x["name"], F.lit("x"), x["qty"].cast("string"), F.lit("="), x["total"].cast("string"))
    return E.my_orders(vendor_orders, L.normalize_vendors(t.vendors()), stored=True).select(
        "user_id", "id", "vendor_name", "status_label", "status_note", F.array_join(F.transform("lines", line), "\n").alias("lines"),
        "lines_total", "n_lines", "rank")


@query("my_orders_viewer")
def q_my_orders_viewer(t):
    """E1 under F4: the page of one vendor's owner."""
    return E.my_orders(_updated(t), L.normalize_vendors(t.vendors()), Viewer("vendor", "su3", "v3")).select(
        "id", "user_id", "vendor_id", "status_label", "status_note", "rank")


@query("my_orders_by_viewer")
def q_my_orders_by_viewer(t):
    """E1 under F4: the pages of all customers, vendor owners and admins."""
    return E.my_orders_by_viewer(_vo(t), t.viewers())


@query("vendor_queue")
def q_vendor_queue(t):
    """Each vendor's orders by status, newest first."""
    return E.vendor_queue(_vo(t)).select("vendor_id", "status", "id", "rank")


@query("apply_status_changes")
def q_apply_status_changes(t):
    """Vendor orders after the sellers' status updates."""
    return _updated(t).select("id", "order_id", "vendor_id", "status", "status_note", "updated_at")


@query("status_change_verdicts")
def q_status_change_verdicts(t):
    """Accepted / rejected count of status changes by reason."""
    ch = t.status_changes().withColumnRenamed("request_id", "order_key")
    _, verdict = E.apply_status_changes(_vo(t), ch)
    return verdict.groupBy("reason").agg(F.count(F.lit(1)).alias("n_changes"))


@query("order_contact_link")
def q_order_contact_link(t):
    """WhatsApp contact link per vendor order."""
    return E.order_contact_link(_vo(t), L.normalize_vendors(t.vendors()))


def _stored(t, rows, key):
    """rows written as a mart; its path."""
    path = scratch_path(t.spark, f"mart-{uuid.uuid4().hex}")
    write_mart(rows, path, key, "created_at")
    return path


def _vo_mart(t):
    """The vendor orders mart's path. What the intake shuffles goes before the rows are dealt by day and vendor."""
    placed = stored(_vo(t), "vendor-orders")
    path = _stored(t, placed, "vendor_id")
    discard(placed)
    return path


@query("mart_visible_orders")
def q_mart_visible_orders(t):
    """F3 from the orders mart: one customer's orders, found by the files' key ranges."""
    path = _stored(t, intake(t).orders(), "user_id")
    viewer = Viewer("authenticated", "u5")
    return visible_orders(read_mart(t.spark, path, "user_id", viewer.user_id), viewer).select("id", "user_id")


@query("mart_vendor_queue")
def q_mart_vendor_queue(t):
    """E2 from the vendor orders mart."""
    return E.vendor_queue(read_mart(t.spark, _vo_mart(t)), stored=True).select("vendor_id", "status", "id", "rank")


@query("mart_my_orders")
def q_mart_my_orders(t):
    """E3 applied to the mart itself (only the days whose orders changed are written anew), then E1 read from it."""
    path = _vo_mart(t)
    # stored, as the changed days are found first and their rows read then
    updated = stored(_changed(t, read_mart(t.spark, path)), "updated-orders")
    day = F.to_date("created_at").alias("_day")
    changed = updated.filter(F.col("updated_at") != F.col("created_at")).select(day).distinct()
    # a row per day: broadcast, as the orders would move for this join alone
    rewrite_days(updated.withColumn("_day", day).join(F.broadcast(changed), "_day", "left_semi").drop("_day"), path, "vendor_id", "created_at")
    discard(updated)
    return _pages(t, read_mart(t.spark, path))
