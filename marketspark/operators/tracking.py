"""Order tracking (E1-E4): shopper and vendor views of vendor orders and
the status updates sellers send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K
from .ranking import rank_stored, rank_within
from .visibility import Viewer, visible_vendor_orders

MAX_NOTE = 500
ITEMS_SCHEMA = "array<struct<id:string,name:string,price:decimal(18,2),qty:int>>"


def _newest_first(df: DataFrame, group: list[str], stored: bool = False) -> DataFrame:
    neg = -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at"))
    rank = rank_stored if stored else rank_within
    return rank(df.withColumn("_neg", neg), group, ["_neg", "id"]).drop("_neg")


def _order_cards(vendor_orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor orders as the tracking page shows them: vendor name (id when
    unknown), status label, the seller's note (null when empty), the lines
    with their totals (qty default 1) and their sum."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("_vname"))
    j = vendor_orders.join(v, "vendor_id", "left").withColumn("_items", F.from_json("items", ITEMS_SCHEMA))
    qty = lambda i: F.coalesce(i["qty"], F.lit(1))
    lines = F.transform("_items", lambda i: F.struct(
        i["name"].alias("name"), qty(i).alias("qty"), (i["price"] * qty(i)).cast("decimal(38,2)").alias("total")))
    return j.select("id", "order_id", "user_id", "vendor_id", "created_at", "status", "subtotal",
                    F.coalesce(F.col("_vname"), F.col("vendor_id")).alias("vendor_name"),
                    K.status_label(F.col("status")).alias("status_label"),
                    F.nullif(F.col("status_note"), F.lit("")).alias("status_note"), lines.alias("lines"),
                    F.array_size("_items").cast("bigint").alias("n_lines")).withColumn(
        "lines_total", F.aggregate("lines", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x["total"]).cast("decimal(38,2)")))


def my_orders(vendor_orders: DataFrame, vendors: DataFrame, viewer: Viewer | None = None, stored: bool = False) -> DataFrame:
    """The tracking page, newest first. With a viewer, all rows that F4
    lets it read (the page asks for them without a filter of its own), ranked
    as one list; without, every shopper's own orders, ranked per shopper.
    `stored` says that vendor_orders is a table, which is cheap to read twice."""
    if viewer is None:
        return _newest_first(_order_cards(vendor_orders, vendors), ["user_id"], stored)
    rows = _order_cards(visible_vendor_orders(vendor_orders, viewer), vendors).withColumn("_all", F.lit(1))
    return _newest_first(rows, ["_all"]).drop("_all")


def my_orders_by_viewer(vendor_orders: DataFrame, viewers: DataFrame) -> DataFrame:
    """E1 for a whole table of viewers (viewer_id, role, user_id, vendor_id):
    (viewer_id, id, rank) of every row F4 lets each read, newest first.

    Each branch of the policy is one equi-join, and a row that two branches
    give belongs to the first: admins read all rows, others their own orders
    and, in the vendor role, those of their vendor. The admins are a handful
    of rows, repeated per vendor order as their pages are; a hot vendor's or
    shopper's join is split by AQE, the ranking is range-partitioned."""
    vo = vendor_orders.select("id", "user_id", "vendor_id", "created_at")
    signed_in = viewers.filter(F.coalesce(F.col("role"), F.lit("anon")) != "anon")
    others = signed_in.filter(F.col("role") != "admin")
    admins = signed_in.filter(F.col("role") == "admin").agg(F.collect_list("viewer_id")).scalar()
    every = vo.select(F.explode(admins).alias("viewer_id"), "id", "created_at")
    own = others.select("viewer_id", "user_id").join(vo.drop("vendor_id"), "user_id")
    staff = (others.filter((F.col("role") == "vendor") & (F.col("vendor_id") != "")).select("viewer_id", "vendor_id", F.col("user_id").alias("_me"))
             .join(vo, "vendor_id").filter(~F.col("user_id").eqNullSafe(F.col("_me")) | F.col("_me").isNull()))
    parts = [x.select("viewer_id", "id", "created_at") for x in (every, own, staff)]
    return _newest_first(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["viewer_id"]).select("viewer_id", "id", "rank")


def vendor_queue(vendor_orders: DataFrame, stored: bool = False) -> DataFrame:
    """Each vendor's orders by status, newest first (`stored` as above)."""
    return _newest_first(vendor_orders.select("id", "vendor_id", "status", "created_at"), ["vendor_id", "status"], stored)


def apply_status_changes(vendor_orders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated vendor orders, change verdicts).

    A change is accepted when the status is one of the six, the note is at
    most 500 characters, and the actor is an admin or the vendor that owns
    the order. The latest accepted change (ts, seq, then values as
    tie-break) sets status and status_note; updated_at becomes its time.
    Only those columns change."""
    ok_status = F.col("status").isin(*K.ORDER_STATUSES)
    ok_note = F.col("status_note").isNull() | (F.char_length("status_note") <= MAX_NOTE)
    ok_actor = (F.col("actor_role") == "admin") | (
        (F.col("actor_role") == "vendor") & (F.col("actor_vendor_id") == F.col("vendor_id")))
    reason = (F.when(~F.coalesce(ok_actor, F.lit(False)), F.lit("not_allowed"))
               .when(~F.coalesce(ok_status, F.lit(False)), F.lit("invalid_status"))
               .when(~ok_note, F.lit("note_too_long")))
    verdict = changes.withColumn("reason", reason)
    latest = (verdict.filter(F.col("reason").isNull())
              .groupBy("order_key", "vendor_id")
              .agg(F.max(F.struct("ts", "seq", "status", "status_note")).alias("_m"))
              .select("order_key", "vendor_id", F.struct("_m.status", "_m.status_note", "_m.ts").alias("_c")))
    return set_latest(vendor_orders, latest), verdict


def set_latest(vendor_orders: DataFrame, latest: DataFrame) -> DataFrame:
    """Vendor orders with their latest accepted change (order_key,
    vendor_id, _c struct<status, status_note, ts>) applied; changes of
    vendor orders that do not exist fall away. All columns stay."""
    base = vendor_orders.withColumn("order_key", F.col("request_id"))
    j = base.join(latest, ["order_key", "vendor_id"], "left")
    new = {"status": F.coalesce(F.col("_c.status"), F.col("status")),
           "status_note": F.when(F.col("_c").isNotNull(), F.col("_c.status_note")).otherwise(F.col("status_note")),
           "updated_at": F.coalesce(F.col("_c.ts"), F.col("updated_at"))}
    return j.select(*(new[c].alias(c) if c in new else c for c in vendor_orders.columns))


def order_contact_link(vendor_orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Wa.me link per vendor order: vendor digits (leading 0 -> 234)
    and a greeting naming the order."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("_vname"), F.col("whatsapp").alias("_wa"))
    j = vendor_orders.select("id", "order_id", "vendor_id").join(v, "vendor_id", "left")
    d = K.wa_digits(F.col("_wa"))
    d = F.when(d.startswith("0"), F.concat(F.lit("234"), F.substring(d, 2, 1 << 30))).otherwise(d)
    msg = F.concat(F.lit("Hello "), F.coalesce(F.nullif(F.col("_vname"), F.lit("")), F.lit(K.STORE_NAME)),
                   F.lit(", I am contacting you about my order "), F.col("order_id"), F.lit("."))
    return j.select("id", d.alias("number"),
                    F.concat(F.lit("https://wa.me/"), d, F.lit("?text="), K.uri_component(msg)).alias("url"))
