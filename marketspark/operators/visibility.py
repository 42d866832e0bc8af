"""Row visibility (F1-F8): the read policies as filters and joins.

A viewer is (role, user_id, vendor_id); roles: anon, authenticated,
vendor, admin. F1-F7 take one viewer as literals (the policy of one
request). F8 evaluates every policy for a whole table of viewers at
once: each OR-branch of a policy becomes an equi-join with a
pre-aggregated count (the order tables' from one grouping-sets pass), so
the job is linear in viewers + facts and never pairs viewers with rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

LIVE = ("trial", "active")


@dataclass(frozen=True)
class Viewer:
    role: str = "anon"
    user_id: str | None = None
    vendor_id: str | None = None

    @property
    def is_admin(self) -> bool:
        return self.role == "admin"


def _at(at) -> Column:
    return F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at


def live_vendor_ids(subscriptions: DataFrame, at) -> DataFrame:
    """Vendors with a trial/active subscription whose access ends after at."""
    return (subscriptions.filter(F.col("status").isin(*LIVE) & (F.col("access_ends_at") > _at(at)))
            .select("vendor_id").distinct())


def visible_vendors(vendors: DataFrame, subscriptions: DataFrame, viewer: Viewer, at) -> DataFrame:
    """admin, own vendor, or a live subscription (restrictive policy
    ANDed with the public read policy)."""
    if viewer.is_admin:
        return vendors
    live = live_vendor_ids(subscriptions, at).select(F.col("vendor_id").alias("id"), F.lit(True).alias("_live"))
    j = vendors.join(live, "id", "left")
    own = F.col("id") == F.lit(viewer.vendor_id or "")
    return j.filter(own | F.col("_live").isNotNull()).drop("_live")


def visible_products(products: DataFrame, subscriptions: DataFrame, viewer: Viewer, at) -> DataFrame:
    """same test on the product's vendor."""
    if viewer.is_admin:
        return products
    live = live_vendor_ids(subscriptions, at).select(F.col("vendor_id").alias("vendor"), F.lit(True).alias("_live"))
    j = products.join(live, "vendor", "left")
    own = F.col("vendor") == F.lit(viewer.vendor_id or "")
    return j.filter(own | F.col("_live").isNotNull()).drop("_live")


def live_at(rows: DataFrame, intervals: DataFrame, vendor_col: str, at_col: str, times: DataFrame | None = None) -> DataFrame:
    """Adds `live`: whether the row's vendor had a live subscription at the
    row's own time. `intervals` are disjoint (`subscriptions.live_intervals`).

    Intervals are cut at midnight, over the span of the rows' times only, and
    meet the rows by an equi-join on (vendor, day), never by time alone: a
    hot vendor's rows spread over its days, AQE splits a skewed day further,
    and touching intervals of a vendor's day are one, so a row meets as many
    as the vendor went live that day. At most one of them holds it. `times` is
    a cheaper table with the same span of at_col than rows."""
    at = F.col(at_col)
    span = (rows if times is None else times).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    spans = intervals.filter((F.col("live_to") > lo) & (F.col("live_from") <= hi))
    day0, day1 = F.to_date(F.greatest("live_from", lo)), F.to_date(F.least("live_to", hi))
    cut = spans.withColumn("_day", F.explode(F.sequence(day0, day1)))
    start = F.col("_day").cast("timestamp_ntz")
    end = F.date_add("_day", 1).cast("timestamp_ntz")
    cut = cut.select("vendor_id", "_day", F.greatest("live_from", start).alias("_from"), F.least("live_to", end).alias("_to"))
    own = Window.partitionBy("vendor_id", "_day").orderBy("_from")
    part = F.sum(F.when(F.lag("_to").over(own) == F.col("_from"), 0).otherwise(1)).over(own)
    cut = (cut.filter(F.col("_to") > F.col("_from")).withColumn("_part", part)
           .groupBy("vendor_id", "_day", "_part").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
           .groupBy("vendor_id", "_day").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans")))
    keyed = rows.withColumn("_day", F.to_date(at))
    cut = cut.withColumnsRenamed({"vendor_id": "_vendor", "_day": "_on"})
    found = keyed.join(cut, (F.col(vendor_col) == F.col("_vendor")) & (F.col("_day") == F.col("_on")), "left")
    return found.withColumn("live", live_within(F.col("_spans"), at)).drop("_day", "_vendor", "_on", "_spans")


FEW_SPANS = 64             # spans of a vendor that travel with each of its products
FEW_INTERVALS = 1024       # intervals of a vendor that one task may merge


def vendor_spans(intervals: DataFrame, most: int = FEW_SPANS, merged: int = FEW_INTERVALS) -> DataFrame:
    """(vendor_id, _spans, _busy), one row per vendor of the disjoint
    `intervals`: its spans in order, intervals that touch being one. A vendor
    of more than `merged` intervals or `most` spans has none listed and is
    busy: its rows are left to `live_at`. Cut off its lineage, as it is
    small and read more than once."""
    n = intervals.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("vendor_id").isNotNull())
    few = intervals.join(n.filter(F.col("_n") <= merged).select("vendor_id"), "vendor_id")
    own = Window.partitionBy("vendor_id").orderBy("live_from")
    part = F.sum(F.when(F.lag("live_to").over(own) == F.col("live_from"), 0).otherwise(1)).over(own)
    listed = (few.withColumn("_part", part).groupBy("vendor_id", "_part").agg(F.min("live_from").alias("_from"), F.max("live_to").alias("_to"))
              .groupBy("vendor_id").agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_spans"))
              .filter(F.size("_spans") <= most))
    return checkpointed(n.select("vendor_id").join(listed, "vendor_id", "left").withColumn("_busy", F.col("_spans").isNull()))


def live_within(spans: Column, at: Column) -> Column:
    """Whether one of the spans holds the time; false for none or no time."""
    return F.coalesce(F.exists(spans, lambda s: (s["_from"] <= at) & (at < s["_to"])), F.lit(False))


def visible_orders(orders: DataFrame, viewer: Viewer) -> DataFrame:
    """owner or admin (authenticated only)."""
    if viewer.role == "anon":
        return orders.limit(0)
    if viewer.is_admin:
        return orders
    return orders.filter(F.col("user_id") == F.lit(viewer.user_id))


def visible_vendor_orders(vendor_orders: DataFrame, viewer: Viewer) -> DataFrame:
    """owner, admin, or a vendor-role viewer of that vendor."""
    if viewer.role == "anon":
        return vendor_orders.limit(0)
    if viewer.is_admin:
        return vendor_orders
    cond = F.col("user_id") == F.lit(viewer.user_id)
    if viewer.role == "vendor" and viewer.vendor_id:
        cond = cond | (F.col("vendor_id") == F.lit(viewer.vendor_id))
    return vendor_orders.filter(F.coalesce(cond, F.lit(False)))


def promotion_live(at) -> Column:
    a = _at(at)
    return ((F.col("status") == "active") & (F.col("payment_status") == "paid")
            & (F.col("starts_at") <= a) & (F.col("ends_at") > a))


def visible_promotions(promotions: DataFrame, viewer: Viewer, at) -> DataFrame:
    """active, paid and current at `at`, or admin."""
    return promotions if viewer.is_admin else promotions.filter(promotion_live(at))


def visible_subscriptions(subscriptions: DataFrame, viewer: Viewer, at) -> DataFrame:
    """live, or admin, or the viewer's own vendor."""
    if viewer.is_admin:
        return subscriptions
    live = F.col("status").isin(*LIVE) & (F.col("access_ends_at") > _at(at))
    return subscriptions.filter(live | (F.col("vendor_id") == F.lit(viewer.vendor_id or "")))


def visible_payments(payments: DataFrame, viewer: Viewer) -> DataFrame:
    """admin or own vendor; anon sees none."""
    if viewer.role == "anon":
        return payments.limit(0)
    if viewer.is_admin:
        return payments
    return payments.filter(F.col("vendor_id") == F.lit(viewer.vendor_id or ""))


# ---- F8: all viewers in one job --------------------------------------------

def _total(df: DataFrame, cond: Column | None = None) -> Column:
    """Row count as a scalar subquery: computed once, used as a literal."""
    x = df if cond is None else df.filter(cond)
    return x.agg(F.count(F.lit(1))).scalar()


def order_counts(vendor_orders: DataFrame) -> DataFrame:
    """Orders and vendor orders by user, by vendor, by both and over all, from
    one pass over (request_id, user_id, vendor_id) rows, one per vendor order:
    (level, user_id, vendor_id, n_orders, n_vendor_orders), level being the
    grouping id: 0 both, 1 the user, 2 the vendor, 3 all."""
    per_request = vendor_orders.groupBy("request_id", "user_id").agg(F.collect_set("vendor_id").alias("_vendors"))
    rows = per_request.select("user_id", F.posexplode("_vendors").alias("_place", "vendor_id"))
    u, v = F.col("user_id"), F.col("vendor_id")
    return (rows.groupingSets([[u, v], [u], [v], []], u, v)
            .agg(F.grouping_id().cast("int").alias("level"), F.count(F.when(F.col("_place") == 0, 1)).alias("n_orders"),
                 F.count(F.lit(1)).alias("n_vendor_orders")))


def _orders_of_viewers(viewers: DataFrame, vendor_orders: DataFrame) -> DataFrame:
    """(viewer_id, _orders, _vendor_orders): each viewer asks for the counts
    its policy adds up - all for admins, else its user's, and for a vendor's
    staff the vendor's without those counted twice."""
    def ask(level, own_orders, own_vendor_orders):
        return F.struct(F.lit(level).alias("level"), F.lit(own_orders).alias("a"), F.lit(own_vendor_orders).alias("b"))
    role = F.col("role")
    asked = (F.when(role == "admin", F.array(ask(3, 1, 1)))
              .when(role == "anon", F.array().cast("array<struct<level:int,a:int,b:int>>"))
              .when(role == "vendor", F.array(ask(1, 1, 1), ask(2, 0, 1), ask(0, 0, -1)))
              .otherwise(F.array(ask(1, 1, 1))))
    keys = (viewers.select("viewer_id", "user_id", "vendor_id", F.inline(asked))
            .withColumn("_u", F.when(F.col("level") < 2, F.col("user_id")))
            .withColumn("_v", F.when(F.col("level").isin(0, 2), F.col("vendor_id"))))
    n = order_counts(vendor_orders).withColumnsRenamed({"level": "_level", "user_id": "_user", "vendor_id": "_vendor"})
    met = keys.join(n, (F.col("level") == F.col("_level")) & F.col("_u").eqNullSafe(F.col("_user")) & F.col("_v").eqNullSafe(F.col("_vendor")))
    return met.groupBy("viewer_id").agg(F.sum(F.col("a") * F.col("n_orders")).alias("_orders"),
                                        F.sum(F.col("b") * F.col("n_vendor_orders")).alias("_vendor_orders"))


def visibility_counts(viewers: DataFrame, vendors: DataFrame, products: DataFrame,
                      vendor_orders: DataFrame, promotions: DataFrame, subscriptions: DataFrame,
                      payments: DataFrame, at) -> DataFrame:
    """F8: rows each viewer (one row per viewer_id) may read in every table.
    `vendor_orders` needs request_id, user_id and vendor_id only: an order is
    a request with vendor orders."""
    a = _at(at)
    live_ids = live_vendor_ids(subscriptions, at)
    live_flag = live_ids.select("vendor_id", F.lit(True).alias("_live"))
    is_admin = F.col("role") == "admin"
    authd = F.col("role") != "anon"
    live_sub = F.col("status").isin(*LIVE) & (F.col("access_ends_at") > a)

    # whole-table totals for admins: scalar subqueries over the cheap inputs
    v = viewers.select("viewer_id", "role", "user_id", "vendor_id").select(
        "*",
        _total(vendors).alias("t_vendors"),
        _total(vendors.join(live_ids.withColumnRenamed("vendor_id", "id"), "id", "left_semi")).alias("t_live_vendors"),
        _total(products).alias("t_products"),
        _total(products.join(live_ids.withColumnRenamed("vendor_id", "vendor"), "vendor", "left_semi"))
         .alias("t_live_products"),
        _total(promotions).alias("t_promotions"),
        _total(promotions, promotion_live(at)).alias("t_live_promotions"),
        _total(subscriptions).alias("t_subs"),
        _total(subscriptions, live_sub).alias("t_live_subs"),
        _total(payments).alias("t_payments"))

    # own-vendor branches: does the viewer's vendor exist, is it live, how many products / payments
    own_vendor = (vendors.select(F.col("id").alias("vendor_id")).distinct()
                  .join(live_flag, "vendor_id", "left")
                  .select("vendor_id", F.lit(1).alias("_own_exists"), F.col("_live").alias("_own_live")))
    own_products = products.groupBy(F.col("vendor").alias("vendor_id")).agg(F.count(F.lit(1)).alias("_own_products"))
    own_subs = (subscriptions.withColumn("_is_live", F.col("status").isin(*LIVE) & (F.col("access_ends_at") > a))
                .groupBy("vendor_id").agg(F.count(F.when(~F.col("_is_live"), 1)).alias("_own_dead_subs")))
    own_pay = payments.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("_own_payments"))

    v = (v.join(own_vendor, "vendor_id", "left").join(own_products, "vendor_id", "left")
          .join(own_subs, "vendor_id", "left").join(own_pay, "vendor_id", "left")
          .join(_orders_of_viewers(viewers, vendor_orders), "viewer_id", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    own_not_live = F.col("_own_exists").isNotNull() & F.col("_own_live").isNull()
    return v.select(
        "viewer_id", "role",
        F.when(is_admin, F.col("t_vendors"))
         .otherwise(F.col("t_live_vendors") + F.when(own_not_live, 1).otherwise(0)).cast("bigint").alias("n_vendors"),
        F.when(is_admin, F.col("t_products"))
         .otherwise(F.col("t_live_products") + F.when(own_not_live, z("_own_products")).otherwise(0))
         .cast("bigint").alias("n_products"),
        z("_orders").cast("bigint").alias("n_orders"),
        z("_vendor_orders").cast("bigint").alias("n_vendor_orders"),
        F.when(is_admin, F.col("t_promotions")).otherwise(F.col("t_live_promotions")).cast("bigint")
         .alias("n_promotions"),
        F.when(is_admin, F.col("t_subs")).otherwise(F.col("t_live_subs") + z("_own_dead_subs")).cast("bigint")
         .alias("n_subscriptions"),
        F.when(~authd, 0).when(is_admin, F.col("t_payments")).otherwise(z("_own_payments")).cast("bigint")
         .alias("n_payments"))


# ---- F9: write policies ----------------------------------------------------

VENDOR_ORDER_UPDATABLE = ("status", "status_note")


def check_changes(changes: DataFrame) -> DataFrame:
    """proposed writes with the actor's claims -> accepted / rejected.

    Input columns: change_id, tbl, op (insert|update|delete), actor_role,
    actor_user_id, actor_vendor_id, old_vendor_id, new_vendor_id,
    old_user_id, new_user_id, new_status, created_by, confirmed_by,
    item_vendors array<string>, changed_columns array<string>.
    An update must pass the policy on the old row (USING) and on the new
    row (WITH CHECK). All rules are column expressions: one pass, no join."""
    admin = F.col("actor_role") == "admin"
    is_vendor = F.col("actor_role") == "vendor"
    av = F.coalesce(F.col("actor_vendor_id"), F.lit(""))
    uid = F.col("actor_user_id")
    op, tbl = F.col("op"), F.col("tbl")
    own_old = F.col("old_vendor_id") == av
    own_new = F.col("new_vendor_id") == av
    items_own = F.forall(F.coalesce(F.col("item_vendors"), F.array().cast("array<string>")),
                         lambda v: v.eqNullSafe(F.col("new_vendor_id")))
    only_status_cols = F.forall(F.coalesce(F.col("changed_columns"), F.array().cast("array<string>")),
                                lambda c: c.isin(*VENDOR_ORDER_UPDATABLE))
    vo_staff = admin | (is_vendor & own_old)
    vo_staff_new = admin | (is_vendor & own_new)
    rule = (
        F.when(uid.isNull(), F.lit(False))       # signed in means a user id; a role claim is not needed
        .when(tbl == "vendors", F.when(op == "update", admin | ((F.col("old_vendor_id") == av) & (F.col("new_vendor_id") == av)))
                                 .otherwise(admin))
        .when(tbl == "products", F.when(op == "insert", admin | own_new)
                                  .when(op == "update", (admin | own_old) & (admin | own_new))
                                  .otherwise(admin | own_old))
        .when(tbl == "orders", F.when(op == "insert", (uid == F.col("new_user_id")) & (F.col("new_status") == "pending"))
                                .when(op == "update", admin).otherwise(F.lit(False)))
        .when(tbl == "vendor_orders",
              F.when(op == "insert", (uid == F.col("new_user_id")) & (F.col("new_status") == "pending") & items_own)
               .when(op == "update", vo_staff & vo_staff_new & only_status_cols).otherwise(F.lit(False)))
        .when(tbl == "promotions", F.when(op == "insert", admin & (F.col("created_by") == uid)).otherwise(admin))
        .when(tbl == "subscriptions", admin)
        .when(tbl == "payments", F.when(op == "insert", admin & (F.col("confirmed_by") == uid)).otherwise(admin))
        .otherwise(F.lit(False)))
    ok = F.coalesce(rule, F.lit(False))
    return changes.select("change_id", "tbl", "op", ok.alias("accepted"),
                          F.when(~ok, F.lit("policy_violation")).alias("reason"))
