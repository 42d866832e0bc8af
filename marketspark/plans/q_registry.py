"""Registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import registry as R
from ..operators import subscriptions as H
from ..sources import loaders as L
from .inputs import intake
from .queries import query


def _accepted(t):
    vo = intake(t).vendor_orders()
    return R.accepted_vendor_changes(R.clean_vendor_changes(t.vendor_changes(), t.staff()), vo)


@query("clean_vendor_changes")
def q_clean_vendor_changes(t):
    """Normalised vendor requests with their verdict."""
    return R.clean_vendor_changes(t.vendor_changes(), t.staff()).select("seq", "op", "vendor_id", "email", "wa",
                                                                         "reason")


@query("merge_vendors")
def q_merge_vendors(t):
    """Vendor table after the registry log."""
    return R.merge_vendors(L.normalize_vendors(t.vendors()), _accepted(t)).withColumn("categories", F.array_join("categories", "|"))


@query("delete_vendors")
def q_delete_vendors(t):
    """Deleted vendors and the rows their delete cascades to."""
    c = H.classify_events(t.subscription_events())
    periods = H.renewal_periods(c)
    state = H.subscription_state(c, periods)
    return R.delete_vendors(_accepted(t), L.normalize_products(t.products()), t.promotions(), state,
                            periods.filter(F.col("kind") == "pay"), t.staff())


@query("reassign_vendor_staff")
def q_reassign_vendor_staff(t):
    """I4: staff rows after the registry log, linked to users."""
    return R.reassign_vendor_staff(t.staff(), _accepted(t), t.users())


@query("link_staff_users")
def q_link_staff_users(t):
    """Staff rows linked to users by lower-cased e-mail."""
    return R.link_staff_users(t.staff(), t.users())


@query("user_claims")
def q_user_claims(t):
    """User claims after the registry log."""
    acc = R.keep_staff_changes(_accepted(t))
    staff = R.reassign_vendor_staff(t.staff(), acc, t.users())
    return R.user_claims(t.users(), staff, staff_before=t.staff(), accepted=acc)


@query("vendor_access_list")
def q_vendor_access_list(t):
    """Vendors with their staff e-mail and account state."""
    staff = R.link_staff_users(t.staff(), t.users())
    return R.vendor_access_list(L.normalize_vendors(t.vendors()), staff)


@query("merge_products")
def q_merge_products(t):
    """I8: product table after the product change log."""
    # a catalogue with unset stock flags and untrimmed badges, which only a write may change
    p = (L.normalize_products(t.products())
         .withColumn("in_stock", F.when(F.col("pos") % 13 != 5, F.col("in_stock")))
         .withColumn("badge", F.when(F.col("pos") % 7 == 3, F.lit(" Hot ")).otherwise(F.col("badge"))))
    return R.merge_products(p, t.product_changes()).withColumn("sizes", F.array_join("sizes", "|"))


@query("update_vendor_info")
def q_update_vendor_info(t):
    """Vendor name, tagline, description and logo after settings updates."""
    v = L.normalize_vendors(t.vendors()).select("id", "name", "tagline", "description", "logo", "whatsapp")
    return R.update_vendor_info(v, t.vendor_settings())


@query("products_after_deletes")
def q_products_after_deletes(t):
    """Products left after the registry log's deletes."""
    return R.survivors(L.normalize_products(t.products()), "vendor", _accepted(t)).select("id", "vendor")


@query("promotions_after_deletes")
def q_promotions_after_deletes(t):
    """Promotions left: neither their vendor nor their product's was deleted."""
    acc = _accepted(t)
    owner = t.products().select(F.col("id").alias("product_id"), F.col("vendor").alias("_owner"))
    p = R.survivors(t.promotions(), "vendor_id", acc).join(owner, "product_id", "left")
    return R.survivors(p, "_owner", acc).select("id", "vendor_id", "product_id")


@query("payments_after_deletes")
def q_payments_after_deletes(t):
    """Subscription payments left after the deletes."""
    pays = H.renewal_periods(H.classify_events(t.subscription_events())).filter(F.col("kind") == "pay")
    return R.survivors(pays, "vendor_id", _accepted(t)).select("vendor_id", "seq", "plan")


@query("subscriptions_after_deletes")
def q_subscriptions_after_deletes(t):
    """Subscription rows left, and trials of newly inserted vendors."""
    c = H.classify_events(t.subscription_events())
    state = H.subscription_state(c, H.renewal_periods(c))
    return R.subscriptions_after(state, L.normalize_vendors(t.vendors()), _accepted(t), H.TRIAL_DAYS)
