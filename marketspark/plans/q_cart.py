"""Cart and wishlist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cart as C
from .queries import query


def _lines(t):
    return C.cart_state(t.cart_events())


@query("cart_state")
def q_cart_state(t):
    """Every cart line after the whole event log."""
    return _lines(t).select("user_id", "product_id", "qty", "added_at", "added_seq",
                            F.col("snap.name").alias("name"), F.col("snap.price").alias("price"))


@query("cart_totals")
def q_cart_totals(t):
    """Item count and total per cart."""
    return C.cart_totals(_lines(t))


@query("cart_savings")
def q_cart_savings(t):
    """Savings per cart."""
    return C.cart_savings(_lines(t))


@query("cart_by_vendor")
def q_cart_by_vendor(t):
    """C4: cart lines grouped by vendor."""
    return C.cart_by_vendor(_lines(t))


@query("wishlist_state")
def q_wishlist_state(t):
    """Wishlist members per shopper."""
    return C.wishlist_state(t.wishlist_events())


@query("promo_code_check")
def q_promo_code_check(t):
    """Promo code uses by normalised code."""
    return C.promo_code_check(t.promo_code_uses())


@query("clamp_qty")
def q_clamp_qty(t):
    """Picker quantities clamped to 1..10."""
    return C.clamp_qty(t.picker_events()).select("user_id", "seq", "product_id", "qty")
