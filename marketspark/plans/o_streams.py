"""Oracle SQL for the streaming forms (M1-M6): a stream over any number of
micro-batches gives the batch result over their union."""

from . import o_cart, o_orders, o_promotions, o_subscriptions, o_tracking  # noqa: F401 - their oracles are used here
from .oracle import ORACLE, oracle

for _stream, _batch in {"stream_order_intake": "split_by_vendor", "stream_cart_state": "cart_state",
                        "stream_subscriptions": "subscription_state", "stream_status": "apply_status_changes",
                        "stream_wishlist": "wishlist_state", "stream_promo_tag": "promo_impressions"}.items():
    oracle(_stream, ORACLE[_batch])
