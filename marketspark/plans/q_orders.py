"""Order intake queries (D1-D13) over the adapted test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..sources import loaders as L
from .inputs import intake, live
from .queries import query




@query("validate_headers")
def q_validate_headers(t):
    """Every request with the first failing header rule (null = ok)."""
    return O.validate_headers(t.order_requests()).select("request_id", "reason")


@query("validate_items")
def q_validate_items(t):
    """Item-list verdict and line count of every request."""
    df = O.parse_items(t.order_requests())
    return df.select("request_id", F.col("item_reason").alias("reason"),
                     F.when(F.col("lines").isNotNull(), F.size("lines")).cast("bigint").alias("n_lines"))


@query("merge_lines")
def q_merge_lines(t):
    """D3: merged (request, product) quantities of screened requests."""
    s = O.screen_requests(t.order_requests())
    return (s.select("request_id", F.inline_outer("merged"))
             .filter(F.col("product_id").isNotNull())
             .select("request_id", "product_id", F.col("qty").cast("bigint").alias("qty")))


@query("merge_order_lines")
def q_merge_order_lines(t):
    """D3 over relational lines: lineitem rows as order lines."""
    return O.merge_lines(t.order_lines()).select("request_id", "product_id", F.col("qty").cast("bigint").alias("qty"))


@query("canonical_lines")
def q_canonical_lines(t):
    """D4+D5: re-priced lines of accepted requests."""
    it = intake(t)
    return it.lines.select("request_id", "product_id", "vendor", "name", "price",
                           F.col("qty").cast("bigint").alias("qty"))


@query("availability_check")
def q_availability_check(t):
    """Requested vs matched ids per screened request."""
    s = O.screen_requests(t.order_requests())
    return O.availability_check(s, L.normalize_products(t.products()), live(t))


@query("order_totals")
def q_order_totals(t):
    """Total, line and unit counts per accepted request."""
    return O.order_totals(intake(t))


@query("build_orders")
def q_build_orders(t):
    """Order rows with ordered item JSON."""
    return intake(t).orders()


@query("split_by_vendor")
def q_split_by_vendor(t):
    """One vendor order per (order, vendor)."""
    return intake(t).vendor_orders()


@query("order_response")
def q_order_response(t):
    """The JSON returned per placed order."""
    return O.order_response(intake(t))


@query("whatsapp_outbox")
def q_whatsapp_outbox(t):
    """Message and wa.me link per vendor order."""
    return O.whatsapp_outbox(intake(t).vendor_orders(), L.normalize_vendors(t.vendors()))


@query("product_inquiry_link")
def q_product_inquiry_link(t):
    """Inquiry link for every product."""
    return O.product_inquiry_link(L.normalize_products(t.products()), L.normalize_vendors(t.vendors()))


@query("checkout_form_clean")
def q_checkout_form_clean(t):
    """Checkout forms built from orders and customers."""
    forms = t.checkout_forms()
    return O.checkout_form_clean(forms)


@query("intake_report")
def q_intake_report(t):
    """accepted/rejected counts and value by reason."""
    return O.intake_report(intake(t))
