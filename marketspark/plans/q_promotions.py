"""Promotion queries."""

from __future__ import annotations

from ..operators import promotions as G
from ..sources import loaders as L
from .queries import query

AT = "2024-01-15 12:00:00"


@query("active_promotions")
def q_active_promotions(t):
    """G1: live product promotions in placement order."""
    return G.active_promotions(t.promotions(), "product", AT).select("id", "rank")


@query("homepage_vendor_order")
def q_homepage_vendor_order(t):
    """Vendor order on the home page."""
    return G.homepage_vendor_order(t.promotions(), L.normalize_vendors(t.vendors()), AT)


@query("flag_sponsored")
def q_flag_sponsored(t):
    """Sponsored flags of products and vendors."""
    return G.flag_sponsored(L.normalize_products(t.products()), L.normalize_vendors(t.vendors()), t.promotions(), AT)


@query("homepage_featured")
def q_homepage_featured(t):
    """The 8 featured products of the home page."""
    return G.homepage_featured(L.normalize_products(t.products()), t.promotions(), t.vendors(), AT)


@query("sponsored_banners")
def q_sponsored_banners(t):
    """Live banners with safe links and escaped text."""
    return G.sponsored_banners(t.promotions(), L.normalize_vendors(t.vendors()), AT)


@query("promo_impressions")
def q_promo_impressions(t):
    """Live promotions matched to every page view (interval join)."""
    return G.promo_impressions(t.page_views(), t.promotions())
