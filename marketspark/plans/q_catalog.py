"""Catalogue and browse queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import scratch_path
from ..sources import loaders as L
from .queries import query


def _products(t):
    return L.normalize_products(t.products())


def _vendors(t):
    return L.normalize_vendors(t.vendors())


def _source_file(t, df, name: str) -> str:
    """df as the parquet file set a reader is pointed at."""
    path = scratch_path(t.spark, f"sources/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


@query("load_vendors")
def q_load_vendors(t):
    """A1: vendors read from a file with catalogue defaults applied."""
    v = L.load_vendors(t.spark, _source_file(t, t.vendors(), "vendors"))
    return v.select(*[f.name for f in L.VENDOR_SCHEMA.fields if f.name != "categories"],
                    F.array_join("categories", "|").alias("categories"))


@query("load_products")
def q_load_products(t):
    """A2: products read from a file with catalogue defaults applied."""
    p = L.load_products(t.spark, _source_file(t, t.products(), "products"))
    return p.select(*[f.name for f in L.PRODUCT_SCHEMA.fields if f.name != "sizes"], F.array_join("sizes", "|").alias("sizes"))


@query("drop_legacy_products")
def q_drop_legacy(t):
    """A3: products minus the retired id table."""
    return L.drop_legacy_products(_products(t), t.legacy_ids()).select("id", "vendor")


@query("catalog_by_vendor")
def q_catalog_by_vendor(t):
    """A4: (vendor, product) rows over the catalogue without retired ids."""
    p = L.drop_legacy_products(_products(t), t.legacy_ids())
    return C.catalog_by_vendor(_vendors(t), p)


@query("all_products")
def q_all_products(t):
    """A5: products of all vendors with vendor and catalogue positions."""
    return C.all_products(_vendors(t), _products(t)).select("vendor", "id", "vendor_pos", "pos")


@query("search_products")
def q_search_products(t):
    """B1: both search variants - store page (name+category, trimmed) and
    vendor pages (name+description+category, untrimmed)."""
    p = _products(t)
    a = C.search_products(p, " RED ", ("name", "category"), trim=True).select(
        F.lit("store").alias("variant"), "id")
    b = C.search_products(p, "brand#1", ("name", "description", "category"), trim=False).select(
        F.lit("vendor_page").alias("variant"), "id")
    return a.unionByName(b)


@query("filter_categories")
def q_filter_categories(t):
    """B2: two selected categories."""
    return C.filter_categories(_products(t), ["ECONOMY", "PROMO"]).select("id", "category")


@query("filter_max_price")
def q_filter_max_price(t):
    """Price cap 950 inclusive."""
    return C.filter_max_price(_products(t), 950).select("id", "price")


@query("filter_in_stock")
def q_filter_in_stock(t):
    """In-stock products."""
    return C.filter_in_stock(_products(t)).select("id")


@query("sort_products")
def q_sort_products(t):
    """Each vendor's products by popularity, catalogue order on ties."""
    return C.sort_products(_products(t), "popular").select("vendor", "id", "rank")


@query("browse_counts")
def q_browse_counts(t):
    """Result count per browse request."""
    return C.browse_counts(t.browse_requests(), _products(t))


@query("browse_many")
def q_browse_many(t):
    """Ranked results of every browse request."""
    return C.browse_many(t.browse_requests(), _products(t)).select("request_id", "id", "rank")


@query("featured_products")
def q_featured_products(t):
    """First 8 badged products."""
    return C.featured_products(_products(t), _vendors(t), 8).select("id", "name", "rank")


@query("vendor_shelf")
def q_vendor_shelf(t):
    """First 4 products of every vendor."""
    return C.vendor_shelf(_products(t)).select("vendor", "id", "rank")


@query("related_products")
def q_related_products(t):
    """First 6 other products of the same vendor, for every product."""
    return C.related_products(_products(t)).select("product_id", "related_id", "rank")


@query("product_detail")
def q_product_detail(t):
    """Product detail rows."""
    return C.product_detail(_products(t), _vendors(t))


@query("reviews_for")
def q_reviews_for(t):
    """Reviews joined to their product's vendor."""
    return C.reviews_for(t.reviews(), _products(t))
