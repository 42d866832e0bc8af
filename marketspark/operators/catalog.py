"""Catalogue assembly (A4, A5) and browse operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K
from .ranking import rank_within, top_k_per_group
from .search import SEARCH, as_searches, candidates, row_hash

FEATURED_DEFAULT = 6
FEATURED_HOME = 8
SHELF_SIZE = 4
RELATED_SIZE = 6


def catalog_by_vendor(vendors: DataFrame, products: DataFrame) -> DataFrame:
    """A4: the catalogue as (vendor, product) rows in catalogue order.

    Every product with its vendor's name (null for an unknown vendor, which
    stays its own group), plus one row with a null product for each vendor
    that has none. Rows, not one array per vendor: a vendor's list is
    unbounded, so it is never gathered into one value."""
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"),
                       F.col("pos").alias("vendor_pos"))
    p = products.select(F.col("vendor").alias("vendor_id"), F.col("id").alias("product_id"),
                        F.col("name").alias("product_name"), F.col("pos").alias("product_pos"))
    with_vendor = p.join(v, "vendor_id", "left")
    # distinct vendor ids of products: partial aggregation dedups map-side
    empty = v.join(p.select("vendor_id").distinct(), "vendor_id", "left_anti")
    empty = empty.select("vendor_id", F.lit(None).cast("string").alias("product_id"),
                         F.lit(None).cast("string").alias("product_name"),
                         F.lit(None).cast("bigint").alias("product_pos"), "vendor_name", "vendor_pos")
    return with_vendor.unionByName(empty)


def all_products(vendors: DataFrame, products: DataFrame, vendor_ids: DataFrame | None = None) -> DataFrame:
    """A5: products of listed vendors (all vendors when no list), ordered by
    vendor position then catalogue position."""
    v = vendors.select(F.col("id").alias("vendor"), F.col("pos").alias("vendor_pos"))
    if vendor_ids is not None:
        v = v.join(vendor_ids.select(F.col("id").alias("vendor")).distinct(), "vendor", "left_semi")
    return products.join(v, "vendor", "inner")


# ---- B1-B5: single-page filters -------------------------------------------------

def search_products(products: DataFrame, q: str | Column, fields=("name", "category"),
                    trim: bool = True) -> DataFrame:
    """B1: case-insensitive literal substring over fields (OR). Empty query
    keeps all rows. Null fields never match."""
    qc = F.lit(q) if isinstance(q, str) else q
    qc = F.lower(F.trim(qc) if trim else qc)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), qc), F.lit(False))
    return products.filter((qc == "") | hit)


def filter_categories(products: DataFrame, categories: list[str]) -> DataFrame:
    """B2: keep rows whose category is selected; empty selection = all."""
    if not categories:
        return products
    return products.filter(F.col("category").isin(list(categories)))


def filter_max_price(products: DataFrame, cap) -> DataFrame:
    """Price <= cap (inclusive)."""
    return products.filter(F.col("price") <= F.lit(cap).cast("decimal(18,2)"))


def filter_in_stock(products: DataFrame, only: bool = True) -> DataFrame:
    """in_stock is true (null counts as out of stock)."""
    return products.filter(F.coalesce(F.col("in_stock"), F.lit(False))) if only else products


def sort_key(mode: Column, page: Column | None = None) -> Column:
    """B5 sort key (ascending); ties fall to catalogue position.

    Vendor pages: price-asc, price-desc, popular (review count desc),
    rating (desc, 5 where there is none), anything else keeps
    catalogue order. The store page sorts by popularity for anything that
    is not a price sort."""
    page = page if page is not None else F.lit("vendor")
    price = F.col("price").cast("decimal(20,2)")
    pop = F.coalesce(F.col("review_count"), F.lit(0)).cast("decimal(20,2)")
    return (F.when(mode == "price-asc", price)
             .when(mode == "price-desc", -price)
             .when((mode == "popular") | (page == "store"), -pop)
             .when(mode == "rating", -F.coalesce(F.nullif(F.col("rating"), F.lit(0)), F.lit(5)).cast("decimal(20,2)"))
             .otherwise(F.lit(0).cast("decimal(20,2)")))


def sort_products(products: DataFrame, mode: str, group: str = "vendor", page: str = "vendor") -> DataFrame:
    """Rank each vendor's products by mode. Skew-safe ranking."""
    df = products.withColumn("_key", sort_key(F.lit(mode), F.lit(page)))
    return rank_within(df, [group], [F.col("_key"), F.col("pos")]).drop("_key")


# ---- B6, B7: many browse requests at once -----------------------------------------

def browse_matches(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Products matching each browse request, found through the inverted
    index of `search` and then checked exactly. `page` is 'store' (search over
    name and category with the query trimmed, no stock filter) or a vendor
    page (name, description and category, query untrimmed, optional
    in-stock filter)."""
    r = as_searches(requests.select("request_id", "vendor", "q", "categories", "max_price", "in_stock_only", "sort", "page"))
    p = products.select("id", "vendor", "name", "description", "category", "price", "in_stock",
                        "review_count", "rating", "pos")
    found = candidates(r, p)
    p = p.withColumn("_row", row_hash(p)).drop("vendor")
    j = (r.join(found.withColumnsRenamed({"id": "_id", "row": "_row"}), SEARCH)
          .join(p.withColumnRenamed("_row", "_prow"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("_prow"))))
    store, q = F.col("_store"), F.col("_q")
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    hit = has("name") | has("category") | (~store & has("description"))
    cats_ok = (F.coalesce(F.array_size("categories"), F.lit(0)) == 0) | F.array_contains("categories", F.col("category"))
    stock_ok = store | ~F.coalesce(F.col("in_stock_only"), F.lit(False)) | F.coalesce(F.col("in_stock"), F.lit(False))
    keep = ((q == "") | hit) & F.coalesce(cats_ok, F.lit(False)) & (F.col("price") <= F.col("max_price")) & stock_ok
    return j.filter(keep).drop("_id", "_row", "_prow", "_store", "_q", "_cats")


def browse_many(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Ranked results of every browse request."""
    m = browse_matches(requests, products).withColumn("_key", sort_key(F.col("sort"), F.col("page")))
    return rank_within(m, ["request_id"], [F.col("_key"), F.col("pos"), F.col("id")]).drop("_key")


def browse_counts(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Result count per request, 0 for requests with no match."""
    c = browse_matches(requests, products).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_results"))
    return (requests.select("request_id").join(c, "request_id", "left")
            .select("request_id", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results")))


# ---- B8-B12 -----------------------------------------------------------------------

def featured_products(products: DataFrame, vendors: DataFrame, n: int = FEATURED_DEFAULT) -> DataFrame:
    """First n badged products of the catalogue, which lists vendor by
    vendor (a top-n: each task keeps n rows, then one merge). Products of
    unknown vendors come last."""
    v = vendors.select(F.col("id").alias("_vid"), F.col("pos").alias("_vpos"))
    badged = products.filter(F.coalesce(F.col("badge"), F.lit("")) != "")
    order = [F.col("_vpos").asc_nulls_last(), "pos", "id"]
    top = badged.join(v, badged["vendor"] == v["_vid"], "left").orderBy(*order).limit(n)
    return top_k_per_group(top.withColumn("_all", F.lit(1)), ["_all"], order, n).drop("_all", "_vid", "_vpos")


def vendor_shelf(products: DataFrame, k: int = SHELF_SIZE) -> DataFrame:
    """First k products of each vendor."""
    return top_k_per_group(products, ["vendor"], ["pos", "id"], k)


def related_products(products: DataFrame, k: int = RELATED_SIZE) -> DataFrame:
    """For each product the first k other products of its vendor.

    Only the first k+1 of each vendor can appear, so each product is
    joined to k+1 candidates (O((k+1) n) rows, never all pairs), its own
    row dropped and the rest re-ranked."""
    cand = top_k_per_group(products.select("vendor", "id", "pos"), ["vendor"], ["pos", "id"], k + 1, "_r")
    cand = cand.select("vendor", F.col("id").alias("related_id"), F.col("pos").alias("_rpos"), "_r")
    j = (products.select(F.col("id").alias("product_id"), "vendor")
                 .join(cand, "vendor", "inner")
                 .filter(F.col("related_id") != F.col("product_id")))
    return top_k_per_group(j, ["product_id"], ["_r"], k).drop("_r", "_rpos")


def product_detail(products: DataFrame, vendors: DataFrame) -> DataFrame:
    """Product with its vendor (inner: unknown vendor drops the row),
    savings and percent off."""
    v = vendors.select(F.col("id").alias("vendor"), F.col("name").alias("vendor_name"),
                       F.col("rating").alias("vendor_rating"), "page")
    j = products.join(v, "vendor", "inner")
    return j.select(
        F.col("id").alias("product_id"), "name", "vendor", "vendor_name", "vendor_rating", "page", "price",
        "original_price",
        (F.col("original_price") - F.col("price")).cast("decimal(18,2)").alias("savings"),
        K.percent_off(F.col("price"), F.col("original_price")).alias("savings_pct"),
        K.naira(F.col("price")).alias("price_text"),
        F.when(F.coalesce(F.col("badge"), F.lit("")) != "", K.badge_slug(F.col("badge"))).alias("badge_class"),
        F.coalesce(F.col("size"), F.lit("")).alias("size"), "category")


def reviews_for(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews of each product, with the product's vendor."""
    p = products.select(F.col("id").alias("product"), "vendor")
    return (reviews.join(p, "product", "inner")
                   .select("id", "product", "vendor", "user", "rating", "date",
                           K.long_date(F.col("date")).alias("date_text"),
                           K.star_parts(F.col("rating"))["full"].alias("stars_full")))
