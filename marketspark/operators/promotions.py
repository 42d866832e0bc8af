"""Promotions (G1-G6): placement order, home page lists, banners and the
impression interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K
from .catalog import featured_products
from .ranking import rank_within, top_k_per_group
from .visibility import promotion_live

HOME_FEATURED = 8


def _live(promotions: DataFrame, promotion_type: str, at) -> DataFrame:
    """Live promotions of one type with their order columns: placement
    level desc, created_at desc, id."""
    p = promotions.filter(promotion_live(at) & (F.col("promotion_type") == promotion_type))
    p = p.withColumn("_lvl", -F.coalesce(F.col("placement_level"), F.lit(1)).cast("int"))
    return p.withColumn("_age", -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at")))


def active_promotions(promotions: DataFrame, promotion_type: str, at) -> DataFrame:
    """G1: live promotions of one type, ranked placement_level desc,
    created_at desc, id. The ranking is one global order, so it uses the
    range-partitioned ranking (no single-partition window)."""
    return rank_within(_live(promotions, promotion_type, at), ["promotion_type"], ["_lvl", "_age", "id"]).drop("_lvl", "_age")


def _sponsored(promotions: DataFrame, promotion_type: str, at) -> DataFrame:
    """Distinct targets of live promotions with the place of their first one
    in promotion order (a struct that sorts like it; no ranking needed)."""
    col = "product_id" if promotion_type == "product" else "vendor_id"
    return (_live(promotions, promotion_type, at).groupBy(F.col(col).alias("target_id"))
            .agg(F.min(F.struct("_lvl", "_age", "id")).alias("_place")))


def homepage_vendor_order(promotions: DataFrame, vendors: DataFrame, at) -> DataFrame:
    """Promoted vendors in promotion order, then all vendors in
    catalogue order; first occurrence kept; only existing vendors."""
    promoted = _sponsored(promotions, "boutique", at).withColumnRenamed("target_id", "_vid")
    j = vendors.select("id", F.col("pos").cast("bigint").alias("_pos")).join(promoted, F.col("id") == F.col("_vid"), "left")
    first = j.select(F.col("id").alias("vendor_id"), F.col("_place").isNotNull().alias("promoted"),
                     F.when(F.col("_place").isNull(), 1).otherwise(0).alias("_src"),
                     F.coalesce("_place._lvl", F.lit(0)).alias("_lvl"), F.coalesce("_place._age", F.lit(0)).alias("_age"),
                     F.coalesce("_place.id", F.lit("")).alias("_pid_"),
                     F.when(F.col("_place").isNull(), F.col("_pos")).otherwise(F.lit(0)).alias("_pos"), F.lit("home").alias("_g"))
    return (rank_within(first, ["_g"], ["_src", "_lvl", "_age", "_pid_", "_pos", "vendor_id"])
            .select("vendor_id", "promoted", "rank"))


def flag_sponsored(products: DataFrame, vendors: DataFrame, promotions: DataFrame, at) -> DataFrame:
    """Products and vendors with a `sponsored` flag."""
    def flags(kind: str, rows: DataFrame, promotion_type: str) -> DataFrame:
        s = _sponsored(promotions, promotion_type, at).select(F.col("target_id").alias("id"), F.lit(True).alias("_s"))
        return rows.select("id").join(s, "id", "left").select(F.lit(kind).alias("kind"), "id", F.col("_s").isNotNull().alias("sponsored"))

    return flags("product", products, "product").unionByName(flags("vendor", vendors, "boutique"))


def homepage_featured(products: DataFrame, promotions: DataFrame, vendors: DataFrame, at,
                      n: int = HOME_FEATURED) -> DataFrame:
    """Sponsored products (in promotion order, existing only) then the
    first n badged products minus every sponsored id; first n overall.
    The organic list is cut to n before the subtraction, as on the page."""
    sp = _sponsored(promotions, "product", at)
    none = F.struct(F.lit(0).alias("_lvl"), F.lit(0).cast("bigint").alias("_age"), F.lit("").alias("id"))
    sp_existing = (sp.join(products.select(F.col("id").alias("target_id")), "target_id", "left_semi")
                   .orderBy("_place").limit(n)
                   .select(F.col("target_id").alias("product_id"), F.lit(0).alias("_src"), "_place",
                           F.lit(0).cast("bigint").alias("_r")))
    organic = (featured_products(products, vendors, n)
               .join(sp.select(F.col("target_id").alias("id")), "id", "left_anti")
               .select(F.col("id").alias("product_id"), F.lit(1).alias("_src"), none.alias("_place"), F.col("rank").alias("_r")))
    order = ["_src", "_place", "_r"]
    both = sp_existing.unionByName(organic).orderBy(*order).limit(n)
    # at most n rows here: a plain window is fine
    return top_k_per_group(both.withColumn("_g", F.lit(1)), ["_g"], order, n).select(
        "product_id", (F.col("_src") == 0).alias("sponsored"), "rank")


def sponsored_banners(promotions: DataFrame, vendors: DataFrame, at) -> DataFrame:
    """Live banners with safe link, image and escaped text."""
    b = active_promotions(promotions, "banner", at)
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("page").alias("_vpage"))
    j = b.join(v, "vendor_id", "left")
    fallback = F.coalesce(F.nullif(F.col("_vpage"), F.lit("")),
                          F.when(F.col("vendor_id").isNotNull() & (F.col("vendor_id") != ""),
                                 F.concat(F.lit("store.html?vendor="), F.col("vendor_id"))),
                          F.lit(K.HOME_STORES_ANCHOR))
    link = K.safe_url(F.col("link_url"), fallback)
    image = K.safe_url(F.col("image_url"), K.BANNER_IMAGE_FALLBACK)
    subtitle = F.coalesce(F.nullif(F.col("subtitle"), F.lit("")), F.lit(K.BANNER_SUBTITLE_FALLBACK))
    return j.select("id", "rank", K.html_escape(link).alias("href"), K.html_escape(F.col("title")).alias("title"),
                    K.html_escape(subtitle).alias("subtitle"), K.html_escape(image).alias("image"))


def promo_impressions(views: DataFrame, promotions: DataFrame) -> DataFrame:
    """Which product / boutique promotions were live at each view.

    Interval join without a theta join: a promotion of n UTC days is laid on
    tiles of 2^k days, the largest power of two up to n, so it covers at most
    three tiles however long it runs. A view looks up one tile per width that
    occurs among the promotions (at most 22 for dates up to the year 9999,
    read once as a scalar) by an equi-join on (target key, width, tile); the
    exact half-open test starts_at <= ts < ends_at runs after. A view lies in
    one tile of a width, so no pair is produced twice, and at least a quarter
    of the days a tile row answers for are the promotion's own."""
    p = promotions.filter((F.col("status") == "active") & (F.col("payment_status") == "paid")
                          & F.col("promotion_type").isin("product", "boutique"))
    p = p.withColumn("_key", F.when(F.col("promotion_type") == "product", F.concat(F.lit("p:"), F.col("product_id")))
                            .otherwise(F.concat(F.lit("v:"), F.col("vendor_id"))))
    p = p.filter(F.col("_key").isNotNull() & (F.col("ends_at") > F.col("starts_at")))
    first, last = _day(F.col("starts_at")), _day(F.timestamp_add("MICROSECOND", F.lit(-1), F.col("ends_at")))
    width = F.length(F.bin(last - first + 1)) - 1
    p = p.withColumn("_width", width)
    widths = p.agg(F.collect_set("_width")).scalar()
    tiles = p.select(F.col("id").alias("promotion_id"), "promotion_type", "_key", "starts_at", "ends_at", "_width",
                     F.explode(F.sequence(_tile(first, F.col("_width")), _tile(last, F.col("_width")))).alias("_tile"))
    ev = (views.select("event_id", "ts", F.explode(F.array(F.concat(F.lit("p:"), F.col("product_id")),
                                                           F.concat(F.lit("v:"), F.col("vendor_id")))).alias("_key"))
               .filter(F.col("_key").isNotNull())
               .withColumn("_width", F.explode(widths))
               .withColumn("_tile", _tile(_day(F.col("ts")), F.col("_width"))))
    j = (ev.join(tiles, ["_key", "_width", "_tile"], "inner")
           .filter((F.col("starts_at") <= F.col("ts")) & (F.col("ts") < F.col("ends_at"))))
    return j.select("event_id", "promotion_id", "promotion_type")


def _day(ts: Column) -> Column:
    """Days since 1970-01-01 (UTC)."""
    return F.unix_date(F.to_date(ts))


def _tile(day: Column, width: Column) -> Column:
    return F.call_function("shiftright", day, width)
