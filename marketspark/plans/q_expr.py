"""Column-expression queries (K1-K15) on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as K
from .queries import query

QUIZ_STRONG, QUIZ_LIGHT = K.QUIZ_STRONG, K.QUIZ_LIGHT


@query("k_expressions")
def q_k_expressions(t):
    """K1-K14 applied to customer/order/part derived values."""
    df = t._sql("""
        SELECT o_orderkey AS k, o_orderdate AS d,
               CASE o_orderkey % 6 WHEN 0 THEN '0801' || (1000000 + o_custkey)
                    WHEN 1 THEN '00234801' || (1000000 + o_custkey) WHEN 2 THEN '+44 7911 ' || (100000 + o_custkey)
                    WHEN 3 THEN '12345' WHEN 4 THEN ' 234-801-' || (1000000 + o_custkey) ELSE NULL END AS phone,
               CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey || '@example.org' WHEN 1 THEN 'bad@@x'
                    WHEN 2 THEN 'Name.' || o_custkey || '@Mail.NG' ELSE '"q w"@x.io' END AS email,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(3,2)) AS price,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(0 AS DECIMAL(18,2))
                    ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS original,
               CAST(o_orderkey % 80 - 10 AS DOUBLE) / 10 AS rating,
               CASE o_orderkey % 3 WHEN 0 THEN 'Top Rated' WHEN 1 THEN 'Best Seller Now' ELSE 'New' END AS badge,
               o_orderpriority || ' & <' || o_orderstatus || '> "q" ''s' AS text,
               CASE o_orderkey % 4 WHEN 0 THEN 'https://x.org/' || o_orderkey WHEN 1 THEN 'javascript:x'
                    WHEN 2 THEN 'store.html?vendor=v' || o_orderkey ELSE '  ' END AS link,
               CASE o_orderkey % 3 WHEN 0 THEN '30ml' WHEN 1 THEN '100ml' ELSE '75ml' END AS size,
               CASE WHEN o_orderkey % 2 = 0 THEN '  Ada Obi ' END AS display, 'Customer ' || o_custkey AS name
        FROM {o}""", o="orders")
    stars = K.star_parts(F.col("rating"))
    return df.select(
        "k",
        K.naira(F.col("amount")).alias("naira"),
        K.percent_off(F.col("price"), F.col("original")).alias("percent_off"),
        stars["full"].alias("stars_full"), stars["half"].alias("stars_half"), stars["empty"].alias("stars_empty"),
        K.phone_e164(F.col("phone")).alias("phone_e164"),
        K.wa_digits(F.col("phone")).alias("wa_digits"),
        K.uri_component(F.col("text")).alias("uri"),
        K.html_escape(F.col("text")).alias("html"),
        K.safe_url(F.col("link")).alias("safe_url"),
        K.badge_slug(F.col("badge")).alias("badge_slug"),
        K.display_name(K.blank_to_null(F.col("display")), F.col("name"), F.col("email")).alias("display_name"),
        K.first_name(F.col("name")).alias("first_name"),
        K.avatar(F.col("name")).alias("avatar"),
        K.long_date(F.col("d")).alias("long_date"),
        K.blank_to_null(F.col("display")).alias("blank_to_null"),
        K.email_ok(F.col("email")).alias("email_ok"),
        K.size_to_product(F.col("size")).alias("size_product"))


@query("quiz_scores")
def q_quiz_scores(t):
    """Quiz answers scored, split into the two recommended variants,
    with the product id of the chosen size."""
    a = t.quiz_answers()
    s = K.scent_match(F.col("vibe"), F.col("occasion"), F.col("intensity"))
    scored = a.select(s.alias("score"), F.when(s >= 94, F.lit(QUIZ_STRONG)).otherwise(F.lit(QUIZ_LIGHT)).alias("variant"),
                      K.size_to_product(F.col("size")).alias("product_id"))
    return scored.groupBy("score", "variant", "product_id").agg(F.count(F.lit(1)).alias("n_answers"))
