"""Oracle SQL for promotions."""

from .sql_fixed import BANNER_IMG, BANNER_SUB, HOME_ANCHOR
from .oracle import ADAPTERS, oracle

AT = "TIMESTAMP '2024-01-15 12:00:00'"

ADAPTERS["g_act"] = f"""
SELECT *, row_number() OVER (PARTITION BY promotion_type
                             ORDER BY coalesce(placement_level, 1) DESC, created_at DESC, id) AS rank
FROM mk_promotions
WHERE status = 'active' AND payment_status = 'paid' AND starts_at <= {AT} AND ends_at > {AT}"""

ADAPTERS["mk_views"] = """
SELECT event_id, ts, 'p' || (user_id * 13 + event_id) % (SELECT count(*) FROM part) AS product_id,
       'v' || (user_id % (SELECT count(*) FROM supplier)) AS vendor_id
FROM events"""

oracle("active_promotions", "SELECT id, rank FROM g_act WHERE promotion_type = 'product'")

oracle("homepage_vendor_order", """
WITH c AS (
  SELECT vendor_id, 0 AS src, rank AS r FROM g_act WHERE promotion_type = 'boutique' AND vendor_id IS NOT NULL
  UNION ALL SELECT id, 1, pos FROM nv),
f AS (SELECT vendor_id, src, r, row_number() OVER (PARTITION BY vendor_id ORDER BY src, r) AS k FROM c)
SELECT vendor_id, src = 0 AS promoted, row_number() OVER (ORDER BY src, r, vendor_id) AS rank
FROM f WHERE k = 1 AND vendor_id IN (SELECT id FROM nv)""")

oracle("flag_sponsored", """
SELECT 'product' AS kind, id, id IN (SELECT product_id FROM g_act WHERE promotion_type = 'product'
                                     AND product_id IS NOT NULL) AS sponsored FROM np
UNION ALL
SELECT 'vendor', id, id IN (SELECT vendor_id FROM g_act WHERE promotion_type = 'boutique'
                            AND vendor_id IS NOT NULL) FROM nv""")

oracle("homepage_featured", """
WITH sp AS (SELECT product_id, min(rank) AS r FROM g_act WHERE promotion_type = 'product' GROUP BY product_id),
spx AS (SELECT product_id, 0 AS src, r FROM sp WHERE product_id IN (SELECT id FROM np)),
org AS (SELECT np.id AS product_id, 1 AS src, row_number() OVER (ORDER BY nv.pos, np.pos, np.id) AS r
        FROM nv JOIN np ON np.vendor = nv.id WHERE coalesce(badge, '') <> '' ORDER BY r LIMIT 8),
orgx AS (SELECT * FROM org WHERE product_id NOT IN (SELECT product_id FROM sp WHERE product_id IS NOT NULL)),
allx AS (SELECT * FROM spx UNION ALL SELECT * FROM orgx)
SELECT product_id, src = 0 AS sponsored, row_number() OVER (ORDER BY src, r) AS rank
FROM allx ORDER BY src, r LIMIT 8""")

oracle("sponsored_banners", f"""
WITH b AS (
  SELECT g.*, nv.page AS vpage FROM g_act g LEFT JOIN nv ON nv.id = g.vendor_id WHERE g.promotion_type = 'banner'),
l AS (
  SELECT *, coalesce(nullif(vpage, ''),
                     CASE WHEN vendor_id IS NOT NULL AND vendor_id <> '' THEN 'store.html?vendor=' || vendor_id END,
                     {HOME_ANCHOR}) AS fb,
            trim(coalesce(link_url, '')) AS lu, trim(coalesce(image_url, '')) AS iu
  FROM b),
m AS (
  SELECT id, rank,
         CASE WHEN lu <> '' AND regexp_matches(lu, '^(https?://|[a-z0-9][a-z0-9._/-]*(\\?[^\\s]*)?$)', 'i') THEN lu
              ELSE fb END AS link,
         CASE WHEN iu <> '' AND regexp_matches(iu, '^(https?://|[a-z0-9][a-z0-9._/-]*(\\?[^\\s]*)?$)', 'i') THEN iu
              ELSE {BANNER_IMG} END AS image,
         coalesce(title, '') AS title,
         coalesce(nullif(subtitle, ''), {BANNER_SUB}) AS subtitle
  FROM l)
SELECT id, rank,
  replace(replace(replace(replace(replace(link, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS href,
  replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS title,
  replace(replace(replace(replace(replace(subtitle, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS subtitle,
  replace(replace(replace(replace(replace(image, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS image
FROM m""")

oracle("promo_impressions", """
SELECT v.event_id, p.id AS promotion_id, p.promotion_type
FROM mk_views v JOIN mk_promotions p
  ON ((p.promotion_type = 'product' AND p.product_id = v.product_id)
      OR (p.promotion_type = 'boutique' AND p.vendor_id = v.vendor_id))
 AND p.starts_at <= v.ts AND v.ts < p.ends_at
WHERE p.status = 'active' AND p.payment_status = 'paid'""")
