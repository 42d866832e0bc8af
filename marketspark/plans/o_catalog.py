"""Oracle SQL for catalogue and browse."""

from .o_orders import naira
from .oracle import ADAPTERS, oracle

ADAPTERS["mk_browse"] = """
SELECT 'b' || c_custkey AS request_id, 'v' || (c_custkey % (SELECT count(*) FROM supplier)) AS vendor,
       CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'RED' WHEN 2 THEN 'steel' ELSE ' ring' END AS q,
       CASE WHEN c_custkey % 3 = 0 THEN ['ECONOMY', 'PROMO'] ELSE CAST([] AS VARCHAR[]) END AS categories,
       CAST(900 + c_custkey % 100 AS DECIMAL(18,2)) AS max_price,
       c_custkey % 2 = 0 AS in_stock_only,
       CASE c_custkey % 5 WHEN 0 THEN 'price-asc' WHEN 1 THEN 'price-desc' WHEN 2 THEN 'popular'
            WHEN 3 THEN 'rating' ELSE 'default' END AS sort,
       CASE WHEN c_custkey % 3 = 1 THEN 'store' ELSE 'vendor' END AS page
FROM customer"""

ADAPTERS["b_match"] = """
SELECT r.request_id, p.id, p.pos, p.price, p.review_count, p.rating, r.sort, r.page
FROM (SELECT *, lower(CASE WHEN page = 'store' THEN trim(q) ELSE q END) AS qq FROM mk_browse) r
JOIN np p ON p.vendor = r.vendor
WHERE (r.qq = '' OR coalesce(contains(lower(p.name), r.qq), false)
       OR coalesce(contains(lower(p.category), r.qq), false)
       OR (r.page <> 'store' AND coalesce(contains(lower(p.description), r.qq), false)))
  AND (len(r.categories) = 0 OR list_contains(r.categories, p.category))
  AND p.price <= r.max_price
  AND (r.page = 'store' OR NOT r.in_stock_only OR coalesce(p.in_stock, false))"""

SORT_KEY = """CASE WHEN {m} = 'price-asc' THEN CAST(price AS DECIMAL(20,2))
                   WHEN {m} = 'price-desc' THEN -CAST(price AS DECIMAL(20,2))
                   WHEN {m} = 'popular' OR {p} = 'store' THEN -CAST(coalesce(review_count, 0) AS DECIMAL(20,2))
                   WHEN {m} = 'rating' THEN -CAST(rating AS DECIMAL(20,2))
                   ELSE CAST(0 AS DECIMAL(20,2)) END"""

oracle("load_vendors", """
SELECT * REPLACE (array_to_string(categories, '|') AS categories) FROM nv""")

oracle("load_products", """
SELECT * REPLACE (array_to_string(sizes, '|') AS sizes) FROM np""")

oracle("drop_legacy_products", "SELECT id, vendor FROM np WHERE id NOT IN (SELECT id FROM mk_legacy)")

oracle("catalog_by_vendor", """
WITH p AS (SELECT * FROM np WHERE id NOT IN (SELECT id FROM mk_legacy))
SELECT coalesce(v.id, p.vendor) AS vendor_id, p.id AS product_id, p.name AS product_name, p.pos AS product_pos,
       v.name AS vendor_name, v.pos AS vendor_pos
FROM nv v FULL OUTER JOIN p ON p.vendor = v.id""")

oracle("all_products", "SELECT p.vendor, p.id, v.pos AS vendor_pos, p.pos FROM np p JOIN nv v ON v.id = p.vendor")

oracle("search_products", """
SELECT 'store' AS variant, id FROM np
WHERE coalesce(contains(lower(name), 'red'), false) OR coalesce(contains(lower(category), 'red'), false)
UNION ALL
SELECT 'vendor_page', id FROM np
WHERE coalesce(contains(lower(name), 'brand#1'), false) OR coalesce(contains(lower(description), 'brand#1'), false)
   OR coalesce(contains(lower(category), 'brand#1'), false)""")

oracle("filter_categories", "SELECT id, category FROM np WHERE category IN ('ECONOMY', 'PROMO')")

oracle("filter_max_price", "SELECT id, price FROM np WHERE price <= 950")

oracle("filter_in_stock", "SELECT id FROM np WHERE coalesce(in_stock, false)")

oracle("sort_products", f"""
SELECT vendor, id, row_number() OVER (PARTITION BY vendor ORDER BY {SORT_KEY.format(m="'popular'", p="'vendor'")}, pos) AS rank
FROM np""")

oracle("browse_counts", """
SELECT r.request_id, (SELECT count(*) FROM b_match m WHERE m.request_id = r.request_id) AS n_results
FROM mk_browse r""")

oracle("browse_many", f"""
SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY {SORT_KEY.format(m="sort", p="page")}, pos, id) AS rank
FROM b_match""")

oracle("featured_products", """
SELECT np.id, np.name, row_number() OVER (ORDER BY nv.pos, np.pos, np.id) AS rank
FROM nv JOIN np ON np.vendor = nv.id WHERE coalesce(badge, '') <> ''
ORDER BY rank LIMIT 8""")

oracle("vendor_shelf", """
SELECT vendor, id, rank FROM (
  SELECT vendor, id, row_number() OVER (PARTITION BY vendor ORDER BY pos, id) AS rank FROM np) WHERE rank <= 4""")

oracle("related_products", """
WITH r AS (SELECT a.id AS product_id, b.id AS related_id,
                  row_number() OVER (PARTITION BY a.id ORDER BY b.pos, b.id) AS rank
           FROM np a JOIN np b ON a.vendor = b.vendor AND a.id <> b.id)
SELECT product_id, related_id, rank FROM r WHERE rank <= 6""")

oracle("product_detail", f"""
SELECT p.id AS product_id, p.name, p.vendor, v.name AS vendor_name, v.rating AS vendor_rating, v.page,
       p.price, p.original_price, CAST(p.original_price - p.price AS DECIMAL(18,2)) AS savings,
       CASE WHEN p.original_price IS NULL OR p.original_price = 0 THEN 0
            ELSE CAST(floor((1 - CAST(p.price AS DOUBLE) / CAST(p.original_price AS DOUBLE)) * 100 + 0.5) AS INTEGER)
       END AS savings_pct,
       {naira("p.price")} AS price_text,
       CASE WHEN coalesce(p.badge, '') <> '' THEN regexp_replace(lower(p.badge), '^([^ ]*) ', '\\1-') END
         AS badge_class,
       coalesce(p.size, '') AS size, p.category
FROM np p JOIN nv v ON v.id = p.vendor""")

oracle("reviews_for", """
SELECT r.id, r.product, p.vendor, r."user", r.rating, r.date, strftime(r.date, '%-d %B %Y') AS date_text,
       CAST(floor(r.rating) AS INTEGER) AS stars_full
FROM mk_reviews r JOIN np p ON p.id = r.product""")
