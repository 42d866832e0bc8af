"""Oracle SQL for carts (C1-C7): the cart is replayed event by event per
(shopper, product) stream with a recursive CTE; clears join every stream."""

from .oracle import ADAPTERS, oracle

ADAPTERS["mk_cart"] = """
SELECT 'u' || user_id AS user_id, event_id AS seq, ts,
       CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'set'
            WHEN 'error' THEN 'remove' ELSE CASE WHEN event_id % 4 = 0 THEN 'clear' ELSE 'add' END END AS kind,
       'p' || (event_id % 5 + 5 * (user_id % 7)) AS product_id,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) % 6 - 1
            ELSE 1 + CAST(floor(value) AS INTEGER) % 4 END AS qty,
       'Item ' || (event_id % 5) AS snap_name,
       CAST(100 + CAST(floor(value) AS INTEGER) % 50 AS DECIMAL(18,2)) AS snap_price,
       CASE WHEN event_id % 3 = 0 THEN CAST(160 AS DECIMAL(18,2)) WHEN event_id % 3 = 1 THEN CAST(0 AS DECIMAL(18,2))
       END AS snap_original,
       CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || (event_id % 4) END AS snap_vendor
FROM events"""

ADAPTERS["c_streams"] = """
SELECT e.*, pp.product_id AS stream_product,
       row_number() OVER (PARTITION BY e.user_id, pp.product_id ORDER BY e.ts, e.seq) AS n
FROM mk_cart e
JOIN (SELECT DISTINCT user_id, product_id FROM mk_cart WHERE kind <> 'clear') pp
  ON pp.user_id = e.user_id AND (e.kind = 'clear' OR e.product_id = pp.product_id)"""

ADAPTERS["c_replay"] = """
SELECT user_id, product_id, 0 AS n, false AS present, 0 AS qty, CAST(NULL AS TIMESTAMP) AS fa_ts,
       CAST(NULL AS BIGINT) AS fa_seq, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DECIMAL(18,2)) AS price,
       CAST(NULL AS DECIMAL(18,2)) AS original, CAST(NULL AS VARCHAR) AS vendor
FROM (SELECT DISTINCT user_id, product_id FROM mk_cart WHERE kind <> 'clear')
UNION ALL
SELECT r.user_id, r.product_id, s.n,
  CASE WHEN s.kind = 'add' THEN true
       WHEN s.kind = 'set' AND s.qty <= 0 THEN false
       WHEN s.kind IN ('remove', 'clear') THEN false
       ELSE r.present END,
  CASE WHEN s.kind = 'add' AND r.present THEN r.qty + s.qty
       WHEN s.kind = 'add' THEN s.qty
       WHEN s.kind = 'set' AND s.qty <= 0 THEN 0
       WHEN s.kind = 'set' AND r.present THEN s.qty
       WHEN s.kind IN ('remove', 'clear') THEN 0
       ELSE r.qty END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.ts
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.fa_ts END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.seq
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.fa_seq END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.snap_name
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.name END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.snap_price
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.price END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.snap_original
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.original END,
  CASE WHEN s.kind = 'add' AND NOT r.present THEN s.snap_vendor
       WHEN (s.kind = 'set' AND s.qty <= 0) OR s.kind IN ('remove', 'clear') THEN NULL ELSE r.vendor END
FROM c_replay r JOIN c_streams s
  ON s.user_id = r.user_id AND s.stream_product = r.product_id AND s.n = r.n + 1"""

ADAPTERS["c_lines"] = """
SELECT r.* FROM c_replay r
JOIN (SELECT user_id, product_id, max(n) AS n FROM c_replay GROUP BY 1, 2) m USING (user_id, product_id, n)
WHERE r.present"""

oracle("cart_state", """
SELECT user_id, product_id, qty, fa_ts AS added_at, fa_seq AS added_seq, name, price FROM c_lines""")

oracle("cart_totals", """
SELECT user_id, CAST(sum(qty) AS BIGINT) AS n_items, CAST(sum(price * qty) AS DECIMAL(38,2)) AS total,
       count(*) AS n_lines
FROM c_lines GROUP BY user_id""")

oracle("cart_savings", """
SELECT user_id, CAST(sum((coalesce(nullif(original, 0), price) - price) * qty) AS DECIMAL(38,2)) AS savings,
       sum((coalesce(nullif(original, 0), price) - price) * qty) > 0 AS show_savings
FROM c_lines GROUP BY user_id""")

oracle("cart_by_vendor", """
SELECT user_id, coalesce(nullif(vendor, ''), 'store') AS vendor, count(*) AS n_lines,
       CAST(sum(price * coalesce(qty, 1)) AS DECIMAL(38,2)) AS total
FROM c_lines GROUP BY 1, 2""")

oracle("wishlist_state", """
SELECT user_id, product_id, added_at, added_seq FROM (
  SELECT 'u' || user_id AS user_id, 'p' || (event_id % 7 + 7 * (user_id % 5)) AS product_id, count(*) AS n,
         arg_max(ts, (ts, event_id)) AS added_at, arg_max(event_id, (ts, event_id)) AS added_seq
  FROM events GROUP BY 1, 2) WHERE n % 2 = 1""")

oracle("promo_code_check", """
SELECT code, count(*) AS n_uses, code = 'SAVE10' AS valid FROM (
  SELECT upper(trim(coalesce(CASE event_id % 5 WHEN 0 THEN ' save10 ' WHEN 1 THEN 'SAVE10' WHEN 2 THEN 'SAVE20'
                                  WHEN 3 THEN 'Save 10' END, ''))) AS code
  FROM events) GROUP BY code""")

oracle("clamp_qty", """
SELECT 'u' || user_id AS user_id, event_id AS seq, 'p' || (event_id % 5 + 5 * (user_id % 7)) AS product_id,
       greatest(1, least(10, CAST(floor(value) AS INTEGER) % 16 - 3)) AS qty
FROM events""")
