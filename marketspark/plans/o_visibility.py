"""Oracle SQL for visibility (F1-F8): each policy as a predicate, and F8
by counting, per viewer, the rows that pass it."""

from .oracle import ADAPTERS, oracle

ADAPTERS["mk_viewers"] = """
SELECT 'cu' || c_custkey AS viewer_id, 'authenticated' AS role, 'u' || c_custkey AS user_id,
       CAST(NULL AS VARCHAR) AS vendor_id FROM customer
UNION ALL SELECT 've' || s_suppkey, 'vendor', 'su' || s_suppkey, 'v' || s_suppkey FROM supplier
UNION ALL SELECT 'admin0', 'admin', 'u0', NULL
UNION ALL SELECT 'anon', 'anon', NULL, NULL"""

ADAPTERS["f_live"] = """
SELECT DISTINCT vendor_id FROM s_state
WHERE status IN ('trial', 'active') AND access_ends_at > TIMESTAMP '2024-01-20 00:00:00'"""

ADAPTERS["f_pay"] = "SELECT * FROM s_periods WHERE kind = 'pay'"

ADAPTERS["mk_promotions"] = """
SELECT 'm' || p_partkey AS id, 'product' AS promotion_type,
       'v' || (p_partkey % (SELECT count(*) FROM supplier)) AS vendor_id, 'p' || p_partkey AS product_id,
       CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS subtitle,
       CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS link_url,
       CAST(1 + p_partkey % 3 AS SMALLINT) AS placement_level,
       CAST(1000 * (1 + p_partkey % 3) AS DECIMAL(12,2)) AS amount_paid,
       CASE WHEN p_partkey % 4 = 3 THEN 'pending' ELSE 'paid' END AS payment_status,
       CASE WHEN p_partkey % 6 = 5 THEN 'paused' ELSE 'active' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 28 AS INTEGER)) AS starts_at,
       TIMESTAMP '2024-01-08 00:00:00' + to_days(CAST(p_partkey % 28 AS INTEGER)) AS ends_at,
       TIMESTAMP '2023-12-20 00:00:00' + to_days(CAST(p_partkey % 9 AS INTEGER)) AS created_at
FROM part
UNION ALL
SELECT 'b' || s_suppkey, 'boutique', 'v' || s_suppkey, NULL, NULL, NULL, NULL, NULL,
       CAST(1 + s_suppkey % 3 AS SMALLINT), CAST(5000 AS DECIMAL(12,2)), 'paid', 'active',
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey % 28 AS INTEGER)),
       TIMESTAMP '2024-01-08 00:00:00' + to_days(CAST(s_suppkey % 28 AS INTEGER)),
       TIMESTAMP '2023-12-20 00:00:00' + to_days(CAST(s_suppkey % 9 AS INTEGER))
FROM supplier
UNION ALL
SELECT 'n' || r_regionkey, 'banner', CASE WHEN r_regionkey % 2 = 0 THEN 'v' || r_regionkey END, NULL,
       r_name, CASE WHEN r_regionkey % 3 = 0 THEN NULL ELSE 'Region ' || r_regionkey || ' & <deals>' END,
       CASE WHEN r_regionkey % 2 = 1 THEN 'img/banner' || r_regionkey || '.jpg' END,
       CASE r_regionkey % 4 WHEN 0 THEN 'https://example.org/r' || r_regionkey
            WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN 'store.html?vendor=v2' END,
       CAST(1 AS SMALLINT), CAST(20000 AS DECIMAL(12,2)), 'paid', 'active',
       TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2023-12-20 00:00:00'
FROM region"""

oracle("visible_vendors", "SELECT id FROM nv WHERE id = 'v14' OR id IN (SELECT vendor_id FROM f_live)")

oracle("visible_products", "SELECT id, vendor FROM np WHERE vendor IN (SELECT vendor_id FROM f_live)")

oracle("visible_orders", "SELECT id, user_id FROM o_orders WHERE user_id = 'u5'")

oracle("visible_vendor_orders", "SELECT id, vendor_id FROM o_vendor_orders WHERE user_id = 'su3' OR vendor_id = 'v3'")

oracle("visible_promotions", """
SELECT id, promotion_type FROM mk_promotions
WHERE status = 'active' AND payment_status = 'paid'
  AND starts_at <= TIMESTAMP '2024-01-20 00:00:00' AND ends_at > TIMESTAMP '2024-01-20 00:00:00'""")

oracle("visible_subscriptions", """
SELECT vendor_id, status FROM s_state
WHERE (status IN ('trial', 'active') AND access_ends_at > TIMESTAMP '2024-01-20 00:00:00') OR vendor_id = 'v14'""")

oracle("visible_payments", "SELECT vendor_id, seq FROM f_pay WHERE vendor_id = 'v14'")

oracle("visibility_counts", """
SELECT w.viewer_id, w.role,
  (SELECT count(*) FROM nv WHERE w.role = 'admin' OR nv.id = coalesce(w.vendor_id, '')
                                 OR nv.id IN (SELECT vendor_id FROM f_live)) AS n_vendors,
  (SELECT count(*) FROM np WHERE w.role = 'admin' OR np.vendor = coalesce(w.vendor_id, '')
                                 OR np.vendor IN (SELECT vendor_id FROM f_live)) AS n_products,
  CASE WHEN w.role = 'anon' THEN 0 ELSE
  (SELECT count(*) FROM o_orders o WHERE w.role = 'admin' OR o.user_id = w.user_id) END AS n_orders,
  CASE WHEN w.role = 'anon' THEN 0 ELSE
  (SELECT count(*) FROM o_vendor_orders v WHERE w.role = 'admin' OR v.user_id = w.user_id
       OR (w.role = 'vendor' AND v.vendor_id = w.vendor_id)) END AS n_vendor_orders,
  (SELECT count(*) FROM mk_promotions p WHERE w.role = 'admin' OR (p.status = 'active' AND p.payment_status = 'paid'
       AND p.starts_at <= TIMESTAMP '2024-01-20 00:00:00' AND p.ends_at > TIMESTAMP '2024-01-20 00:00:00'))
    AS n_promotions,
  (SELECT count(*) FROM s_state s WHERE w.role = 'admin' OR s.vendor_id = coalesce(w.vendor_id, '')
       OR (s.status IN ('trial', 'active') AND s.access_ends_at > TIMESTAMP '2024-01-20 00:00:00'))
    AS n_subscriptions,
  CASE WHEN w.role = 'anon' THEN 0 ELSE
  (SELECT count(*) FROM f_pay p WHERE w.role = 'admin' OR p.vendor_id = coalesce(w.vendor_id, '')) END AS n_payments
FROM mk_viewers w""")

ADAPTERS["mk_proposed"] = """
SELECT event_id AS change_id,
       CASE event_id % 7 WHEN 0 THEN 'vendors' WHEN 1 THEN 'products' WHEN 2 THEN 'orders'
            WHEN 3 THEN 'vendor_orders' WHEN 4 THEN 'promotions' WHEN 5 THEN 'subscriptions'
            ELSE 'payments' END AS tbl,
       CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
       CASE user_id % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'vendor' WHEN 2 THEN 'vendor'
            WHEN 8 THEN NULL WHEN 9 THEN 'anon' ELSE 'authenticated' END AS actor_role,
       CASE WHEN user_id % 10 <> 9 AND event_id % 41 <> 0 THEN 'u' || user_id END AS actor_user_id,
       CASE WHEN user_id % 10 IN (1, 2) THEN 'v' || (user_id % 7) END AS actor_vendor_id,
       'v' || (event_id % 7) AS old_vendor_id,
       'v' || ((event_id + CAST(floor(value) AS BIGINT) % 2) % 7) AS new_vendor_id,
       'u' || (event_id % 150) AS old_user_id,
       CASE WHEN event_id % 3 = 0 THEN 'u' || user_id ELSE 'u' || (event_id % 150) END AS new_user_id,
       CASE WHEN event_id % 4 = 0 THEN 'confirmed' ELSE 'pending' END AS new_status,
       CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS created_by,
       CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS confirmed_by,
       CASE WHEN event_id % 6 = 0 THEN ['v' || (event_id % 7), 'v' || (event_id % 5)]
            ELSE ['v' || ((event_id + CAST(floor(value) AS BIGINT) % 2) % 7)] END AS item_vendors,
       CASE WHEN event_id % 8 = 0 THEN ['status', 'subtotal'] ELSE ['status', 'status_note'] END AS changed_columns
FROM events"""

oracle("check_changes", """
WITH r AS (
  SELECT *, actor_role = 'admin' AS adm, coalesce(actor_vendor_id, '') AS av FROM mk_proposed),
v AS (
  SELECT change_id, tbl, op,
    CASE WHEN actor_user_id IS NULL THEN false
         WHEN tbl = 'vendors' AND op = 'update' THEN adm OR (old_vendor_id = av AND new_vendor_id = av)
         WHEN tbl = 'vendors' THEN adm
         WHEN tbl = 'products' AND op = 'insert' THEN adm OR new_vendor_id = av
         WHEN tbl = 'products' AND op = 'update' THEN (adm OR old_vendor_id = av) AND (adm OR new_vendor_id = av)
         WHEN tbl = 'products' THEN adm OR old_vendor_id = av
         WHEN tbl = 'orders' AND op = 'insert' THEN actor_user_id = new_user_id AND new_status = 'pending'
         WHEN tbl = 'orders' AND op = 'update' THEN adm
         WHEN tbl = 'orders' THEN false
         WHEN tbl = 'vendor_orders' AND op = 'insert' THEN actor_user_id = new_user_id AND new_status = 'pending'
              AND NOT EXISTS (SELECT 1 FROM unnest(item_vendors) t(x) WHERE x IS DISTINCT FROM new_vendor_id)
         WHEN tbl = 'vendor_orders' AND op = 'update' THEN
              (adm OR (actor_role = 'vendor' AND old_vendor_id = av))
              AND (adm OR (actor_role = 'vendor' AND new_vendor_id = av))
              AND NOT EXISTS (SELECT 1 FROM unnest(changed_columns) t(c) WHERE c NOT IN ('status', 'status_note'))
         WHEN tbl = 'vendor_orders' THEN false
         WHEN tbl = 'promotions' AND op = 'insert' THEN adm AND created_by = actor_user_id
         WHEN tbl = 'promotions' THEN adm
         WHEN tbl = 'subscriptions' THEN adm
         WHEN tbl = 'payments' AND op = 'insert' THEN adm AND confirmed_by = actor_user_id
         WHEN tbl = 'payments' THEN adm
         ELSE false END AS ok
  FROM r)
SELECT change_id, tbl, op, coalesce(ok, false) AS accepted,
       CASE WHEN NOT coalesce(ok, false) THEN 'policy_violation' END AS reason
FROM v""")

oracle("canonical_lines_visible", """WITH RECURSIVE
c AS (
  SELECT m.request_id, m.product_id, p.vendor, p.name, p.price, m.qty
  FROM o_merged m JOIN np p ON p.id = m.product_id
  WHERE p.in_stock AND m.qty BETWEEN 1 AND 99 AND p.vendor IN (SELECT vendor_id FROM f_live))
SELECT request_id, product_id, vendor, name, price, CAST(qty AS BIGINT) AS qty FROM c
WHERE (SELECT count(*) FROM c c2 WHERE c2.request_id = c.request_id)
    = (SELECT n FROM o_nreq WHERE o_nreq.request_id = c.request_id)""")
