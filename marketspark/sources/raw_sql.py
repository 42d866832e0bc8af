"""Marketplace tables as an unchecked source delivers them: shaped from the
driver's tables, with missing, repeated, dangling and malformed values in
every column that a constraint guards. One text per table serves Spark and
DuckDB: ``@name`` is a driver table, ``STR)`` the text type of a cast. They
only give rows; the checks themselves are in operators.quality."""

from __future__ import annotations

_ITEMS = """CASE {k} % 9 WHEN 0 THEN '{{"a":1}}' WHEN 1 THEN '[]' WHEN 2 THEN 'broken [' WHEN 3 THEN NULL
            WHEN 4 THEN '[1] x' ELSE '[{{"id":"p' || {k} || '","qty":1}}]' END"""

RAW: dict[str, str] = {}

RAW["vendors"] = """
SELECT CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'v' || s_suppkey END AS id,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE s_name END AS name FROM @supplier
UNION ALL
SELECT 'v' || s_suppkey, s_name FROM @supplier WHERE s_suppkey % 5 = 0"""

RAW["products"] = """
SELECT CASE WHEN p_partkey % 41 = 7 THEN NULL ELSE 'p' || (p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END) END AS id,
       CASE WHEN p_partkey % 37 = 5 THEN NULL ELSE 'v' || (p_partkey % 23) END AS vendor,
       CASE WHEN p_partkey % 29 = 3 THEN NULL ELSE p_name END AS name,
       CASE WHEN p_partkey % 17 = 2 THEN NULL WHEN p_partkey % 19 = 4 THEN -1.5 ELSE p_retailprice END AS price
FROM @part"""

RAW["orders"] = f"""
SELECT CASE WHEN o_orderkey % 83 = 1 THEN NULL ELSE 'o' || (o_orderkey - o_orderkey % 3) END AS id,
       CASE WHEN o_orderkey % 89 = 2 THEN NULL WHEN o_orderkey % 97 = 3 THEN 'nobody' ELSE 'u' || o_custkey END AS user_id,
       CASE WHEN o_orderkey % 71 = 4 THEN NULL ELSE 'Customer ' || o_custkey END AS customer_name,
       CASE WHEN o_orderkey % 73 = 5 THEN NULL ELSE '0801' || o_custkey END AS customer_phone,
       CASE WHEN o_orderkey % 79 = 6 THEN NULL ELSE 'Street ' || o_custkey END AS customer_address,
       {_ITEMS.format(k="o_orderkey")} AS items,
       CASE WHEN o_orderkey % 61 = 7 THEN NULL WHEN o_orderkey % 67 = 8 THEN -o_totalprice ELSE o_totalprice END AS total,
       CASE o_orderkey % 13 WHEN 0 THEN 'lost' WHEN 1 THEN NULL ELSE 'pending' END AS status
FROM @orders"""

RAW["vendor_orders"] = f"""
SELECT CASE WHEN l_orderkey % 53 = 1 THEN NULL ELSE 'o' || l_orderkey || '/' || l_linenumber % 5 END AS id,
       CASE WHEN l_orderkey % 59 = 2 THEN NULL ELSE 'o' || (l_orderkey - l_orderkey % 2) END AS order_id,
       CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE 'v' || (l_suppkey % 31) END AS vendor_id,
       CASE WHEN l_orderkey % 43 = 3 THEN NULL ELSE 'u' || (l_orderkey % 400) END AS user_id,
       {_ITEMS.format(k="l_partkey")} AS items,
       CASE WHEN l_partkey % 47 = 4 THEN NULL WHEN l_partkey % 49 = 5 THEN -l_extendedprice ELSE l_extendedprice END AS subtotal,
       CASE l_partkey % 11 WHEN 0 THEN 'gone' WHEN 1 THEN NULL ELSE 'paid' END AS status,
       CASE WHEN l_suppkey % 13 = 0 THEN repeat('n', 501) WHEN l_suppkey % 13 = 1 THEN NULL ELSE repeat('n', 500) END AS status_note
FROM @lineitem"""

RAW["promotions"] = """
SELECT CASE WHEN p_partkey % 43 = 1 THEN NULL ELSE 'm' || (p_partkey - p_partkey % 2) END AS id,
       CASE p_partkey % 7 WHEN 0 THEN 'flyer' WHEN 1 THEN NULL WHEN 2 THEN 'boutique' WHEN 3 THEN 'banner' ELSE 'product' END AS promotion_type,
       CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'v' || (p_partkey % 27) END AS vendor_id,
       CASE WHEN p_partkey % 7 IN (2, 3) AND p_partkey % 3 > 0 THEN NULL WHEN p_partkey % 11 = 5 THEN NULL ELSE 'p' || (p_partkey + 7) END AS product_id,
       CASE p_partkey % 3 WHEN 0 THEN repeat('t', 101) WHEN 1 THEN NULL ELSE repeat('t', 100) END AS title,
       CASE p_partkey % 4 WHEN 0 THEN repeat('s', 241) WHEN 1 THEN NULL ELSE repeat('s', 240) END AS subtitle,
       CASE WHEN p_partkey % 13 = 12 THEN NULL ELSE p_partkey % 5 END AS placement_level,
       CASE WHEN p_partkey % 17 = 3 THEN NULL WHEN p_partkey % 17 = 4 THEN -1 ELSE 1000 END AS amount_paid,
       CASE p_partkey % 6 WHEN 0 THEN 'void' WHEN 1 THEN NULL WHEN 2 THEN 'refunded' ELSE 'paid' END AS payment_status,
       CASE p_partkey % 8 WHEN 0 THEN 'ended' WHEN 1 THEN NULL WHEN 2 THEN 'draft' ELSE 'active' END AS status,
       CASE WHEN p_partkey % 19 = 1 THEN NULL ELSE TIMESTAMP '2024-01-10 00:00:00' END AS starts_at,
       CASE p_partkey % 23 WHEN 1 THEN NULL WHEN 2 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN 3 THEN TIMESTAMP '2024-01-01 00:00:00'
            ELSE TIMESTAMP '2024-01-20 00:00:00' END AS ends_at,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'u' || (p_partkey % 300) END AS created_by
FROM @part"""

RAW["subscriptions"] = """
SELECT CASE WHEN c_custkey % 31 = 1 THEN NULL ELSE 'v' || (c_custkey % 40) END AS vendor_id,
       CASE c_custkey % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN NULL WHEN 2 THEN 'trial' ELSE 'annual' END AS plan,
       CASE c_custkey % 7 WHEN 0 THEN 'ended' WHEN 1 THEN NULL WHEN 2 THEN 'cancelled' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 29 = 2 THEN NULL ELSE TIMESTAMP '2024-01-05 00:00:00' END AS access_started_at,
       CASE WHEN c_custkey % 11 = 1 THEN NULL ELSE TIMESTAMP '2024-01-10 00:00:00' END AS current_period_start,
       CASE c_custkey % 13 WHEN 1 THEN NULL WHEN 2 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-02-10 00:00:00' END AS access_ends_at
FROM @customer"""

RAW["payments"] = """
SELECT CASE WHEN event_id % 67 = 1 THEN NULL ELSE 'y' || (event_id - event_id % 4 % 2) END AS id,
       CASE WHEN event_id % 71 = 2 THEN NULL ELSE 'v' || (user_id % 33) END AS vendor_id,
       CASE event_id % 5 WHEN 0 THEN 'trial' WHEN 1 THEN NULL WHEN 2 THEN 'launch' ELSE 'monthly' END AS plan,
       CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN NULL ELSE 5000 END AS amount,
       CASE WHEN event_id % 17 = 3 THEN NULL ELSE TIMESTAMP '2024-01-10 00:00:00' END AS period_start,
       CASE event_id % 19 WHEN 4 THEN NULL WHEN 5 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-02-10 00:00:00' END AS period_end,
       CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'refunded' ELSE 'paid' END AS payment_status,
       CASE event_id % 13 WHEN 0 THEN repeat('n', 501) WHEN 1 THEN NULL ELSE 'ok' END AS notes,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'u' || (user_id * 3) END AS confirmed_by
FROM @events"""

RAW["staff"] = """
SELECT CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE 'owner' || (s_suppkey - s_suppkey % 2) || '@shop.example' END AS email,
       CASE WHEN s_suppkey % 7 = 6 THEN NULL ELSE 'vendor' END AS role,
       'v' || (s_suppkey * 2 % 17) AS vendor_id,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'su' || (s_suppkey - s_suppkey % 4) END AS user_id FROM @supplier
UNION ALL
SELECT 'c' || c_custkey || '@example.org', 'admin', NULL, 'u' || (c_custkey % 90) FROM @customer"""

RAW["users"] = """
SELECT 'u' || c_custkey AS id FROM @customer
UNION ALL
SELECT 'su' || s_suppkey FROM @supplier"""

RAW["reviews"] = """
SELECT 'rv' || l_orderkey || '-' || (l_linenumber % 6) AS id, 'p' || (l_partkey * 2) AS product
FROM @lineitem"""

#: columns that must not be null, per table
NOT_NULL: dict[str, list[str]] = {
    "vendors": ["id", "name"],
    "products": ["id", "vendor", "name", "price"],
    "orders": ["id", "user_id", "customer_name", "customer_phone", "customer_address", "items", "total", "status"],
    "vendor_orders": ["id", "order_id", "vendor_id", "user_id", "items", "subtotal", "status"],
    "promotions": ["id", "promotion_type", "placement_level", "amount_paid", "payment_status", "status", "starts_at", "ends_at"],
    "subscriptions": ["vendor_id", "plan", "status", "access_started_at", "current_period_start", "access_ends_at"],
    "payments": ["id", "vendor_id", "plan", "amount", "period_start", "period_end", "payment_status"],
    "staff": ["email", "role"],
}

#: unique keys: (table, columns, condition)
UNIQUE: list[tuple[str, list[str], str | None]] = [
    ("vendors", ["id"], None), ("products", ["id"], None), ("orders", ["id"], None), ("vendor_orders", ["id"], None),
    ("vendor_orders", ["order_id", "vendor_id"], None), ("promotions", ["id"], None), ("subscriptions", ["vendor_id"], None),
    ("payments", ["id"], None), ("staff", ["email"], None), ("staff", ["user_id"], None),
    ("staff", ["vendor_id"], "role = 'vendor'"), ("reviews", ["id"], None),
]

#: references: child table -> (column, parent table, parent column)
REFERENCES: dict[str, list[tuple[str, str, str]]] = {
    "products": [("vendor", "vendors", "id")],
    "orders": [("user_id", "users", "id")],
    "vendor_orders": [("order_id", "orders", "id"), ("vendor_id", "vendors", "id"), ("user_id", "users", "id")],
    "promotions": [("vendor_id", "vendors", "id"), ("product_id", "products", "id"), ("created_by", "users", "id")],
    "subscriptions": [("vendor_id", "vendors", "id")],
    "payments": [("vendor_id", "vendors", "id"), ("confirmed_by", "users", "id")],
    "staff": [("user_id", "users", "id"), ("vendor_id", "vendors", "id")],
    "reviews": [("product", "products", "id")],
}
