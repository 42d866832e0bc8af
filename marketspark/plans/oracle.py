"""DuckDB oracle SQL, written independently of the Spark operators.

``ADAPTERS`` are the DuckDB twins of ``sources.testdata``; every oracle
query is ``WITH <adapters>, <query CTEs> SELECT ...`` over the driver's
pre-registered views. Unused CTEs are never evaluated by DuckDB.
"""

from __future__ import annotations

ADAPTERS: dict[str, str] = {}

ADAPTERS["mk_vendors"] = """
SELECT 'v' || s_suppkey AS id, s_name AS name, s_suppkey AS pos,
       'Goods from nation ' || s_nationkey AS tagline,
       CAST(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 3 + s_suppkey % 3 END AS DECIMAL(3,1)) AS rating,
       CAST(CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 50 END AS INTEGER) AS review_count,
       CASE WHEN s_suppkey % 2 = 0 THEN CAST(NULL AS VARCHAR[]) ELSE ['N' || s_nationkey, 'Home'] END AS categories,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN ''
            ELSE 'shop-' || s_suppkey || '.html' END AS page,
                   CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'About ' || s_name END AS description,
                   'logo' || s_suppkey || '.png' AS logo, '#' || (100000 + s_suppkey) AS primary_color,
                   CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE '#' || (200000 + s_suppkey) END AS secondary_color,
                   'grad' || (s_suppkey % 3) AS gradient, 'card' || (s_suppkey % 4) AS card_gradient,
                   '#' || (300000 + s_suppkey) AS accent_color,
                   CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE 'banner' || s_suppkey || '.jpg' END AS banner_image,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '+234 80-' || (10000000 + s_suppkey) END AS whatsapp
FROM supplier"""

# normalised vendors (A1 rules, written out again in SQL)
ADAPTERS["nv"] = """
SELECT id, name, pos, tagline,
       CAST(coalesce(nullif(rating, 0), 5) AS DECIMAL(3,1)) AS rating,
       CAST(coalesce(review_count, 0) AS INTEGER) AS review_count,
       coalesce(categories, CAST([] AS VARCHAR[])) AS categories,
       coalesce(nullif(page, ''), 'store.html?vendor=' || id) AS page,
       whatsapp, description, logo, primary_color, secondary_color, gradient, card_gradient, accent_color, banner_image
FROM mk_vendors"""

ADAPTERS["mk_products"] = """
SELECT 'p' || p_partkey AS id, 'v' || (p_partkey % (SELECT count(*) FROM supplier)) AS vendor,
       p_name AS name, p_brand AS description, p_type AS category, p_partkey AS pos,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) + CAST(250 AS DECIMAL(18,2)) END
         AS original_price,
       p_partkey % 11 <> 0 AS in_stock,
       CASE p_partkey % 7 WHEN 0 THEN 'Top Rated' WHEN 1 THEN 'New' WHEN 2 THEN '' END AS badge,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || 'ml' END AS size,
       CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS VARCHAR[]) ELSE ['S' || p_size, 'L' || p_size] END AS sizes,
                   CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_type END AS material, p_brand AS origin,
                   CASE WHEN p_partkey % 6 = 2 THEN NULL ELSE '{"top":"t' || p_partkey || '"}' END AS notes,
                   CAST(CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3 + (p_partkey % 21) / 10.0 END AS DECIMAL(3,1)) AS rating,
       'img/' || p_partkey || '.jpg' AS image,
       CAST((p_partkey * 7919) % 1000 AS INTEGER) AS review_count
FROM part"""

ADAPTERS["np"] = """
SELECT id, vendor, name, description, category, pos, price, original_price, in_stock, badge, size,
       coalesce(sizes, CAST([] AS VARCHAR[])) AS sizes, image, review_count, material, origin, notes,
       CAST(coalesce(nullif(rating, 0), 5) AS DECIMAL(3,1)) AS rating
FROM mk_products"""

ADAPTERS["mk_legacy"] = "SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 47"

ADAPTERS["mk_reviews"] = """
SELECT 'rv' || l_orderkey || '-' || l_linenumber AS id, 'u' || l_suppkey AS "user",
       CAST(1 + l_quantity % 5 AS INTEGER) AS rating, CAST(l_shipdate AS DATE) AS date,
       'p' || l_partkey AS product, 'line ' || l_linenumber AS comment
FROM lineitem"""

ADAPTERS["mk_order_lines"] = """
SELECT 'r' || l_orderkey AS request_id, 'p' || l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS qty
FROM lineitem"""

ADAPTERS["mk_requests"] = """
SELECT 'r' || o_orderkey AS request_id,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'u' || o_custkey END AS user_id,
       TIMESTAMP '2023-12-08 00:00:00' + to_seconds(2160 * date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)) AS requested_at,
       CASE WHEN o_custkey % 50 = 0 THEN 'admin' WHEN o_custkey % 7 = 3 THEN 'vendor' ELSE 'authenticated' END AS caller_role,
       CASE WHEN o_custkey % 7 = 3 THEN 'v' || (o_custkey % 10) END AS caller_vendor_id,
       CASE WHEN o_orderkey % 97 = 0 THEN repeat('x', 151) ELSE '  ' || c_name || ' ' END AS customer_name,
       CASE WHEN o_orderkey % 11 = 0 THEN '   ' ELSE '0801' || (1000000 + o_custkey) END AS customer_phone,
       CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'c' || o_custkey || '@example.org' END AS customer_email,
       'Street ' || o_custkey AS customer_address,
       CASE o_orderkey % 211
            WHEN 1 THEN '{"id":"p1","qty":1}'
            WHEN 2 THEN '[]'
            WHEN 3 THEN '[{"id":"p2","qty":"03"}]'
            WHEN 4 THEN '[{"id":"p3","qty":0}]'
            WHEN 5 THEN '[{"id":"p4","qty":100}]'
            WHEN 6 THEN '[5]'
            WHEN 7 THEN '[{"id":"","qty":1}]'
            WHEN 8 THEN '[{"qty":2}]'
            WHEN 10 THEN '[{"id":"p6","qty":"5' || chr(92) || 'n"}]'
            WHEN 11 THEN '[{"id":"p7","qty":1}] x'
            WHEN 9 THEN '[{"id":"p5","qty":"7"},{"id":"p5","qty":60},{"id":"p5","qty":60}]'
            ELSE coalesce((SELECT '[' || string_agg('{"id":"p' || l_partkey || '","qty":'
                                                    || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '}', ',') || ']'
                           FROM lineitem WHERE l_orderkey = o_orderkey), '[]') END AS items
FROM orders JOIN customer ON o_custkey = c_custkey"""

# D1 + D2: first failing rule
# text that is not JSON as a whole counts as no item list
ADAPTERS["o_requests"] = """
SELECT * REPLACE (CASE WHEN json_valid(items) THEN items END AS items) FROM mk_requests"""

ADAPTERS["o_screen"] = """
SELECT r.*,
  CASE WHEN user_id IS NULL THEN 'sign_in_required'
       WHEN nullif(trim(coalesce(customer_name, '')), '') IS NULL
         OR nullif(trim(coalesce(customer_phone, '')), '') IS NULL
         OR nullif(trim(coalesce(customer_address, '')), '') IS NULL THEN 'missing_customer_details'
       WHEN length(customer_name) > 150 OR length(coalesce(customer_email, '')) > 320
         OR length(customer_phone) > 30 OR length(customer_address) > 1000 THEN 'customer_details_too_long'
       WHEN items IS NULL OR json_type(items) <> 'ARRAY' OR json_array_length(items) = 0
         OR json_array_length(items) > 50 THEN 'bad_item_count'
       WHEN EXISTS (SELECT 1 FROM unnest(json_extract(items, '$[*]')) AS t(e)
                    WHERE json_type(e) <> 'OBJECT' OR nullif(json_extract_string(e, '$.id'), '') IS NULL
                       OR NOT regexp_matches(coalesce(json_extract_string(e, '$.qty'), ''), '^[1-9][0-9]?$'))
         THEN 'invalid_product_or_quantity'
  END AS reason
FROM o_requests r"""

ADAPTERS["o_items_reason"] = """
SELECT request_id,
  CASE WHEN items IS NULL OR json_type(items) <> 'ARRAY' OR json_array_length(items) = 0
         OR json_array_length(items) > 50 THEN 'bad_item_count'
       WHEN EXISTS (SELECT 1 FROM unnest(json_extract(items, '$[*]')) AS t(e)
                    WHERE json_type(e) <> 'OBJECT' OR nullif(json_extract_string(e, '$.id'), '') IS NULL
                       OR NOT regexp_matches(coalesce(json_extract_string(e, '$.qty'), ''), '^[1-9][0-9]?$'))
         THEN 'invalid_product_or_quantity'
  END AS reason, items
FROM o_requests"""

ADAPTERS["o_merged"] = """
SELECT request_id, json_extract_string(e, '$.id') AS product_id,
       sum(CAST(json_extract_string(e, '$.qty') AS INTEGER)) AS qty
FROM o_screen, unnest(json_extract(items, '$[*]')) AS t(e)
WHERE reason IS NULL
GROUP BY 1, 2"""

ADAPTERS["o_nreq"] = "SELECT request_id, count(*) AS n FROM o_merged GROUP BY 1"

ADAPTERS["o_canon"] = """
SELECT m.request_id, m.product_id, p.vendor, p.name, p.price, p.image, p.size, m.qty
FROM o_merged m JOIN mk_requests r USING (request_id) JOIN np p ON p.id = m.product_id
     ASOF LEFT JOIN s_asof a ON a.vendor_id = p.vendor AND r.requested_at >= a.ts
WHERE p.in_stock AND m.qty BETWEEN 1 AND 99
  AND (r.caller_role = 'admin' OR coalesce(p.vendor = r.caller_vendor_id, false)
       OR coalesce(a.status IN ('trial', 'active') AND a.access_ends_at > r.requested_at, false))"""

ADAPTERS["o_lines"] = """
SELECT c.* FROM o_canon c
WHERE (SELECT count(*) FROM o_canon c2 WHERE c2.request_id = c.request_id)
    = (SELECT n FROM o_nreq WHERE o_nreq.request_id = c.request_id)"""

ADAPTERS["o_hdr"] = """
SELECT request_id, user_id, requested_at, trim(customer_name) AS customer_name,
       nullif(trim(coalesce(customer_email, '')), '') AS customer_email,
       trim(customer_phone) AS customer_phone, trim(customer_address) AS customer_address,
       'ORD-' || strftime(requested_at, '%y%m%d') || '-' || upper(substr(sha256(request_id), 1, 32)) AS order_id
FROM o_screen WHERE reason IS NULL"""

ADAPTERS["o_orders"] = """
SELECT h.order_id AS id, h.request_id, h.user_id, h.customer_name, h.customer_email, h.customer_phone,
       h.customer_address,
       to_json(list({'id': product_id, 'vendor': vendor, 'name': name, 'price': price, 'image': image,
                     'size': size, 'qty': qty} ORDER BY vendor, name, product_id)) AS items,
       CAST(sum(price * qty) AS DECIMAL(38,2)) AS total, count(*) AS n_items,
       'pending' AS status, h.requested_at AS created_at
FROM o_lines l JOIN o_hdr h USING (request_id)
GROUP BY ALL"""

ADAPTERS["o_vendor_orders"] = """
SELECT h.order_id || '/' || l.vendor AS id, h.order_id, l.vendor AS vendor_id, h.request_id, h.user_id,
       h.customer_name, h.customer_email, h.customer_phone, h.customer_address,
       to_json(list({'id': product_id, 'vendor': vendor, 'name': name, 'price': price, 'image': image,
                     'size': size, 'qty': qty} ORDER BY name, product_id)) AS items,
       CAST(sum(price * qty) AS DECIMAL(38,2)) AS subtotal, count(*) AS n_items,
       'pending' AS status, CAST(NULL AS VARCHAR) AS status_note,
       h.requested_at AS created_at, h.requested_at AS updated_at
FROM o_lines l JOIN o_hdr h USING (request_id)
GROUP BY h.order_id, l.vendor, h.request_id, h.user_id, h.customer_name, h.customer_email, h.customer_phone,
         h.customer_address, h.requested_at"""


# Decimal result columns per query: cast to DOUBLE at the result boundary,
# as the Spark side does (money_out in __spark_entry__). tests/test_oracle.py
# checks that no DECIMAL column is left.
DECIMAL_OUT: dict[str, list[str]] = {
    "build_orders": ["total"], "canonical_lines": ["price"], "canonical_lines_visible": ["price"],
    "cart_by_vendor": ["total"], "cart_savings": ["savings"], "cart_state": ["price"],
    "cart_totals": ["total"], "filter_max_price": ["price"], "intake_report": ["value"],
    "launch_cap": ["amount"], "load_products": ["price", "original_price", "rating"], "load_vendors": ["rating"],
    "merge_products": ["price", "original_price"], "merge_vendors": ["rating"], "my_orders": ["lines_total"], "mart_my_orders": ["lines_total"],
    "order_totals": ["total"], "payment_history": ["amount"], "plan_pricing": ["revenue"],
    "product_detail": ["vendor_rating", "price", "original_price", "savings"],
    "reconcile_orders": ["total", "sum_subtotals"], "renewal_periods": ["amount"],
    "split_by_vendor": ["subtotal"], "write_marts": ["amount"], "stream_cart_state": ["price"], "stream_order_intake": ["subtotal"],
}


# Date result columns per query: ISO text at the result boundary.
DATE_OUT: dict[str, list[str]] = {"reviews_for": ["date"]}


def split_with(body: str) -> tuple[list[str], str]:
    """'WITH [RECURSIVE] a AS (...), b AS (...) SELECT ...' ->
    (['a AS (...)', 'b AS (...)'], 'SELECT ...'). Tracks parentheses and
    single-quoted strings only (enough for the SQL in this package)."""
    s = body.strip()
    up = s.upper()
    if up.startswith("WITH RECURSIVE"):
        s = s[len("WITH RECURSIVE"):]
    elif up.startswith("WITH "):
        s = s[4:]
    else:
        return [], s
    ctes, i, n = [], 0, len(s)
    while True:
        while i < n and s[i].isspace():
            i += 1
        if s[i:i + 6].upper() == "SELECT":      # "WITH RECURSIVE" with no own CTEs
            return ctes, s[i:].strip()
        k = s.index("(", i)
        depth, in_str = 0, False
        while k < n:
            c = s[k]
            if in_str:
                if c == "'":
                    if k + 1 < n and s[k + 1] == "'":
                        k += 1
                    else:
                        in_str = False
            elif c == "'":
                in_str = True
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        ctes.append(s[i:k + 1].strip())
        i = k + 1
        while i < n and s[i].isspace():
            i += 1
        if i < n and s[i] == ",":
            i += 1
            continue
        return ctes, s[i:].strip()


def with_adapters(body: str, key: str | None = None) -> str:
    """One WITH RECURSIVE list: adapters, the query's own CTEs, then the
    final SELECT (wrapped to cast decimal result columns to DOUBLE)."""
    own, final = split_with(body)
    # the ledger's tables stand before the orders, which look up who was live
    first = lambda k: 0 if k.startswith(("mk_", "n")) else 1 if k.startswith("s_") else 2
    ctes = [f"{k} AS ({ADAPTERS[k]})" for k in sorted(ADAPTERS, key=first)] + own
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in DECIMAL_OUT.get(key or "", [])]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in DATE_OUT.get(key or "", [])]
    if casts:
        ctes.append(f"__out AS ({final})")
        final = "SELECT * REPLACE (" + ", ".join(casts) + ") FROM __out"
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


ORACLE: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    ORACLE[name] = body


def all_oracles() -> dict[str, str]:
    import importlib
    for m in ("o_orders", "o_catalog", "o_subscriptions", "o_visibility", "o_promotions",
              "o_cart", "o_tracking", "o_registry", "o_quality", "o_expr", "o_streams"):
        importlib.import_module(f"{__package__}.{m}")
    return {k: with_adapters(v, k) for k, v in ORACLE.items()}
