"""Adapters: shape the driver's TPC-H-style tables into marketplace inputs.

They only give rows in the schema the operators expect; no operator work
happens here. Every adapter is a plain projection or union of one or two
source tables, so Catalyst prunes columns and pushes filters into the
parquet scans of the operators that use them.

The DuckDB twins of these adapters live in ``marketspark.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .raw_sql import RAW

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


class TestTables:
    __test__ = False  # not a pytest class

    """Lazy loader for one scale-factor folder, plus the mk_* adapters."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One driver table, as its files give it."""
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[name]

    def _sql(self, text: str, **tables: str) -> DataFrame:
        return self.spark.sql(text, **{k: self.raw(v) for k, v in tables.items()})

    # ---- raw tables for the quality checks ---------------------------------
    def raw_table(self, name: str) -> DataFrame:
        """A marketplace table as an unchecked source delivers it."""
        text = RAW[name].replace("{", "{{").replace("}", "}}").replace("STR)", "STRING)")
        used = [s for s in SOURCE_TABLES if f"@{s}" in text]
        for s in used:
            text = text.replace(f"@{s}", "{" + s + "}")
        return self._sql(text, **{s: s for s in used})

    # ---- catalogue -------------------------------------------------------
    def vendors(self) -> DataFrame:
        return self._sql("""
            SELECT 'v' || s_suppkey AS id, s_name AS name, s_suppkey AS pos,
                   'Goods from nation ' || s_nationkey AS tagline,
                   CAST(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 3 + s_suppkey % 3 END AS DECIMAL(3,1)) AS rating,
                   CAST(CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 50 END AS INT) AS review_count,
                   CASE WHEN s_suppkey % 2 = 0 THEN CAST(NULL AS ARRAY<STRING>)
                        ELSE array('N' || s_nationkey, 'Home') END AS categories,
                   CASE WHEN s_suppkey % 5 = 0 THEN NULL
                        WHEN s_suppkey % 5 = 1 THEN ''
                        ELSE 'shop-' || s_suppkey || '.html' END AS page,
                   CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'About ' || s_name END AS description,
                   'logo' || s_suppkey || '.png' AS logo, '#' || (100000 + s_suppkey) AS primary_color,
                   CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE '#' || (200000 + s_suppkey) END AS secondary_color,
                   'grad' || (s_suppkey % 3) AS gradient, 'card' || (s_suppkey % 4) AS card_gradient,
                   '#' || (300000 + s_suppkey) AS accent_color,
                   CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE 'banner' || s_suppkey || '.jpg' END AS banner_image,
                   CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '+234 80-' || (10000000 + s_suppkey) END AS whatsapp
            FROM {s}""", s="supplier")

    def products(self) -> DataFrame:
        return self._sql("""
            SELECT 'p' || p_partkey AS id,
                   'v' || (p_partkey % (SELECT count(*) FROM {s})) AS vendor,
                   p_name AS name, p_brand AS description, p_type AS category, p_partkey AS pos,
                   CAST(p_retailprice AS DECIMAL(18,2)) AS price,
                   CASE WHEN p_partkey % 3 = 0
                        THEN CAST(p_retailprice AS DECIMAL(18,2)) + CAST(250 AS DECIMAL(18,2)) END AS original_price,
                   p_partkey % 11 <> 0 AS in_stock,
                   CASE p_partkey % 7 WHEN 0 THEN 'Top Rated' WHEN 1 THEN 'New' WHEN 2 THEN '' END AS badge,
                   CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) || 'ml' END AS size,
                   CASE WHEN p_size % 3 = 0 THEN CAST(NULL AS ARRAY<STRING>)
                        ELSE array('S' || p_size, 'L' || p_size) END AS sizes,
                   CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_type END AS material, p_brand AS origin,
                   CASE WHEN p_partkey % 6 = 2 THEN NULL ELSE '{{"top":"t' || p_partkey || '"}}' END AS notes,
                   CAST(CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3 + (p_partkey % 21) / 10.0 END AS DECIMAL(3,1)) AS rating,
                   'img/' || p_partkey || '.jpg' AS image,
                   CAST((p_partkey * 7919) % 1000 AS INT) AS review_count
            FROM {p}""", p="part", s="supplier")

    def legacy_ids(self) -> DataFrame:
        """Retired product ids, as a table (the reference keeps a fixed list)."""
        return self._sql("SELECT 'p' || p_partkey AS id FROM {p} WHERE p_size > 47", p="part")

    def reviews(self) -> DataFrame:
        return self._sql("""
            SELECT 'rv' || l_orderkey || '-' || l_linenumber AS id, 'u' || l_suppkey AS user,
                   CAST(1 + l_quantity % 5 AS INT) AS rating, CAST(l_shipdate AS DATE) AS date,
                   'p' || l_partkey AS product, 'line ' || l_linenumber AS comment
            FROM {l}""", l="lineitem")

    # ---- order intake ----------------------------------------------------
    def order_lines(self) -> DataFrame:
        return self._sql("""
            SELECT 'r' || l_orderkey AS request_id, 'p' || l_partkey AS product_id,
                   CAST(l_quantity AS INT) AS qty
            FROM {l}""", l="lineitem")

    def order_requests(self) -> DataFrame:
        """Headers with some blank or over-long fields, and the items as JSON
        text built from the order's lines. A few requests carry bad shapes
        (object, empty array, string qty '03', qty 0, qty 100, number element,
        empty id) so the validators see them on real volume."""
        return self._sql("""
            WITH lines AS (
              SELECT l_orderkey AS k,
                     '[' || array_join(collect_list(
                        '{{"id":"p' || l_partkey || '","qty":' || CAST(CAST(l_quantity AS INT) AS STRING) || '}}'), ',')
                     || ']' AS good_items
              FROM {l} GROUP BY l_orderkey)
            SELECT 'r' || o_orderkey AS request_id,
                   CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'u' || o_custkey END AS user_id,
                   TIMESTAMP_NTZ '2023-12-08 00:00:00'
                     + make_dt_interval(0, 0, 0, 2160 * timestampdiff(DAY, TIMESTAMP_NTZ '1995-01-01 00:00:00', o_orderdate)) AS requested_at,
                   CASE WHEN o_custkey % 50 = 0 THEN 'admin' WHEN o_custkey % 7 = 3 THEN 'vendor' ELSE 'authenticated' END AS caller_role,
                   CASE WHEN o_custkey % 7 = 3 THEN 'v' || (o_custkey % 10) END AS caller_vendor_id,
                   CASE WHEN o_orderkey % 97 = 0 THEN repeat('x', 151) ELSE '  ' || c_name || ' ' END AS customer_name,
                   CASE WHEN o_orderkey % 11 = 0 THEN '   ' ELSE '0801' || (1000000 + o_custkey) END AS customer_phone,
                   CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'c' || o_custkey || '@example.org' END AS customer_email,
                   'Street ' || o_custkey AS customer_address,
                   CASE o_orderkey % 211
                        WHEN 1 THEN '{{"id":"p1","qty":1}}'
                        WHEN 2 THEN '[]'
                        WHEN 3 THEN '[{{"id":"p2","qty":"03"}}]'
                        WHEN 4 THEN '[{{"id":"p3","qty":0}}]'
                        WHEN 5 THEN '[{{"id":"p4","qty":100}}]'
                        WHEN 6 THEN '[5]'
                        WHEN 7 THEN '[{{"id":"","qty":1}}]'
                        WHEN 8 THEN '[{{"qty":2}}]'
                        WHEN 10 THEN '[{{"id":"p6","qty":"5' || char(92) || 'n"}}]'
                        WHEN 11 THEN '[{{"id":"p7","qty":1}}] x'
                        WHEN 9 THEN '[{{"id":"p5","qty":"7"}},{{"id":"p5","qty":60}},{{"id":"p5","qty":60}}]'
                        ELSE coalesce(good_items, '[]') END AS items
            FROM {o} JOIN {c} ON o_custkey = c_custkey
                     LEFT JOIN lines ON o_orderkey = lines.k""",
            o="orders", c="customer", l="lineitem")

    # ---- carts, wishlists ------------------------------------------------
    def cart_events(self) -> DataFrame:
        return self._sql("""
            SELECT 'u' || user_id AS user_id, event_id AS seq, ts,
                   CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'view' THEN 'set'
                        WHEN 'error' THEN 'remove'
                        ELSE CASE WHEN event_id % 4 = 0 THEN 'clear' ELSE 'add' END END AS kind,
                   'p' || (event_id % 5 + 5 * (user_id % 7)) AS product_id,
                   CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INT) % 6 - 1
                        ELSE 1 + CAST(floor(value) AS INT) % 4 END AS qty,
                   named_struct(
                     'name', 'Item ' || (event_id % 5),
                     'price', CAST(100 + CAST(floor(value) AS INT) % 50 AS DECIMAL(18,2)),
                     'original_price', CASE WHEN event_id % 3 = 0 THEN CAST(160 AS DECIMAL(18,2))
                                            WHEN event_id % 3 = 1 THEN CAST(0 AS DECIMAL(18,2)) END,
                     'vendor', CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || (event_id % 4) END
                   ) AS snap
            FROM {e}""", e="events")

    def picker_events(self) -> DataFrame:
        """Quantity picker input before clamping (C7): raw values -3..12."""
        return self._sql("""
            SELECT 'u' || user_id AS user_id, event_id AS seq, 'p' || (event_id % 5 + 5 * (user_id % 7)) AS product_id,
                   CAST(floor(value) AS INT) % 16 - 3 AS picked
            FROM {e}""", e="events")

    def wishlist_events(self) -> DataFrame:
        return self._sql("""
            SELECT 'u' || user_id AS user_id, event_id AS seq, ts, 'p' || (event_id % 7 + 7 * (user_id % 5)) AS product_id
            FROM {e}""", e="events")

    def promo_code_uses(self) -> DataFrame:
        return self._sql("""
            SELECT 'u' || user_id AS user_id, event_id AS seq,
                   CASE event_id % 5 WHEN 0 THEN ' save10 ' WHEN 1 THEN 'SAVE10' WHEN 2 THEN 'SAVE20'
                                     WHEN 3 THEN 'Save 10' END AS code
            FROM {e}""", e="events")

    # ---- subscriptions, promotions ---------------------------------------
    def subscription_events(self) -> DataFrame:
        """The ledger's event log; one event in 29 was delivered twice."""
        return self._sql("""
            SELECT 'v' || s_suppkey AS vendor_id, CAST(-1 AS BIGINT) AS seq,
                   TIMESTAMP_NTZ '2023-12-15 00:00:00' AS ts, 'trial' AS kind,
                   CAST(NULL AS STRING) AS plan, 30 AS days, CAST(NULL AS STRING) AS notes
            FROM {s}
            UNION ALL
            SELECT 'v' || (user_id % (SELECT count(*) FROM {s})), event_id, ts,
                   CASE event_type WHEN 'purchase' THEN 'pay' WHEN 'click' THEN 'grant'
                        WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'suspend' WHEN 1 THEN 'cancel' ELSE 'refund' END
                        WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'resume' ELSE 'grant' END ELSE 'pay' END,
                   CASE WHEN event_type = 'signup' THEN 'launch'
                        WHEN event_type = 'error' THEN CASE event_id % 12 WHEN 2 THEN 'monthly' WHEN 3 THEN NULL ELSE 'launch' END
                        WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'launch'
                             WHEN 1 THEN 'monthly' WHEN 2 THEN 'annual' ELSE 'bogus' END END,
                   CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value) AS INT) % 40 END,
                   CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'ref ' || event_id END
            FROM {e} LATERAL VIEW explode(sequence(1, CASE WHEN event_id % 29 = 0 THEN 2 ELSE 1 END)) d AS delivery""",
            s="supplier", e="events")

    def promotions(self) -> DataFrame:
        return self._sql("""
            SELECT 'm' || p_partkey AS id, 'product' AS promotion_type,
                   'v' || (p_partkey % (SELECT count(*) FROM {s})) AS vendor_id, 'p' || p_partkey AS product_id,
                   CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS subtitle,
                   CAST(NULL AS STRING) AS image_url, CAST(NULL AS STRING) AS link_url,
                   CAST(1 + p_partkey % 3 AS SMALLINT) AS placement_level,
                   CAST(1000 * (1 + p_partkey % 3) AS DECIMAL(12,2)) AS amount_paid,
                   CASE WHEN p_partkey % 4 = 3 THEN 'pending' ELSE 'paid' END AS payment_status,
                   CASE WHEN p_partkey % 6 = 5 THEN 'paused' ELSE 'active' END AS status,
                   TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 28 AS INT)) AS starts_at,
                   TIMESTAMP_NTZ '2024-01-08 00:00:00' + make_dt_interval(CAST(p_partkey % 28 AS INT)) AS ends_at,
                   TIMESTAMP_NTZ '2023-12-20 00:00:00' + make_dt_interval(CAST(p_partkey % 9 AS INT)) AS created_at
            FROM {p}
            UNION ALL
            SELECT 'b' || s_suppkey, 'boutique', 'v' || s_suppkey, NULL, NULL, NULL, NULL, NULL,
                   CAST(1 + s_suppkey % 3 AS SMALLINT), CAST(5000 AS DECIMAL(12,2)), 'paid', 'active',
                   TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(s_suppkey % 28 AS INT)),
                   TIMESTAMP_NTZ '2024-01-08 00:00:00' + make_dt_interval(CAST(s_suppkey % 28 AS INT)),
                   TIMESTAMP_NTZ '2023-12-20 00:00:00' + make_dt_interval(CAST(s_suppkey % 9 AS INT))
            FROM {s}
            UNION ALL
            SELECT 'n' || r_regionkey, 'banner', CASE WHEN r_regionkey % 2 = 0 THEN 'v' || r_regionkey END, NULL,
                   r_name, CASE WHEN r_regionkey % 3 = 0 THEN NULL ELSE 'Region ' || r_regionkey || ' & <deals>' END,
                   CASE WHEN r_regionkey % 2 = 1 THEN 'img/banner' || r_regionkey || '.jpg' END,
                   CASE r_regionkey % 4 WHEN 0 THEN 'https://example.org/r' || r_regionkey
                        WHEN 1 THEN 'javascript:alert(1)' WHEN 2 THEN 'store.html?vendor=v2' END,
                   CAST(1 AS SMALLINT), CAST(20000 AS DECIMAL(12,2)), 'paid', 'active',
                   TIMESTAMP_NTZ '2024-01-10 00:00:00', TIMESTAMP_NTZ '2024-01-20 00:00:00',
                   TIMESTAMP_NTZ '2023-12-20 00:00:00'
            FROM {r}""", p="part", s="supplier", r="region")

    def page_views(self) -> DataFrame:
        """Impression log for G6: each event shows one product of one vendor."""
        return self._sql("""
            SELECT event_id, ts, 'p' || (user_id * 13 + event_id) % (SELECT count(*) FROM {p}) AS product_id,
                   'v' || (user_id % (SELECT count(*) FROM {s})) AS vendor_id
            FROM {e}""", e="events", p="part", s="supplier")

    # ---- people, roles ---------------------------------------------------
    def users(self) -> DataFrame:
        return self._sql("""
            SELECT 'u' || c_custkey AS id, 'c' || c_custkey || '@example.org' AS email,
                   CASE WHEN c_custkey % 2 = 0 THEN map('provider', 'email')
                        ELSE map('provider', 'phone', 'role', 'customer') END AS claims
            FROM {c}
            UNION ALL
            SELECT 'su' || s_suppkey, 'Owner' || s_suppkey || '@Shop.Example',
                   map('provider', 'email', 'role', 'vendor', 'vendor_id', 'v' || s_suppkey)
            FROM {s}""", c="customer", s="supplier")

    def staff(self) -> DataFrame:
        """One vendor-role staff row per supplier; admins from one market segment."""
        return self._sql("""
            SELECT 'owner' || s_suppkey || '@shop.example' AS email, 'vendor' AS role,
                   'v' || s_suppkey AS vendor_id, CAST(NULL AS STRING) AS user_id
            FROM {s}
            UNION ALL
            SELECT 'c' || c_custkey || '@example.org', 'admin', NULL, NULL
            FROM {c} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 0""", s="supplier", c="customer")

    def viewers(self) -> DataFrame:
        """Who asks: every customer, every vendor owner, one admin, one anon."""
        return self._sql("""
            SELECT 'cu' || c_custkey AS viewer_id, 'authenticated' AS role, 'u' || c_custkey AS user_id,
                   CAST(NULL AS STRING) AS vendor_id
            FROM {c}
            UNION ALL
            SELECT 've' || s_suppkey, 'vendor', 'su' || s_suppkey, 'v' || s_suppkey FROM {s}
            UNION ALL
            SELECT 'admin0', 'admin', 'u0', NULL
            UNION ALL
            SELECT 'anon', 'anon', NULL, NULL""", c="customer", s="supplier")

    def browse_requests(self) -> DataFrame:
        return self._sql("""
            SELECT 'b' || c_custkey AS request_id, 'v' || (c_custkey % (SELECT count(*) FROM {s})) AS vendor,
                   CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'RED' WHEN 2 THEN 'steel' ELSE ' ring' END AS q,
                   CASE WHEN c_custkey % 3 = 0 THEN array('ECONOMY', 'PROMO') ELSE array() END AS categories,
                   CAST(900 + c_custkey % 100 AS DECIMAL(18,2)) AS max_price,
                   c_custkey % 2 = 0 AS in_stock_only,
                   CASE c_custkey % 5 WHEN 0 THEN 'price-asc' WHEN 1 THEN 'price-desc'
                        WHEN 2 THEN 'popular' WHEN 3 THEN 'rating' ELSE 'default' END AS sort,
                   CASE WHEN c_custkey % 3 = 1 THEN 'store' ELSE 'vendor' END AS page
            FROM {c}""", c="customer", s="supplier")

    def status_changes(self) -> DataFrame:
        """Seller status updates aimed at real (order, vendor) pairs; one status
        value is invalid, some notes too long, some actors are other vendors."""
        return self._sql("""
            SELECT 'r' || l_orderkey AS request_id,
                   'v' || (l_partkey % (SELECT count(*) FROM {s})) AS vendor_id,
                   CAST(l_linenumber AS BIGINT) AS seq,
                   l_shipdate AS ts,
                   CASE l_linenumber % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'paid' WHEN 2 THEN 'shipped'
                        WHEN 3 THEN 'delivered' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'pending' ELSE 'lost' END AS status,
                   CASE WHEN l_suppkey % 13 = 0 THEN repeat('n', 501) ELSE 'note ' || l_suppkey END AS status_note,
                   CASE WHEN l_suppkey % 10 = 0 THEN 'admin' ELSE 'vendor' END AS actor_role,
                   CASE WHEN l_suppkey % 10 = 0 THEN NULL
                        WHEN l_suppkey % 9 = 0 THEN 'v' || ((l_partkey + 1) % (SELECT count(*) FROM {s}))
                        ELSE 'v' || (l_partkey % (SELECT count(*) FROM {s})) END AS actor_vendor_id
            FROM {l}""", l="lineitem", s="supplier")

    def quiz_answers(self) -> DataFrame:
        return self._sql("""
            SELECT event_id AS answer_id,
                   CASE event_id % 3 WHEN 0 THEN 'mystique' WHEN 1 THEN 'fresh' ELSE 'cozy' END AS vibe,
                   CASE event_id % 4 WHEN 0 THEN 'evening' WHEN 1 THEN 'day' WHEN 2 THEN 'date' ELSE 'work' END AS occasion,
                   CASE event_id % 2 WHEN 0 THEN 'strong' ELSE 'light' END AS intensity,
                   CASE event_id % 3 WHEN 0 THEN '30ml' WHEN 1 THEN '50ml' ELSE '100ml' END AS size
            FROM {e}""", e="events")

    def vendor_changes(self) -> DataFrame:
        """Registry requests: upserts (some with bad ids/emails/phones) and
        deletes; several changes per id so the last one must win."""
        return self._sql("""
            SELECT CASE WHEN event_id % 17 = 0 THEN ' V_' || (user_id % 60) || '! '
                        WHEN event_id % 3 = 0 THEN ' New-' || (user_id % 40) || ' '
                        WHEN event_id % 37 = 0 THEN ' V' || (user_id % 60) || char(10)
                        ELSE ' V' || (user_id % 60) || ' ' END AS id,
                   event_id AS seq, ts,
                   CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
                   CASE WHEN event_id % 19 = 0 THEN '   ' ELSE 'Shop ' || user_id || ' ' || event_type END AS name,
                   CASE WHEN event_id % 23 = 0 THEN 'not-an-email'
                        WHEN event_id % 29 = 0 THEN 'C' || (user_id % 5) || '@Example.org'
                        ELSE ' Owner' || user_id || '@Shop.Example ' END AS email,
                   CASE WHEN event_id % 31 = 0 THEN '123' ELSE '+234 (80) ' || (10000000 + event_id) END AS whatsapp,
                   CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' About ' || event_id END AS description,
                   CASE WHEN event_id % 5 = 0 THEN '' ELSE 'l' || event_id || '.png' END AS logo,
                   CASE WHEN event_id % 6 = 0 THEN NULL ELSE ' #' || event_id END AS primary_color,
                   '#s' || (event_id % 9) AS secondary_color, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'g' END AS gradient,
                   'c' || (event_id % 3) AS card_gradient, '#a' AS accent_color,
                   CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'b' || event_id END AS banner_image,
                   CASE WHEN event_id % 31 = 7 THEN 'abc' WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 2 THEN '4.5' END AS rating,
                   CASE WHEN event_id % 37 = 5 THEN '1x' WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 > 1 THEN '17' END AS review_count,
                   CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' own' || event_id || '.html ' END AS page,
                   CASE WHEN event_id % 2 = 0 THEN NULL ELSE array('C' || (event_id % 4), 'Home') END AS categories,
                   CASE WHEN event_id % 2 = 0 THEN '  ' ELSE 'tag ' || event_id END AS tagline
            FROM {e}""", e="events")

    def vendor_settings(self) -> DataFrame:
        """Vendors' settings updates: which fields they send, some cleared."""
        return self._sql("""
            SELECT 'v' || (user_id % 12) AS vendor_id, event_id AS seq, ts,
                   CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'Shop ' || event_id END AS name,
                   CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'tag ' || event_id END AS tagline,
                   CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'about ' || event_id END AS description,
                   CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'l' || event_id END AS logo,
                   CASE event_id % 4 WHEN 0 THEN array('name', 'tagline', 'description', 'logo') WHEN 1 THEN array('name')
                        WHEN 2 THEN array('tagline', 'logo') ELSE array('description') END AS fields
            FROM {e}""", e="events")

    def product_changes(self) -> DataFrame:
        """Catalogue edits by vendors: insert, partial update, delete."""
        return self._sql("""
            SELECT 'p' || (event_id % (SELECT count(*) FROM {p})) AS id,
                   'v' || ((event_id % (SELECT count(*) FROM {p})) % (SELECT count(*) FROM {s})) AS vendor,
                   event_id AS seq,
                   CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'upsert' ELSE 'update' END AS op,
                   CASE WHEN event_type IN ('signup', 'click') THEN 'Renamed ' || event_id END AS name,
                   CASE WHEN event_id % 3 > 0 THEN 'Text ' || event_id END AS description,
                   CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(round(value * 10, 2) AS DECIMAL(18,2)) END AS price,
                   CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 12, 2) AS DECIMAL(18,2)) END AS original_price,
                   'img' || event_id || '.jpg' AS image,
                   CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN false
                        WHEN event_type = 'view' AND event_id % 4 > 0 THEN event_id % 3 <> 0 END AS in_stock,
                   CASE event_id % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Gifts' ELSE NULL END AS category,
                   CASE WHEN event_id % 4 = 1 THEN NULL ELSE array('S', 'X' || (event_id % 5)) END AS sizes,
                   CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Hot' END AS badge,
                   CASE event_id % 3 WHEN 0 THEN '' ELSE 'L' END AS size,
                   CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'wood' END AS material,
                   CASE event_id % 2 WHEN 0 THEN 'here' ELSE NULL END AS origin,
                   CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'n' || event_id END AS notes,
                   CASE event_type WHEN 'click' THEN array('name', 'description', 'badge', 'sizes')
                        WHEN 'purchase' THEN array('price', 'original_price', 'category')
                        WHEN 'view' THEN array('in_stock', 'material', 'notes') ELSE CAST(array() AS ARRAY<STRING>) END AS fields
            FROM {e}""", e="events", p="part", s="supplier")

    def checkout_forms(self) -> DataFrame:
        """Checkout form submissions (D12): some blank names and landmarks."""
        return self._sql("""
            SELECT 'f' || o_orderkey AS form_id,
                   CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE split_part(c_name, '#', 1) END AS first_name,
                   split_part(c_name, '#', 2) AS last_name,
                   '0801' || (1000000 + o_custkey) AS phone,
                   CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c' || o_custkey || '@example.org' END AS email,
                   CASE WHEN o_orderkey % 2 = 0 THEN 'acct' || o_custkey || '@example.org' END AS account_email,
                   ' ' || o_custkey || ' Market Road ' AS address,
                   'City ' || c_nationkey AS city, 'State ' || (c_nationkey % 5) AS state,
                   CASE WHEN o_orderkey % 4 = 0 THEN 'Near gate ' || o_orderkey ELSE '  ' END AS landmark
            FROM {o} JOIN {c} ON o_custkey = c_custkey""", o="orders", c="customer")

    def proposed_changes(self) -> DataFrame:
        """Proposed writes (F9) by customers, vendors and admins."""
        return self._sql("""
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
                   CASE WHEN event_id % 6 = 0 THEN array('v' || (event_id % 7), 'v' || (event_id % 5))
                        ELSE array('v' || ((event_id + CAST(floor(value) AS BIGINT) % 2) % 7)) END AS item_vendors,
                   CASE WHEN event_id % 8 = 0 THEN array('status', 'subtotal') ELSE array('status', 'status_note') END
                     AS changed_columns
            FROM {e}""", e="events")
