"""Oracle SQL for the registry (I1-I9). The product log is replayed
change by change with a recursive CTE."""

from ..operators.subscriptions import TRIAL_DAYS
from .oracle import ADAPTERS, oracle

ADAPTERS["mk_vchanges"] = """
SELECT CASE WHEN event_id % 17 = 0 THEN ' V_' || (user_id % 60) || '! '
            WHEN event_id % 3 = 0 THEN ' New-' || (user_id % 40) || ' '
            WHEN event_id % 37 = 0 THEN ' V' || (user_id % 60) || chr(10)
            ELSE ' V' || (user_id % 60) || ' ' END AS id,
       event_id AS seq, ts,
       CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
       CASE WHEN event_id % 19 = 0 THEN '   ' ELSE 'Shop ' || user_id || ' ' || event_type END AS name,
       CASE WHEN event_id % 23 = 0 THEN 'not-an-email'
            WHEN event_id % 29 = 0 THEN 'C' || (user_id % 5) || '@Example.org'
            ELSE ' Owner' || user_id || '@Shop.Example ' END AS email,
       CASE WHEN event_id % 31 = 0 THEN '123' ELSE '+234 (80) ' || (10000000 + event_id) END AS whatsapp,
       CASE WHEN event_id % 2 = 0 THEN '  ' ELSE 'tag ' || event_id END AS tagline,
                   CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' About ' || event_id END AS description,
                   CASE WHEN event_id % 5 = 0 THEN '' ELSE 'l' || event_id || '.png' END AS logo,
                   CASE WHEN event_id % 6 = 0 THEN NULL ELSE ' #' || event_id END AS primary_color,
                   '#s' || (event_id % 9) AS secondary_color, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'g' END AS gradient,
                   'c' || (event_id % 3) AS card_gradient, '#a' AS accent_color,
                   CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'b' || event_id END AS banner_image,
                   CASE WHEN event_id % 31 = 7 THEN 'abc' WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 2 THEN '4.5' END AS rating,
                   CASE WHEN event_id % 37 = 5 THEN '1x' WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 > 1 THEN '17' END AS review_count,
                   CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' own' || event_id || '.html ' END AS page,
                   CASE WHEN event_id % 2 = 0 THEN NULL ELSE ['C' || (event_id % 4), 'Home'] END AS categories
FROM events"""

ADAPTERS["mk_staff"] = """
SELECT 'owner' || s_suppkey || '@shop.example' AS email, 'vendor' AS role, 'v' || s_suppkey AS vendor_id,
       CAST(NULL AS VARCHAR) AS user_id FROM supplier
UNION ALL
SELECT 'c' || c_custkey || '@example.org', 'admin', NULL, NULL FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 0"""

ADAPTERS["mk_users"] = """
SELECT 'u' || c_custkey AS id, 'c' || c_custkey || '@example.org' AS email,
       CASE WHEN c_custkey % 2 = 0 THEN MAP {'provider': 'email'}
            ELSE MAP {'provider': 'phone', 'role': 'customer'} END AS claims
FROM customer
UNION ALL
SELECT 'su' || s_suppkey, 'Owner' || s_suppkey || '@Shop.Example',
       MAP {'provider': 'email', 'role': 'vendor', 'vendor_id': 'v' || s_suppkey} FROM supplier"""

ADAPTERS["r_clean"] = """
SELECT c.* EXCLUDE (id, email_raw, whatsapp),
  CASE WHEN NOT regexp_full_match(vendor_id, '[a-z0-9-]{2,50}') THEN 'invalid_vendor_id'
       WHEN op = 'delete' AND vendor_id IN ('perfume', 'kitchen', 'variety') THEN 'core_vendor'
       WHEN op = 'delete' THEN NULL
       WHEN coalesce(op, '') <> 'upsert' THEN 'unsupported_action'
       WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+[.][^\\s@]+') THEN 'invalid_email'
       WHEN NOT regexp_full_match(wa, '[0-9]{10,15}') THEN 'invalid_whatsapp'
       WHEN nullif(trim(coalesce(c.name, '')), '') IS NULL THEN 'name_required'
       WHEN email IN (SELECT lower(email) FROM mk_staff WHERE role = 'admin') THEN 'admin_email'
       WHEN (nullif(rating, '') IS NOT NULL AND TRY_CAST(rating AS DECIMAL(3,1)) IS NULL)
         OR (nullif(review_count, '') IS NOT NULL AND TRY_CAST(review_count AS INTEGER) IS NULL) THEN 'invalid_number'
  END AS reason
FROM (SELECT * RENAME (email AS email_raw), lower(trim(coalesce(id, ''))) AS vendor_id, lower(trim(coalesce(email, ''))) AS email,
             regexp_replace(coalesce(whatsapp, ''), '[^0-9]', '', 'g') AS wa
      FROM mk_vchanges) c"""

ADAPTERS["r_acc"] = """
SELECT *, CASE WHEN reason IS NULL AND op = 'delete' AND vendor_id IN (SELECT vendor_id FROM o_vendor_orders)
               THEN 'vendor_has_orders' ELSE reason END AS reason2
FROM r_clean"""

ADAPTERS["r_last"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY ts DESC, seq DESC) AS rn
               FROM r_acc WHERE reason2 IS NULL) WHERE rn = 1"""

ADAPTERS["r_staff"] = """
WITH le AS (
  SELECT email, vendor_id AS owner FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts DESC, seq DESC) AS rn
    FROM r_acc WHERE reason2 IS NULL AND op = 'upsert') WHERE rn = 1)
SELECT email, role, vendor_id FROM mk_staff WHERE role <> 'vendor'
UNION ALL
SELECT email, role, vendor_id FROM mk_staff
WHERE role = 'vendor' AND vendor_id NOT IN (SELECT vendor_id FROM r_last) AND email NOT IN (SELECT email FROM le)
UNION ALL
SELECT l.email, 'vendor', l.vendor_id FROM r_last l JOIN le ON le.email = l.email AND le.owner = l.vendor_id
WHERE l.op = 'upsert'"""

ADAPTERS["r_staff_linked"] = """
SELECT s.email, s.role, s.vendor_id, (SELECT min(u.id) FROM mk_users u WHERE lower(u.email) = s.email) AS user_id
FROM r_staff s"""

oracle("clean_vendor_changes", "SELECT seq, op, vendor_id, email, wa, reason FROM r_clean")

_TEXTS = ("tagline description logo primary_color secondary_color gradient card_gradient accent_color banner_image").split()

oracle("merge_vendors", f"""
SELECT coalesce(v.id, l.vendor_id) AS vendor_id,
       CASE WHEN l.op = 'upsert' THEN trim(l.name) ELSE v.name END AS name,
       {"".join(f"CASE WHEN l.op = 'upsert' THEN nullif(trim(coalesce(l.{c}, '')), '') ELSE v.{c} END AS {c}, " for c in _TEXTS)}
       CASE WHEN l.op = 'upsert' THEN l.wa ELSE v.whatsapp END AS whatsapp,
       CASE WHEN l.op = 'upsert' THEN coalesce(TRY_CAST(nullif(l.rating, '') AS DECIMAL(3,1)), 5) ELSE v.rating END AS rating,
       CAST(CASE WHEN l.op = 'upsert' THEN coalesce(TRY_CAST(nullif(l.review_count, '') AS INTEGER), 0) ELSE v.review_count END AS INTEGER)
         AS review_count,
       array_to_string(CASE WHEN l.op = 'upsert' THEN coalesce(l.categories, []) ELSE v.categories END, '|') AS categories,
       CASE WHEN l.op = 'upsert' THEN coalesce(nullif(trim(coalesce(l.page, '')), ''), 'store.html?vendor=' || l.vendor_id)
            ELSE v.page END AS page,
       CASE WHEN l.op = 'upsert' THEN 'upserted' ELSE 'existing' END AS source
FROM nv v FULL OUTER JOIN r_last l ON l.vendor_id = v.id
WHERE l.op IS NULL OR l.op = 'upsert'""")

oracle("delete_vendors", """WITH RECURSIVE
SELECT l.vendor_id,
  (SELECT count(*) FROM np WHERE np.vendor = l.vendor_id) AS n_products,
  (SELECT count(*) FROM mk_promotions p WHERE p.vendor_id = l.vendor_id) AS n_promotions,
  (SELECT count(*) FROM s_state s WHERE s.vendor_id = l.vendor_id) AS n_subscriptions,
  (SELECT count(*) FROM s_periods p WHERE p.vendor_id = l.vendor_id AND p.kind = 'pay') AS n_payments,
  (SELECT count(*) FROM mk_staff s WHERE s.vendor_id = l.vendor_id AND s.role = 'vendor') AS n_staff
FROM r_last l WHERE l.op = 'delete'""")

oracle("reassign_vendor_staff", "SELECT * FROM r_staff_linked")

oracle("link_staff_users", """
SELECT s.email, s.role, s.vendor_id, u.uid AS user_id, s.user_id IS DISTINCT FROM u.uid AS changed
FROM mk_staff s LEFT JOIN (SELECT lower(email) AS email, min(id) AS uid FROM mk_users GROUP BY 1) u
  ON u.email = s.email""")

oracle("user_claims", """
WITH j AS (
  SELECT u.id, u.email, u.claims, s.role, s.vendor_id,
         lower(u.email) IN (SELECT email FROM mk_staff
                            UNION ALL SELECT email FROM r_acc WHERE reason2 IS NULL AND op = 'upsert') AS was_staff
  FROM mk_users u LEFT JOIN r_staff_linked s ON s.email = lower(u.email)),
kv AS (
  SELECT id, k || '=' || v AS e FROM (
    SELECT id, unnest(map_keys(claims)) AS k, unnest(map_values(claims)) AS v FROM j
    WHERE role IS NULL AND NOT was_staff)
  UNION ALL
  SELECT id, k || '=' || v FROM (
    SELECT id, unnest(map_keys(claims)) AS k, unnest(map_values(claims)) AS v FROM j
    WHERE role IS NOT NULL OR was_staff)
  WHERE k NOT IN ('role', 'vendor_id')
  UNION ALL SELECT id, 'role=' || role FROM j WHERE role IS NOT NULL
  UNION ALL SELECT id, 'vendor_id=' || vendor_id FROM j WHERE role IS NOT NULL AND vendor_id IS NOT NULL)
SELECT j.id, j.email, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM kv WHERE kv.id = j.id), '') AS claims
FROM j""")

oracle("vendor_access_list", """
WITH s AS (
  SELECT s.email, s.vendor_id, u.uid AS user_id FROM mk_staff s
  LEFT JOIN (SELECT lower(email) AS email, min(id) AS uid FROM mk_users GROUP BY 1) u ON u.email = s.email
  WHERE s.role = 'vendor')
SELECT v.id AS vendor_id, v.name AS vendor_name, s.email, v.whatsapp, s.user_id IS NOT NULL AS account_created
FROM nv v LEFT JOIN s ON s.vendor_id = v.id""")

ADAPTERS["mk_pchanges"] = """
SELECT 'p' || (event_id % (SELECT count(*) FROM part)) AS id,
       'v' || ((event_id % (SELECT count(*) FROM part)) % (SELECT count(*) FROM supplier)) AS vendor,
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
                   CASE WHEN event_id % 4 = 1 THEN NULL ELSE ['S', 'X' || (event_id % 5)] END AS sizes,
                   CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Hot' END AS badge,
                   CASE event_id % 3 WHEN 0 THEN '' ELSE 'L' END AS size,
                   CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'wood' END AS material,
                   CASE event_id % 2 WHEN 0 THEN 'here' ELSE NULL END AS origin,
                   CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'n' || event_id END AS notes,
                   CASE event_type WHEN 'click' THEN ['name', 'description', 'badge', 'sizes']
                        WHEN 'purchase' THEN ['price', 'original_price', 'category']
                        WHEN 'view' THEN ['in_stock', 'material', 'notes'] ELSE CAST([] AS VARCHAR[]) END AS fields
FROM events"""

ADAPTERS["r_np"] = """
SELECT * REPLACE (CASE WHEN pos % 13 <> 5 THEN in_stock END AS in_stock,
                  CASE WHEN pos % 7 = 3 THEN ' Hot ' ELSE badge END AS badge) FROM np"""

ADAPTERS["r_pstream"] = """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM mk_pchanges"""

_FIELDS = ("name description price original_price image in_stock category sizes badge size material origin notes").split()

# the product log, one change at a time: an upsert writes all, an update its fields
ADAPTERS["r_preplay"] = f"""
SELECT k.id, 0 AS n, p.id IS NOT NULL AS present, p.vendor, {", ".join("p." + f for f in _FIELDS)},
       CASE WHEN p.id IS NOT NULL THEN 'existing' END AS source
FROM (SELECT id FROM r_np UNION SELECT id FROM mk_pchanges) k LEFT JOIN r_np p ON p.id = k.id
UNION ALL
SELECT r.id, c.n,
  CASE WHEN c.op = 'delete' THEN false WHEN c.op = 'upsert' THEN true ELSE r.present END,
  CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' THEN c.vendor ELSE r.vendor END,
  {", ".join(f"CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' THEN c.{f} WHEN r.present AND list_contains(c.fields, '{f}') THEN c.{f} ELSE r.{f} END" for f in _FIELDS)},
  CASE WHEN c.op = 'delete' THEN NULL WHEN c.op = 'upsert' THEN 'upserted'
       WHEN r.present AND r.source = 'existing' AND len(c.fields) > 0 THEN 'updated' ELSE r.source END
FROM r_preplay r JOIN r_pstream c ON c.id = r.id AND c.n = r.n + 1"""

_SAVED = {"in_stock": "coalesce(r.in_stock, true)", "sizes": "coalesce(r.sizes, [])"} | {
    f: f"nullif(r.{f}, '')" for f in ("badge", "size", "material", "origin", "notes")}


def _saved(f: str) -> str:
    kept = f"CASE WHEN r.source = 'existing' THEN r.{f} ELSE {_SAVED.get(f, 'r.' + f)} END"
    if f == "sizes":
        kept = f"array_to_string({kept}, '|')"
    return f"CAST({kept} AS DECIMAL(18,2)) AS {f}" if f.endswith("price") else f"{kept} AS {f}"


oracle("merge_products", f"""
SELECT r.id, r.vendor, {", ".join(map(_saved, _FIELDS))}, r.source
FROM r_preplay r JOIN (SELECT id, max(n) AS n FROM r_preplay GROUP BY id) m USING (id, n)
WHERE r.present""")

ADAPTERS["mk_settings"] = """
SELECT 'v' || (user_id % 12) AS vendor_id, event_id AS seq, ts,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'Shop ' || event_id END AS name,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'tag ' || event_id END AS tagline,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'about ' || event_id END AS description,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'l' || event_id END AS logo,
       CASE event_id % 4 WHEN 0 THEN ['name', 'tagline', 'description', 'logo'] WHEN 1 THEN ['name']
            WHEN 2 THEN ['tagline', 'logo'] ELSE ['description'] END AS fields
FROM events"""


def _setting(f: str) -> str:
    """The last valid update that sends f, else the stored value."""
    last = (f"(SELECT {{'x': s.{f}}} FROM mk_settings s WHERE s.vendor_id = v.id AND list_contains(s.fields, '{f}') "
            f"AND NOT (list_contains(s.fields, 'name') AND s.name IS NULL) ORDER BY ts DESC, seq DESC LIMIT 1)")
    return f"CASE WHEN {last} IS NULL THEN v.{f} ELSE {last}['x'] END AS {f}"


oracle("update_vendor_info", f"""WITH RECURSIVE
SELECT v.id AS vendor_id, {", ".join(map(_setting, ("name", "tagline", "description", "logo")))}, v.whatsapp FROM nv v""")

ADAPTERS["r_gone"] = "SELECT DISTINCT vendor_id FROM r_acc WHERE reason2 IS NULL AND op = 'delete'"

oracle("products_after_deletes", "SELECT id, vendor FROM np WHERE vendor NOT IN (SELECT vendor_id FROM r_gone)")

oracle("promotions_after_deletes", """WITH RECURSIVE
SELECT p.id, p.vendor_id, p.product_id FROM mk_promotions p LEFT JOIN np ON np.id = p.product_id
WHERE NOT EXISTS (SELECT 1 FROM r_gone g WHERE g.vendor_id = p.vendor_id OR g.vendor_id = np.vendor)""")

oracle("payments_after_deletes", """WITH RECURSIVE
SELECT vendor_id, seq, plan FROM s_periods WHERE kind = 'pay' AND vendor_id NOT IN (SELECT vendor_id FROM r_gone)""")

# the registry log replayed: is the vendor there, and when was it last inserted
ADAPTERS["r_vlog"] = """
SELECT vendor_id, op, ts, row_number() OVER (PARTITION BY vendor_id ORDER BY ts, seq) AS n FROM r_acc WHERE reason2 IS NULL"""

ADAPTERS["r_vreplay"] = """
SELECT l.vendor_id, 0 AS n, v.id IS NOT NULL AS present, CAST(NULL AS TIMESTAMP) AS inserted
FROM (SELECT DISTINCT vendor_id FROM r_vlog) l LEFT JOIN nv v ON v.id = l.vendor_id
UNION ALL
SELECT r.vendor_id, l.n, l.op = 'upsert',
       CASE WHEN l.op = 'delete' THEN NULL WHEN r.present THEN r.inserted ELSE l.ts END
FROM r_vreplay r JOIN r_vlog l ON l.vendor_id = r.vendor_id AND l.n = r.n + 1"""

oracle("subscriptions_after_deletes", f"""WITH RECURSIVE
kept AS (SELECT vendor_id, plan, status, access_started_at, current_period_start, access_ends_at FROM s_state
         WHERE vendor_id NOT IN (SELECT vendor_id FROM r_gone)),
ins AS (SELECT vendor_id, inserted FROM r_vreplay WHERE n = (SELECT max(n) FROM r_vlog l WHERE l.vendor_id = r_vreplay.vendor_id)
          AND inserted IS NOT NULL)
SELECT * FROM kept
UNION ALL
SELECT vendor_id, 'trial', 'trial', inserted, inserted, inserted + INTERVAL {TRIAL_DAYS} DAY FROM ins
WHERE vendor_id NOT IN (SELECT vendor_id FROM kept)""")
