"""Oracle SQL for the column expressions."""

from .o_orders import naira
from .sql_fixed import QL, QS, SAFE_DEFAULT, WHATSAPP
from .oracle import oracle

ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
URI = ("replace(replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', ''''), '%28', '('), "
       "'%29', ')'), '%2A', '*')")
EMAIL = (r'''^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))@'''
         r'''((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\])|(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))$''')

oracle("k_expressions", f"""
WITH s AS (
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
  FROM orders),
p AS (
  SELECT *, trim(coalesce(phone, '')) AS inp FROM s),
p1 AS (SELECT *, regexp_replace(inp, '[^0-9]', '', 'g') AS d0 FROM p),
p2 AS (SELECT *, CASE WHEN starts_with(d0, '00') THEN substr(d0, 3) ELSE d0 END AS d1 FROM p1),
p3 AS (SELECT *, CASE WHEN starts_with(d1, '0') AND length(d1) = 11 THEN '234' || substr(d1, 2) ELSE d1 END AS d2
       FROM p2)
SELECT k,
  {naira("amount")} AS naira,
  CASE WHEN original IS NULL OR original = 0 THEN 0
       ELSE CAST(floor((1 - CAST(price AS DOUBLE) / CAST(original AS DOUBLE)) * 100 + 0.5) AS INTEGER) END
    AS percent_off,
  CAST((SELECT count(*) FROM range(5) t(i) WHERE i < floor(rating)) AS INTEGER) AS stars_full,
  floor(rating) IN (0, 1, 2, 3, 4) AND rating % 1 >= 0.5 AS stars_half,
  CAST((SELECT count(*) FROM range(5) t(i) WHERE NOT i < floor(rating) AND NOT (i = floor(rating) AND rating % 1 >= 0.5)) AS INTEGER)
    AS stars_empty,
  CASE WHEN starts_with(d2, '234') AND length(d2) = 13 THEN '+' || d2
       WHEN starts_with(inp, '+') AND length(d2) BETWEEN 8 AND 15 THEN '+' || d2 END AS phone_e164,
  regexp_replace(coalesce(nullif(phone, ''), {WHATSAPP}), '[^0-9]', '', 'g') AS wa_digits,
  {URI.format(x="text")} AS uri,
  {ESC.format(x="text")} AS html,
  CASE WHEN trim(link) <> '' AND regexp_matches(trim(link), '^(https?://|[a-z0-9][a-z0-9._/-]*(\\?[^\\s]*)?$)', 'i')
       THEN trim(link) ELSE {SAFE_DEFAULT} END AS safe_url,
  regexp_replace(lower(badge), '^([^ ]*) ', '\\1-') AS badge_slug,
  coalesce(nullif(nullif(trim(display), ''), ''), nullif(name, ''), split_part(email, '@', 1)) AS display_name,
  split_part(name, ' ', 1) AS first_name,
  upper(left(name, 1)) AS avatar,
  strftime(d, '%-d %B %Y') AS long_date,
  nullif(trim(display), '') AS blank_to_null,
  coalesce(regexp_matches(lower(email), '{EMAIL.replace("'", "''")}'), false) AS email_ok,
  CASE size WHEN '30ml' THEN 'p2' WHEN '50ml' THEN 'p1' WHEN '100ml' THEN 'p7' END AS size_product
FROM p3""")

oracle("quiz_scores", f"""
WITH a AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'mystique' WHEN 1 THEN 'fresh' ELSE 'cozy' END AS vibe,
         CASE event_id % 4 WHEN 0 THEN 'evening' WHEN 1 THEN 'day' WHEN 2 THEN 'date' ELSE 'work' END AS occasion,
         CASE event_id % 2 WHEN 0 THEN 'strong' ELSE 'light' END AS intensity,
         CASE event_id % 3 WHEN 0 THEN '30ml' WHEN 1 THEN '50ml' ELSE '100ml' END AS size
  FROM events),
s AS (
  SELECT CASE WHEN vibe = 'mystique' AND occasion = 'evening' AND intensity = 'strong' THEN 99
              WHEN vibe = 'mystique' OR intensity = 'strong' THEN 94
              WHEN vibe = 'cozy' OR occasion = 'date' THEN 89 ELSE 85 END AS score,
         CASE size WHEN '30ml' THEN 'p2' WHEN '50ml' THEN 'p1' WHEN '100ml' THEN 'p7' END AS product_id
  FROM a)
SELECT score, CASE WHEN score >= 94 THEN {QS} ELSE {QL} END
         AS variant, product_id, count(*) AS n_answers
FROM s GROUP BY ALL""")
