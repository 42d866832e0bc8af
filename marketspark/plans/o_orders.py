"""Oracle SQL for order intake."""

from .sql_fixed import INQUIRY, NEW_ORDER, STORE, WHATSAPP
from .oracle import ADAPTERS, oracle

# naira in DuckDB: grouped, up to 3 decimals, trailing zeros dropped
def naira(x: str) -> str:
    return "('₦' || regexp_replace(format('{:,}', CAST(round(" + x + ", 3) AS DOUBLE)), '\\.0$', ''))"

oracle("validate_headers", """
SELECT request_id,
  CASE WHEN user_id IS NULL THEN 'sign_in_required'
       WHEN nullif(trim(coalesce(customer_name, '')), '') IS NULL
         OR nullif(trim(coalesce(customer_phone, '')), '') IS NULL
         OR nullif(trim(coalesce(customer_address, '')), '') IS NULL THEN 'missing_customer_details'
       WHEN length(customer_name) > 150 OR length(coalesce(customer_email, '')) > 320
         OR length(customer_phone) > 30 OR length(customer_address) > 1000 THEN 'customer_details_too_long'
  END AS reason
FROM mk_requests""")

oracle("validate_items", """
SELECT request_id, reason,
       CASE WHEN reason IS NULL THEN CAST(json_array_length(items) AS BIGINT) END AS n_lines
FROM o_items_reason""")

oracle("merge_lines", "SELECT request_id, product_id, CAST(qty AS BIGINT) AS qty FROM o_merged")

oracle("merge_order_lines", """
SELECT request_id, product_id, CAST(sum(qty) AS BIGINT) AS qty FROM mk_order_lines GROUP BY 1, 2""")

oracle("canonical_lines", """
SELECT request_id, product_id, vendor, name, price, CAST(qty AS BIGINT) AS qty FROM o_lines""")

oracle("availability_check", """
SELECT m.request_id, CAST(count(*) AS BIGINT) AS n_requested, count(c.product_id) AS n_matched,
       count(*) = count(c.product_id) AS available
FROM o_merged m LEFT JOIN o_canon c ON c.request_id = m.request_id AND c.product_id = m.product_id
GROUP BY 1""")

oracle("order_totals", """
SELECT request_id, CAST(sum(price * qty) AS DECIMAL(38,2)) AS total, count(*) AS n_lines,
       CAST(sum(qty) AS BIGINT) AS n_units
FROM o_lines GROUP BY 1""")

oracle("build_orders", "SELECT * FROM o_orders")

oracle("split_by_vendor", "SELECT * FROM o_vendor_orders")

oracle("order_response", """
SELECT o.id AS order_id,
       '{"orderId":' || to_json(o.id) || ',"total":' || CAST(o.total AS VARCHAR) || ',"vendorOrders":['
       || (SELECT string_agg('{"id":' || to_json(v.id) || ',"vendorId":' || to_json(v.vendor_id)
                             || ',"items":' || v.items || ',"total":' || CAST(v.subtotal AS VARCHAR)
                             || ',"status":' || to_json(v.status) || '}', ',' ORDER BY v.vendor_id)
           FROM o_vendor_orders v WHERE v.order_id = o.id) || ']}' AS response
FROM o_orders o""")

oracle("whatsapp_outbox", f"""
WITH vo AS (
  SELECT v.*, nv.name AS vname, nv.whatsapp AS wa FROM o_vendor_orders v LEFT JOIN nv ON nv.id = v.vendor_id),
lines AS (
  SELECT vo.id, string_agg('  • ' || (e->>'name') || ' (×' || (e->>'qty') || ') — '
                           || {naira("CAST(e->>'price' AS DECIMAL(18,2)) * CAST(e->>'qty' AS INTEGER)")},
                           chr(10) ORDER BY idx) AS item_lines
  FROM vo, unnest(CAST(vo.items AS JSON[])) WITH ORDINALITY AS t(e, idx)
  GROUP BY vo.id),
msg AS (
  SELECT vo.id, vo.vendor_id,
         regexp_replace(coalesce(nullif(wa, ''), {WHATSAPP}), '[^0-9]', '', 'g') AS number,
         {NEW_ORDER} || chr(10) || chr(10) || '*Boutique:* '
         || coalesce(nullif(vname, ''), {STORE}) || chr(10) || chr(10)
         || '*Customer Details:*' || chr(10) || '👤 Name: ' || customer_name
         || chr(10) || '📍 Address: ' || customer_address
         || chr(10) || '📞 Phone: ' || customer_phone
         || chr(10) || '✉️ Email: ' || coalesce(customer_email, 'Not provided')
         || chr(10) || chr(10) || '*Items Ordered:*' || chr(10) || item_lines
         || chr(10) || chr(10) || '💰 *Items Total: ' || {naira("subtotal")} || '*'
         || chr(10) || '🚚 *Delivery: To be discussed with seller*' || chr(10) || chr(10)
         || 'Please reply with the delivery cost and bank account details to complete the order.' || chr(10)
         || 'Thank you! 🙏' AS message
  FROM vo JOIN lines USING (id))
SELECT id AS vendor_order_id, vendor_id, number, message,
       'https://wa.me/' || number || '?text=' ||
       replace(replace(replace(replace(replace(url_encode(message), '%21', '!'), '%27', ''''),
               '%28', '('), '%29', ')'), '%2A', '*') AS url
FROM msg""")

oracle("product_inquiry_link", f"""
WITH m AS (
  SELECT p.id, coalesce(nullif(nv.whatsapp, ''), {WHATSAPP}) AS number,
         {INQUIRY} || chr(10) || chr(10) || '*Product:* ' || p.name
         || chr(10) || '*Price:* ' || {naira("p.price")}
         || chr(10) || '*Vendor:* ' || coalesce(nv.name, '')
         || chr(10) || chr(10)
         || 'I would like to place an order. Please share delivery cost and payment details. Thank you!' AS message
  FROM np p LEFT JOIN nv ON nv.id = p.vendor)
SELECT id AS product_id, message,
       'https://wa.me/' || number || '?text=' ||
       replace(replace(replace(replace(replace(url_encode(message), '%21', '!'), '%27', ''''),
               '%28', '('), '%29', ')'), '%2A', '*') AS url
FROM m""")

ADAPTERS["mk_forms"] = """
SELECT 'f' || o_orderkey AS form_id,
       CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE split_part(c_name, '#', 1) END AS first_name,
       split_part(c_name, '#', 2) AS last_name,
       '0801' || (1000000 + o_custkey) AS phone,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c' || o_custkey || '@example.org' END AS email,
       CASE WHEN o_orderkey % 2 = 0 THEN 'acct' || o_custkey || '@example.org' END AS account_email,
       ' ' || o_custkey || ' Market Road ' AS address,
       'City ' || c_nationkey AS city, 'State ' || (c_nationkey % 5) AS state,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Near gate ' || o_orderkey ELSE '  ' END AS landmark
FROM orders JOIN customer ON o_custkey = c_custkey"""

oracle("checkout_form_clean", """
WITH f AS (
  SELECT form_id, trim(coalesce(first_name, '')) AS fn, trim(coalesce(last_name, '')) AS ln,
         trim(coalesce(phone, '')) AS ph, trim(coalesce(email, '')) AS em, trim(coalesce(account_email, '')) AS ae,
         trim(coalesce(address, '')) AS ad, trim(coalesce(city, '')) AS ct, trim(coalesce(state, '')) AS st,
         trim(coalesce(landmark, '')) AS lm
  FROM mk_forms),
g AS (SELECT *, fn = '' OR ln = '' OR ph = '' OR ad = '' OR ct = '' OR st = '' AS missing FROM f)
SELECT form_id,
       CASE WHEN missing THEN 'missing_required_fields' END AS reason,
       CASE WHEN NOT missing THEN fn || ' ' || ln END AS name,
       CASE WHEN NOT missing THEN ph END AS phone,
       CASE WHEN NOT missing THEN coalesce(nullif(em, ''), nullif(ae, ''), 'Not provided') END AS email,
       CASE WHEN NOT missing THEN ad || ', ' || ct || ', ' || st || ', Nigeria'
            || CASE WHEN lm <> '' THEN ' (Landmark: ' || lm || ')' ELSE '' END END AS address
FROM g""")

oracle("intake_report", """
SELECT 'accepted' AS outcome, CAST(NULL AS VARCHAR) AS reason, count(*) AS n_requests,
       CAST(sum(total) AS DECIMAL(38,2)) AS value
FROM o_orders
UNION ALL
SELECT 'rejected', reason, count(*), CAST(NULL AS DECIMAL(38,2)) FROM (
  SELECT request_id, reason FROM o_screen WHERE reason IS NOT NULL
  UNION ALL
  SELECT request_id, 'unavailable' FROM o_screen
  WHERE reason IS NULL AND request_id NOT IN (SELECT request_id FROM o_lines)) r
GROUP BY reason""")
