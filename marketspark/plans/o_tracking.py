"""Oracle SQL for order tracking."""

from ..functions.expr import STATUS_LABELS
from .sql_fixed import STORE, WHATSAPP
from .oracle import ADAPTERS, oracle

LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STATUS_LABELS.items()) + "}"

ADAPTERS["mk_status"] = """
SELECT 'r' || l_orderkey AS request_id, 'v' || (l_partkey % (SELECT count(*) FROM supplier)) AS vendor_id,
       CAST(l_linenumber AS BIGINT) AS seq, l_shipdate AS ts,
       CASE l_linenumber % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'paid' WHEN 2 THEN 'shipped'
            WHEN 3 THEN 'delivered' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'pending' ELSE 'lost' END AS status,
       CASE WHEN l_suppkey % 13 = 0 THEN repeat('n', 501) ELSE 'note ' || l_suppkey END AS status_note,
       CASE WHEN l_suppkey % 10 = 0 THEN 'admin' ELSE 'vendor' END AS actor_role,
       CASE WHEN l_suppkey % 10 = 0 THEN NULL
            WHEN l_suppkey % 9 = 0 THEN 'v' || ((l_partkey + 1) % (SELECT count(*) FROM supplier))
            ELSE 'v' || (l_partkey % (SELECT count(*) FROM supplier)) END AS actor_vendor_id
FROM lineitem"""

ADAPTERS["e_verdict"] = """
SELECT *, CASE WHEN NOT coalesce(actor_role = 'admin' OR (actor_role = 'vendor' AND actor_vendor_id = vendor_id), false)
                 THEN 'not_allowed'
               WHEN NOT coalesce(status IN ('pending', 'confirmed', 'paid', 'shipped', 'delivered', 'cancelled'), false)
                 THEN 'invalid_status'
               WHEN status_note IS NOT NULL AND length(status_note) > 500 THEN 'note_too_long' END AS reason
FROM mk_status"""

ADAPTERS["e_updated"] = """
SELECT v.* REPLACE (CASE WHEN l.request_id IS NULL THEN v.status ELSE l.status END AS status,
                    CASE WHEN l.request_id IS NULL THEN v.status_note ELSE l.status_note END AS status_note,
                    coalesce(l.ts, v.updated_at) AS updated_at)
FROM o_vendor_orders v LEFT JOIN (
  SELECT * FROM e_verdict WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY request_id, vendor_id
                             ORDER BY ts DESC, seq DESC, status DESC, status_note DESC) = 1) l
  ON l.request_id = v.request_id AND l.vendor_id = v.vendor_id"""

ADAPTERS["e_cards"] = f"""
SELECT v.user_id, v.vendor_id, v.created_at, v.id, coalesce(nv.name, v.vendor_id) AS vendor_name,
       coalesce({LABELS}[v.status], v.status) AS status_label, nullif(v.status_note, '') AS status_note,
       (SELECT string_agg((e->>'name') || ' x ' || coalesce(e->>'qty', '1') || ' = ' ||
                          CAST(CAST(e->>'price' AS DECIMAL(18,2)) * coalesce(CAST(e->>'qty' AS INTEGER), 1) AS DECIMAL(38,2)),
                          chr(10) ORDER BY no)
        FROM (SELECT unnest(CAST(v.items AS JSON[])) AS e, generate_subscripts(CAST(v.items AS JSON[]), 1) AS no)) AS lines,
       (SELECT CAST(sum(CAST(e->>'price' AS DECIMAL(18,2)) * coalesce(CAST(e->>'qty' AS INTEGER), 1)) AS DECIMAL(38,2))
        FROM unnest(CAST(v.items AS JSON[])) AS t(e)) AS lines_total,
       CAST(json_array_length(v.items) AS BIGINT) AS n_lines
FROM e_updated v LEFT JOIN nv ON nv.id = v.vendor_id"""

oracle("my_orders", MY_ORDERS := """
SELECT user_id, id, vendor_name, status_label, status_note, lines, lines_total, n_lines,
       row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank
FROM e_cards""")

oracle("my_orders_viewer", """
SELECT id, user_id, vendor_id, status_label, status_note, row_number() OVER (ORDER BY created_at DESC, id) AS rank
FROM e_cards WHERE user_id = 'su3' OR vendor_id = 'v3'""")

oracle("my_orders_by_viewer", """
WITH seen AS (
  SELECT w.viewer_id, v.id, v.created_at FROM mk_viewers w JOIN o_vendor_orders v ON v.user_id = w.user_id WHERE w.role <> 'anon'
  UNION SELECT w.viewer_id, v.id, v.created_at FROM mk_viewers w JOIN o_vendor_orders v ON v.vendor_id = w.vendor_id WHERE w.role = 'vendor'
  UNION SELECT w.viewer_id, v.id, v.created_at FROM mk_viewers w CROSS JOIN o_vendor_orders v WHERE w.role = 'admin')
SELECT viewer_id, id, row_number() OVER (PARTITION BY viewer_id ORDER BY created_at DESC, id) AS rank FROM seen""")

oracle("mart_my_orders", MY_ORDERS)

oracle("mart_visible_orders", "SELECT id, user_id FROM o_orders WHERE user_id = 'u5'")

oracle("vendor_queue", QUEUE := """
SELECT vendor_id, status, id, row_number() OVER (PARTITION BY vendor_id, status ORDER BY created_at DESC, id) AS rank
FROM o_vendor_orders""")

oracle("mart_vendor_queue", QUEUE)

oracle("apply_status_changes", """
SELECT id, order_id, vendor_id, status, status_note, updated_at FROM e_updated""")

oracle("status_change_verdicts", "SELECT reason, count(*) AS n_changes FROM e_verdict GROUP BY reason")

oracle("order_contact_link", f"""
WITH b AS (
  SELECT v.id, v.order_id, nv.name AS vname,
         regexp_replace(coalesce(nullif(nv.whatsapp, ''), {WHATSAPP}), '[^0-9]', '', 'g') AS d0
  FROM o_vendor_orders v LEFT JOIN nv ON nv.id = v.vendor_id),
c AS (
  SELECT id, CASE WHEN starts_with(d0, '0') THEN '234' || substr(d0, 2) ELSE d0 END AS number,
         'Hello ' || coalesce(nullif(vname, ''), {STORE}) || ', I am contacting you about my order '
         || order_id || '.' AS msg
  FROM b)
SELECT id, number, 'https://wa.me/' || number || '?text=' ||
       replace(replace(replace(replace(replace(url_encode(msg), '%21', '!'), '%27', ''''),
               '%28', '('), '%29', ')'), '%2A', '*') AS url
FROM c""")
