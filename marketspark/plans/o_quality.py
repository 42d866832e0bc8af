"""Oracle SQL for data quality."""

from ..functions import expr as K
from ..operators import quality as J
from ..sources.raw_sql import NOT_NULL, RAW, REFERENCES, UNIQUE
from ..sources.testdata import SOURCE_TABLES
from .oracle import ADAPTERS, oracle
from .sql_fixed import lit

for _name, _text in RAW.items():
    for _table in SOURCE_TABLES:
        _text = _text.replace(f"@{_table}", _table)
    ADAPTERS[f"raw_{_name}"] = _text.replace("STR)", "VARCHAR)")


def _rules(table, source, rules):
    parts = []
    for name, cond in rules:
        parts.append(f"SELECT '{table}' AS \"table\", (SELECT count(*) FROM {source}) AS n_checked, "
                     f"'{name}' AS rule, (SELECT count(*) FROM {source} WHERE NOT coalesce({cond}, true)) "
                     f"AS n_violations")
    return "\nUNION ALL\n".join(parts)


def _in(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(lit(v) for v in values) + ")"


# null passes; broken text is no array (CASE keeps the JSON functions off it)
ITEMS = ("CASE WHEN items IS NULL THEN true WHEN NOT json_valid(items) THEN false "
         "WHEN json_type(items) <> 'ARRAY' THEN false ELSE json_array_length(items) > 0 END")

oracle("check_rules", "WITH RECURSIVE\n" + "\nUNION ALL\n".join([
    _rules("products", "raw_products", [("price_nonnegative", "price >= 0")]),
    _rules("orders", "raw_orders", [("items_nonempty", ITEMS), ("total_nonnegative", "total >= 0"),
                                    ("status_valid", _in("status", K.ORDER_STATUSES))]),
    _rules("vendor_orders", "raw_vendor_orders", [("items_nonempty", ITEMS), ("subtotal_nonnegative", "subtotal >= 0"),
                                                  ("status_valid", _in("status", K.ORDER_STATUSES)),
                                                  ("note_length", "status_note IS NULL OR length(status_note) <= 500")]),
    _rules("promotions", "raw_promotions", [
        ("type_valid", _in("promotion_type", J.PROMO_TYPES)),
        ("dates_ordered", "ends_at > starts_at"), ("amount_nonnegative", "amount_paid >= 0"),
        ("level_range", "placement_level BETWEEN 1 AND 3"),
        ("payment_valid", _in("payment_status", J.PROMO_PAYMENT)),
        ("status_valid", _in("status", J.PROMO_STATUS)),
        ("title_length", "title IS NULL OR length(title) <= 100"),
        ("subtitle_length", "subtitle IS NULL OR length(subtitle) <= 240"),
        ("target_valid", "(promotion_type = 'boutique' AND vendor_id IS NOT NULL AND product_id IS NULL) OR "
                         "(promotion_type = 'product' AND vendor_id IS NOT NULL AND product_id IS NOT NULL) OR "
                         "(promotion_type = 'banner' AND product_id IS NULL AND title IS NOT NULL)")]),
    _rules("subscriptions", "raw_subscriptions", [("plan_valid", _in("plan", J.SUB_PLANS)),
                                                  ("status_valid", _in("status", J.SUB_STATUS)),
                                                  ("period_ordered", "access_ends_at > current_period_start")]),
    _rules("payments", "raw_payments", [("plan_valid", _in("plan", J.PAY_PLANS)),
                                        ("amount_positive", "amount > 0"), ("period_ordered", "period_end > period_start"),
                                        ("status_valid", _in("payment_status", J.PAY_STATUS)),
                                        ("notes_length", "notes IS NULL OR length(notes) <= 500")]),
]))

oracle("check_unique", "\nUNION ALL\n".join(
    f"SELECT '{table}.{'_'.join(keys)}' AS \"check\", {" || '|' || ".join(keys)} AS key, count(*) AS n FROM raw_{table} "
    f"WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)}{f' AND {where}' if where else ''} "
    f"GROUP BY {', '.join(keys)} HAVING count(*) > 1" for table, keys, where in UNIQUE))

oracle("check_foreign_keys", "WITH RECURSIVE\n" + "\nUNION ALL\n".join(
    f"SELECT '{child}.{ck}' AS \"check\", (SELECT count(*) FROM raw_{child} c WHERE {ck} IS NOT NULL "
    f"AND NOT EXISTS (SELECT 1 FROM raw_{parent} p WHERE p.{pk} = c.{ck})) AS n_orphans"
    for child, refs in REFERENCES.items() for ck, parent, pk in refs))

oracle("check_not_null", "\nUNION ALL\n".join(
    f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM raw_{table}"
    for table, cols in NOT_NULL.items() for c in cols))

oracle("reconcile_orders", """
WITH a AS (
  SELECT order_id, CAST(sum(subtotal) AS DECIMAL(38,2)) AS s, sum(n_items) AS n,
         bool_and(NOT EXISTS (SELECT 1 FROM unnest(CAST(items AS JSON[])) t(e)
                              WHERE (e->>'vendor') IS DISTINCT FROM vendor_id)) AS own
  FROM o_vendor_orders GROUP BY order_id)
SELECT o.id AS order_id, o.total, a.s AS sum_subtotals, o.total = coalesce(a.s, 0) AS totals_match,
       o.n_items = coalesce(a.n, 0) AS items_match, coalesce(a.own, false) AS items_match_vendor
FROM o_orders o LEFT JOIN a ON a.order_id = o.id""")

oracle("write_marts", "WITH RECURSIVE\n" + "\nUNION ALL\n".join(
    f"SELECT '{mart}' AS mart, strftime({ts}, '%Y-%m-%d') AS day, count(*) AS n_rows, CAST(sum({amount}) AS DECIMAL(38,2)) AS amount "
    f"FROM {source} GROUP BY 1, 2" for mart, source, ts, amount in (
        ("orders", "o_orders", "created_at", "total"), ("vendor_orders", "o_vendor_orders", "created_at", "subtotal"),
        ("payments", "(SELECT * FROM s_periods WHERE kind = 'pay')", "period_start", "amount"))))
