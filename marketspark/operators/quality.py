"""Data quality (J1-J5): the schema's constraints as batch checks.

A SQL CHECK passes on NULL, so a rule counts as violated only when its
condition is false. All rules of a table run in one pass: an array of
violated rule names per row, then one aggregate per (table, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K

C = F.col

# ---- fixed values: constraint rules per table -----------------------------
PROMO_TYPES = ("boutique", "product", "banner")
PROMO_PAYMENT = ("pending", "paid", "refunded")
PROMO_STATUS = ("draft", "active", "paused", "cancelled")
SUB_PLANS = ("trial", "launch", "monthly", "annual")
SUB_STATUS = ("trial", "active", "suspended", "cancelled")
PAY_PLANS = ("launch", "monthly", "annual")
PAY_STATUS = ("paid", "refunded")


def _items_ok() -> Column:
    """Null passes, as in SQL; any other text must be a non-empty array."""
    return F.when(C("items").isNotNull(), F.coalesce(K.json_array_size("items") > 0, F.lit(False)))


def rules() -> dict[str, list[tuple[str, Column]]]:
    return {
        "products": [("price_nonnegative", C("price") >= 0)],
        "orders": [("items_nonempty", _items_ok()),
                   ("total_nonnegative", C("total") >= 0),
                   ("status_valid", C("status").isin(*K.ORDER_STATUSES))],
        "vendor_orders": [("items_nonempty", _items_ok()),
                          ("subtotal_nonnegative", C("subtotal") >= 0),
                          ("status_valid", C("status").isin(*K.ORDER_STATUSES)),
                          ("note_length", C("status_note").isNull() | (F.char_length("status_note") <= 500))],
        "promotions": [("type_valid", C("promotion_type").isin(*PROMO_TYPES)),
                       ("dates_ordered", C("ends_at") > C("starts_at")),
                       ("amount_nonnegative", C("amount_paid") >= 0),
                       ("level_range", C("placement_level").between(1, 3)),
                       ("payment_valid", C("payment_status").isin(*PROMO_PAYMENT)),
                       ("status_valid", C("status").isin(*PROMO_STATUS)),
                       ("title_length", C("title").isNull() | (F.char_length("title") <= 100)),
                       ("subtitle_length", C("subtitle").isNull() | (F.char_length("subtitle") <= 240)),
                       ("target_valid",
                        ((C("promotion_type") == "boutique") & C("vendor_id").isNotNull() & C("product_id").isNull())
                        | ((C("promotion_type") == "product") & C("vendor_id").isNotNull() & C("product_id").isNotNull())
                        | ((C("promotion_type") == "banner") & C("product_id").isNull() & C("title").isNotNull()))],
        "subscriptions": [("plan_valid", C("plan").isin(*SUB_PLANS)),
                          ("status_valid", C("status").isin(*SUB_STATUS)),
                          ("period_ordered", C("access_ends_at") > C("current_period_start"))],
        "payments": [("plan_valid", C("plan").isin(*PAY_PLANS)),
                     ("amount_positive", C("amount") > 0),
                     ("period_ordered", C("period_end") > C("period_start")),
                     ("status_valid", C("payment_status").isin(*PAY_STATUS)),
                     ("notes_length", C("notes").isNull() | (F.char_length("notes") <= 500))],
    }


def violations(df: DataFrame, table: str) -> DataFrame:
    """Per row: the array of violated rules of `table`."""
    rs = rules()[table]
    arr = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rs]),
                   lambda x: x.isNotNull())
    return df.withColumn("violations", arr)


def check_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """Checked rows and violations per (table, rule)."""
    parts = []
    for table, df in tables.items():
        names = [n for n, _ in rules()[table]]
        v = violations(df, table).select("violations")
        agg = v.agg(F.count(F.lit(1)).alias("n_checked"),
                    *[F.count(F.when(F.array_contains("violations", n), 1)).alias(n) for n in names])
        parts.append(agg.select(F.lit(table).alias("table"), "n_checked", F.inline(F.array(
            *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in names]))))
    return reduce(DataFrame.unionByName, parts)


def check_unique(checks: dict[str, tuple[DataFrame, list[str], Column | None]]) -> DataFrame:
    """Duplicate keys: (check, key text, count) for every key seen twice
    or more. The count is a partial aggregation, so a hot key is combined
    map-side."""
    parts = []
    for name, (df, keys, where) in checks.items():
        d = df if where is None else df.filter(where)
        d = d.filter(reduce(lambda a, b: a & b, [C(k).isNotNull() for k in keys]))     # nulls are distinct
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(C("n") > 1)
        parts.append(g.select(F.lit(name).alias("check"), F.concat_ws("|", *[C(k).cast("string") for k in keys])
                              .alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def check_foreign_keys(checks: dict[str, tuple[DataFrame, list[tuple[str, DataFrame, str]]]]) -> DataFrame:
    """Orphans per reference: child rows whose non-null key has no
    parent. checks: child table -> (rows, [(key, parent rows, parent key)]).

    Every table is read once per role: a child gives all its keys side by side,
    counted per (reference, value) before they move, so a hot key becomes
    one row; a parent key column that several references name is made
    distinct once and answers for all of them. One join on (reference, value)
    decides all references. Keys are compared as text."""
    names, used, answers = [], [], {}
    for child, (df, refs) in checks.items():
        for ck, parent, pk in refs:
            names.append(f"{child}.{ck}")
            answers.setdefault((id(parent), pk), (parent, []))[1].append(f"{child}.{ck}")
        used.append(df.select(F.inline(F.array(*[F.struct(F.lit(f"{child}.{ck}").alias("check"), C(ck).cast("string").alias("_c"))
                                                 for ck, _, _ in refs]))).filter(C("_c").isNotNull()))
    keys = [parent.select(C(pk).cast("string").alias("_c")).filter(C("_c").isNotNull()).distinct()
            .select(F.explode(F.array(*[F.lit(n) for n in ns])).alias("check"), "_c").withColumn("_known", F.lit(True))
            for (_, pk), (parent, ns) in answers.items()]
    counted = reduce(DataFrame.unionByName, used).groupBy("check", "_c").agg(F.count(F.lit(1)).alias("n"))
    missing = (counted.join(reduce(DataFrame.unionByName, keys), ["check", "_c"], "left").filter(C("_known").isNull())
               .groupBy("check").agg(F.sum("n").alias("n")))
    spark = counted.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("check"))
    return every.join(missing, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n_orphans"))


def check_not_null(checks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Null counts of not-null columns, one pass per table."""
    parts = []
    for table, (df, cols) in checks.items():
        agg = df.agg(*[F.count(F.when(C(c).isNull(), 1)).alias(c) for c in cols])
        parts.append(agg.select(F.lit(table).alias("table"), F.inline(F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_nulls")) for c in cols]))))
    return reduce(DataFrame.unionByName, parts)


def reconcile_orders(orders: DataFrame, vendor_orders: DataFrame) -> DataFrame:
    """Per order, sum of vendor subtotals vs total, line counts, and
    whether every item of a vendor order belongs to that vendor."""
    items = F.from_json("items", "array<struct<id:string,vendor:string>>")
    vo = vendor_orders.select("order_id", "vendor_id", "subtotal", "n_items",
                              F.forall(items, lambda i: i["vendor"].eqNullSafe(C("vendor_id"))).alias("_own"))
    agg = vo.groupBy("order_id").agg(F.sum("subtotal").cast("decimal(38,2)").alias("sum_subtotals"),
                                     F.sum("n_items").alias("sum_items"),
                                     F.bool_and("_own").alias("items_match_vendor"))
    o = orders.select(C("id").alias("order_id"), "total", "n_items")
    j = o.join(agg, "order_id", "left")
    return j.select("order_id", "total", "sum_subtotals",
                    (C("total") == F.coalesce(C("sum_subtotals"), F.lit(0))).alias("totals_match"),
                    (C("n_items") == F.coalesce(C("sum_items"), F.lit(0))).alias("items_match"),
                    F.coalesce(C("items_match_vendor"), F.lit(False)).alias("items_match_vendor"))
