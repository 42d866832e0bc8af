"""Cart and wishlist folds over event logs.

The browser keeps one cart per shopper and mutates it event by event.
Here the cart of every shopper is derived from the whole event log in
closed form, with aggregates and equi-joins only (no UDF, no per-user
window), so partial aggregation combines a hot shopper's events map-side
and AQE can split a skewed join partition.

Order of events: (ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as K

PICKER_MIN, PICKER_MAX = 1, 10


def _o():
    return F.struct("ts", "seq")


def cart_state(events: DataFrame) -> DataFrame:
    """Lines of every cart after the whole log.

    Rules: add increments an existing line or appends a new one (with the
    product snapshot of that add); set with qty <= 0 removes the line; set
    on an absent line does nothing; remove drops the line; clear empties
    the cart. Events without a user, or but for clears without a product,
    change nothing.

    Two facts make the fold an aggregate that merges in any order. What
    counts lies after the line's last reset, the later of its last removal
    (remove, or set <= 0) and its user's last clear. And of the positive sets
    only the line's last one can decide: where it lies before the reset, all
    do. So:
    1. marks, one row per (user, product): last add, last removal, last
       positive set with its value; and per user the last clear. Both are
       combined on the map side, so few rows move;
    2. the adds alone meet their line's marks, which is the one time that log
       rows are shuffled. The join key is the pair as one value, so the
       grouping after it has an exchange of its own: adaptive execution can
       split a hot line's join, and its parts are combined before they move;
    3. qty = value of the last set, if it came after the line's first add
       since the reset, plus the adds after it; else all adds since the reset.
    """
    line = F.struct("user_id", "product_id")
    e = events.filter(F.col("user_id").isNotNull()).withColumn("_o", _o())
    cleared = e.filter(F.col("kind") == "clear").groupBy("user_id").agg(F.max("_o").alias("_lc"))
    e = e.filter(F.col("product_id").isNotNull())
    is_add = F.col("kind") == "add"
    is_set = (F.col("kind") == "set") & (F.col("qty") > 0)
    removal = (F.col("kind") == "remove") | ((F.col("kind") == "set") & (F.col("qty") <= 0))
    marks = (e.filter(is_add | is_set | removal).groupBy("user_id", "product_id")
             .agg(F.max(F.when(is_add, F.col("_o"))).alias("_la"), F.max(F.when(removal, F.col("_o"))).alias("_lr"),
                  F.max(F.when(is_set, F.col("_o"))).alias("_ls"), F.max_by("qty", F.when(is_set, F.col("_o"))).alias("_sq"))
             .filter(F.col("_la").isNotNull())
             .join(cleared, "user_id", "left"))
    reset = F.greatest("_lr", "_lc")
    marks = (marks.select(line.alias("_line"), "_ls", "_sq", "_la", reset.alias("_reset"))
             .filter(F.col("_reset").isNull() | (F.col("_la") > F.col("_reset"))).drop("_la"))
    adds = (e.filter(is_add).select(line.alias("_line"), "_o", "qty", "snap").join(marks, "_line")
            .filter(F.col("_reset").isNull() | (F.col("_o") > F.col("_reset"))))
    after_set = F.col("_ls").isNull() | (F.col("_o") > F.col("_ls"))
    out = adds.groupBy(F.col("_line.user_id").alias("user_id"), F.col("_line.product_id").alias("product_id")).agg(
        F.min("_o").alias("_fa"), F.min_by("snap", "_o").alias("snap"), F.sum("qty").alias("_all"),
        F.sum(F.when(after_set, F.col("qty"))).alias("_tail"), F.max("_ls").alias("_ls"), F.max("_sq").alias("_sq"))
    qty = F.when(F.col("_ls") > F.col("_fa"), F.col("_sq") + F.coalesce(F.col("_tail"), F.lit(0))).otherwise(F.col("_all"))
    return out.select("user_id", "product_id", F.coalesce(qty, F.lit(0)).cast("int").alias("qty"),
                      F.col("_fa.ts").alias("added_at"), F.col("_fa.seq").alias("added_seq"), "snap")


def cart_totals(lines: DataFrame) -> DataFrame:
    """Item count and total per cart, on snapshot prices."""
    return lines.groupBy("user_id").agg(
        F.sum("qty").cast("bigint").alias("n_items"),
        F.sum(F.col("snap.price") * F.col("qty")).cast("decimal(38,2)").alias("total"),
        F.count(F.lit(1)).alias("n_lines"))


def cart_savings(lines: DataFrame) -> DataFrame:
    """Sum of (original or price) - price, times qty; shown when > 0."""
    orig = F.coalesce(F.nullif(F.col("snap.original_price"), F.lit(0)), F.col("snap.price"))
    s = lines.groupBy("user_id").agg(
        F.sum((orig - F.col("snap.price")) * F.col("qty")).cast("decimal(38,2)").alias("savings"))
    return s.withColumn("show_savings", F.col("savings") > 0)


def cart_by_vendor(lines: DataFrame) -> DataFrame:
    """C4: cart lines grouped by vendor (missing vendor -> 'store'),
    totals with qty defaulting to 1."""
    vendor = F.coalesce(F.nullif(F.col("snap.vendor"), F.lit("")), F.lit("store"))
    q = F.coalesce(F.col("qty"), F.lit(1))
    return lines.groupBy("user_id", vendor.alias("vendor")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("snap.price") * q).cast("decimal(38,2)").alias("total"))


def wishlist_state(events: DataFrame) -> DataFrame:
    """A product is in the wishlist when toggled an odd number of times;
    its place is the time of the last toggle."""
    g = events.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(_o()).alias("_last"))
    return (g.filter(F.col("_n") % 2 == 1)
             .select("user_id", "product_id", F.col("_last.ts").alias("added_at"),
                     F.col("_last.seq").alias("added_seq")))


def promo_code_check(uses: DataFrame) -> DataFrame:
    """Trimmed upper-case code equals SAVE10 -> valid. The cart total is
    not changed by it (the page ignores the flag), so only uses are counted."""
    code = F.upper(F.trim(F.coalesce(F.col("code"), F.lit(""))))
    return (uses.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_uses"))
                .withColumn("valid", F.col("code") == F.lit(K.PROMO_CODE)))


def clamp_qty(picks: DataFrame, col: str = "picked") -> DataFrame:
    """Quantity picker limited to 1..10 before it becomes an add."""
    return picks.withColumn("qty", F.greatest(F.lit(PICKER_MIN), F.least(F.lit(PICKER_MAX), F.col(col))))
