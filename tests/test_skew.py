"""A hot key with a third of all rows: the ranking and the scan split it
over several tasks and stay exact."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketspark.operators import cart as C
from marketspark.operators import ranking as R

N = 30000


def _skewed(spark):
    # rows 0..9999 belong to vendor 'hot'; the rest spread over 500 vendors
    return spark.range(N).select(
        F.when(F.col("id") < N // 3, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 500).cast("string")))
         .alias("vendor"),
        ((F.col("id") * 7919) % 100003).alias("k"), F.col("id").alias("i"), (F.col("id") % 13).alias("d"))


def test_hot_group_is_split_across_range_partitions(spark):
    df = _skewed(spark)
    parts = (df.repartitionByRange(8, "vendor", "k", "i")
               .filter(F.col("vendor") == "hot")
               .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts >= 3


def test_rank_within_exact_under_skew(spark):
    ranked = R.rank_within(_skewed(spark), ["vendor"], ["k", "i"], num_partitions=8)
    hot = ranked.filter(F.col("vendor") == "hot")
    stats = hot.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count(F.lit(1))).first()
    assert tuple(stats) == (1, N // 3, N // 3, N // 3)
    # ranks follow (k, i) order exactly
    w = hot.select("k", "i", "rank").orderBy("k", "i").collect()
    assert [r["rank"] for r in w] == list(range(1, N // 3 + 1))


def test_extend_scan_exact_under_skew(spark):
    df = _skewed(spark).filter(F.col("vendor").isin("hot", "v1"))
    got = {r["i"]: r["end_us"] for r in
           R.extend_scan(df, ["vendor"], ["k", "i"], "k", "d", "end_us", num_partitions=8).collect()}
    rows = sorted(((r["vendor"], r["k"], r["i"], r["d"]) for r in df.collect()))
    want, end = {}, {}
    for v, k, i, d in rows:
        e = max(end.get(v, k), k) + d
        end[v] = e
        want[i] = e
    assert got == want


def test_cart_fold_with_one_hot_shopper(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")))
         .alias("user_id"),
        F.col("id").alias("seq"),
        (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("int"))).alias("ts"),
        F.when(F.col("id") % 97 == 0, F.lit("clear")).when(F.col("id") % 11 == 0, F.lit("remove"))
         .when(F.col("id") % 7 == 0, F.lit("set")).otherwise(F.lit("add")).alias("kind"),
        F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("product_id"),
        ((F.col("id") % 5) - 1).cast("int").alias("qty"),
        F.struct(F.lit("n").alias("name"), F.lit(Decimal("1.00")).alias("price"),
                 F.lit(None).cast("decimal(18,2)").alias("original_price"), F.lit("v").alias("vendor")).alias("snap"))
    got = {(r["user_id"], r["product_id"]): (r["qty"], r["added_seq"]) for r in C.cart_state(ev).collect()}
    carts = {}
    for r in sorted(ev.collect(), key=lambda r: (r["ts"], r["seq"])):
        lines = carts.setdefault(r["user_id"], {})
        k, p, q = r["kind"], r["product_id"], r["qty"]
        if k == "clear":
            lines.clear()
        elif k == "remove" or (k == "set" and q <= 0):
            lines.pop(p, None)
        elif k == "set":
            if p in lines:
                lines[p][0] = q
        elif p in lines:
            lines[p][0] += q
        else:
            lines[p] = [q, r["seq"]]
    want = {(u, p): tuple(v) for u, ls in carts.items() for p, v in ls.items()}
    assert got == want
