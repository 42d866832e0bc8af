"""Marts are partitioned by day and read back whole."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from helpers import rows_of
from marketspark.operators import orders as O
from marketspark.operators import subscriptions as H
from marketspark.sources import loaders as L
from marketspark.sources.sinks import read_mart, rewrite_days, write_mart, write_marts
from marketspark.sources.testdata import TestTables

SMALL = "/root/testdata/sf0.001"


def test_write_marts_round_trip(spark):
    t = TestTables(spark, SMALL)
    it = O.intake(t.order_requests(), L.normalize_products(t.products()))
    c = H.classify_events(t.subscription_events())
    pays = H.renewal_periods(c).filter(F.col("kind") == "pay").select(
        "vendor_id", "seq", "plan", "amount", "period_start", "period_end")
    root = tempfile.mkdtemp(prefix="ms-marts-")
    paths = write_marts(root, it.orders(), it.vendor_orders(), pays)
    assert any(d.startswith("date=") for d in os.listdir(paths["vendor_orders"]))
    back = spark.read.parquet(paths["vendor_orders"]).drop("date")
    assert rows_of(back.select(*it.vendor_orders().columns)) == rows_of(it.vendor_orders())
    assert spark.read.parquet(paths["payments"]).count() == pays.count()


def _mart(spark, root):
    rows = spark.range(4000).select(
        F.concat(F.lit("k"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("key"), F.col("id").alias("n"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(id % 10), int(id % 24))").alias("ts"))
    write_mart(rows, root, "key", "ts")
    return rows


def _files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_marts_are_read_by_day_and_key(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="ms-mart-"), "m")
    rows = _mart(spark, root)
    got = read_mart(spark, root, "key", "k07", dt.date(2024, 1, 3), dt.date(2024, 1, 8))
    want = rows.where("key = 'k07' and date(ts) between '2024-01-03' and '2024-01-08'")
    assert rows_of(got) == rows_of(want) and want.count() > 0
    scan = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x]
    assert len(scan) == 1 and "PartitionFilters: [isnotnull(date" in scan[0] and "EqualTo(key,k07)" in scan[0]
    assert len(got.inputFiles()) > 0 and read_mart(spark, root, "key", "none").count() == 0


def test_rewriting_days_leaves_other_days_alone(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="ms-mart-"), "m")
    rows = _mart(spark, root)
    before = _files(root)
    day = F.to_date("ts") == F.lit(dt.date(2024, 1, 4))
    new = read_mart(spark, root).where(day).withColumn("n", F.col("n") + 1_000_000)      # from the mart itself
    rewrite_days(new, root, "key", "ts")
    assert {f for f in before - _files(root)} == {f for f in before if "date=2024-01-04" in f}
    assert rows_of(read_mart(spark, root)) == rows_of(rows.withColumn("n", F.when(day, F.col("n") + 1_000_000).otherwise(F.col("n"))))
    rewrite_days(new.limit(0), root, "key", "ts")
    assert read_mart(spark, root).count() == 4000
