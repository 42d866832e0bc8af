"""Sinks (A6): marts laid out for the reads the shop makes.

Orders, vendor orders and subscription payments are read by vendor (or
user) and newest first. The layout does what the database indexes do:
files partitioned by day, rows sorted inside each file by the access key
and time (descending), so parquet min/max statistics prune both.
A range partitioning by (date, key, time) clusters each day's rows of one
key into few files; a key with a large part of a day spans several of them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_end


def _clustered(df: DataFrame, key: str, ts_col: str):
    out = df.withColumn("date", F.to_date(F.col(ts_col)))
    return (out.repartitionByRange("date", key, F.col(ts_col).desc())
            .sortWithinPartitions("date", key, F.col(ts_col).desc()).write.partitionBy("date"))


def write_mart(df: DataFrame, path: str, key: str, ts_col: str, mode: str = "overwrite") -> None:
    """Write `df` under `path`, partitioned by the day of `ts_col`,
    clustered by `key` and sorted by (key, ts desc) inside files."""
    with shuffles_end(df.sparkSession):
        _clustered(df, key, ts_col).mode(mode).parquet(path)


def rewrite_days(df: DataFrame, path: str, key: str, ts_col: str) -> None:
    """Replace the days that `df` has rows of, and leave the files of all
    other days as they are (dynamic partition overwrite). `df` holds those
    days whole; it may be derived from the mart itself, because the old files
    go only after the new ones are complete."""
    with shuffles_end(df.sparkSession):
        _clustered(df, key, ts_col).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_mart(spark: SparkSession, path: str, key: str | None = None, value: str | None = None,
              first_day: dt.date | None = None, last_day: dt.date | None = None) -> DataFrame:
    """A mart's rows, of one key value and of some days if given: days choose
    folders, the key is compared with the files' minima and maxima, so only
    the files that can hold such rows are read."""
    rows = spark.read.parquet(path)
    if first_day is not None:
        rows = rows.filter(F.col("date") >= F.lit(first_day))
    if last_day is not None:
        rows = rows.filter(F.col("date") <= F.lit(last_day))
    if key is not None:
        rows = rows.filter(F.col(key) == F.lit(value))
    return rows.drop("date")


def write_marts(root: str, orders: DataFrame, vendor_orders: DataFrame, payments: DataFrame,
                mode: str = "overwrite") -> dict[str, str]:
    """The three marts; returns their paths."""
    paths = {"orders": f"{root}/orders", "vendor_orders": f"{root}/vendor_orders",
             "payments": f"{root}/subscription_payments"}
    write_mart(orders, paths["orders"], "user_id", "created_at", mode)
    write_mart(vendor_orders, paths["vendor_orders"], "vendor_id", "created_at", mode)
    write_mart(payments, paths["payments"], "vendor_id", "period_start", mode)
    return paths
