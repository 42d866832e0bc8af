"""What jobs leave on disk: no shuffle files behind a stored table, no used-up tables."""

import contextlib
import datetime as dt
import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows_of
from marketspark.operators import ranking as R
from marketspark.operators import tracking as E
from marketspark.session import checkpointed, discard, scratch_path, stored
from marketspark.sources.sinks import rewrite_days, write_mart
from marketspark.streaming import streams as M

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def _shuffles(spark):
    ids = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",")
    return set(ids.split(",")) - {""}


@contextlib.contextmanager
def _no_shuffle_left(spark):
    before = _shuffles(spark)
    yield
    assert _shuffles(spark) <= before


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _moved(spark):
    return spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.lit(T0).cast("timestamp_ntz").alias("ts")).repartition(5, "k")


def test_a_table_leaves_no_shuffle_files(spark):
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with _no_shuffle_left(spark):
        tables = stored(_moved(spark), "moved"), checkpointed(_moved(spark))
    assert rows_of(tables[0]) == rows_of(tables[1]) == rows_of(_moved(spark))
    files = [f.removeprefix("file://") for f in tables[0].inputFiles()]
    discard(tables[0])
    assert files and not any(os.path.exists(f) for f in files)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_a_mart_leaves_no_shuffle_files(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="ms-mart-"), "m")
    with _no_shuffle_left(spark):
        write_mart(_moved(spark), root, "k", "ts")
        rewrite_days(_moved(spark), root, "k", "ts")
    assert spark.read.parquet(root).count() == 2000


def test_rank_of_a_table_equals_sorted(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
                                  F.when(F.col("id") % 11 > 0, F.col("id") % 97).alias("k"), F.col("id").alias("i"))
    want = rows_of(df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")).cast("bigint")))
    for many in (10, 500, 100_000):         # with the null group among the large ones, too
        ranked = R.rank_stored(df, ["g"], ["k", "i"], many=many)
        assert rows_of(ranked) == want and ("ExistingRDD" in ranked._jdf.queryExecution().executedPlan().toString()) == (many < 3000)
    twice = df.select("g", "k").unionByName(df.select("g", "k"))
    assert rows_of(R.rank_stored(twice, ["g"], ["k"], many=500)) == rows_of(R.rank_within(twice, ["g"], ["k"]))
    assert R.rank_stored(df.limit(0), ["g"], ["k"]).count() == 0


def test_rows_of_a_table_move_once_to_be_ranked(spark):
    vo = stored(spark.range(50).selectExpr("'o' || id AS id", "'v' || id % 3 AS vendor_id", "'pending' AS status", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 9)) AS created_at"), "few")
    p = E.vendor_queue(vo, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange ") == 1
    assert rows_of(E.vendor_queue(vo, stored=True)) == rows_of(E.vendor_queue(vo))


def _runs_behind_tables(spark, entry, key):
    with _no_shuffle_left(spark):
        df = entry.queries()[key](spark, SMALL)
    assert "l_orderkey" not in _plan(df) and "_pid" not in _plan(df)
    return df


def test_my_orders_keeps_one_table(spark, entry):
    tables = scratch_path(spark, "")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    _runs_behind_tables(spark, entry, "my_orders")
    assert [x.split("-")[0] for x in set(os.listdir(tables)) - before] == ["updated"]


def test_marts_keep_one_table(spark, entry):
    for key in ("mart_vendor_queue", "mart_my_orders"):
        tables = scratch_path(spark, "")
        before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
        _runs_behind_tables(spark, entry, key)
        assert [x.split("-")[0] for x in set(os.listdir(tables)) - before] == ["mart"]


CHANGES = "order_key string, vendor_id string, seq long, ts timestamp_ntz, status string, status_note string, actor_role string, actor_vendor_id string"


def _changes(spark):
    rows = [(f"r{i % 17}" if i % 29 else None, f"v{i % 3}" if i % 23 else None, i, T0 + dt.timedelta(hours=i % 100), ("paid", "shipped", "odd")[i % 3],
             f"n{i}" if i % 4 else None, "admin", None) for i in range(400)]
    return spark.createDataFrame(rows, CHANGES)


def test_a_replay_keeps_its_tables_only(spark):
    ch = _changes(spark)
    latest = {}
    for restart in (True, False):
        base = M.replay_to_sink(ch, "status", "ts", M.stream_status, "update", restart=restart)
        assert os.listdir(base) == ["sink"] and len(os.listdir(f"{base}/sink")) >= 4
        for single in (True, False):
            latest[restart, single] = rows_of(M.read_latest(spark, f"{base}/sink", ["order_key", "vendor_id"], "a int", single).select("order_key", "vendor_id", "status", "status_note", "ts"))
    want = rows_of(M.stream_status(ch).dropna(subset=["order_key", "vendor_id"]))
    assert all(x == want for x in latest.values()) and len(want) > 30


def test_stream_status_ends_the_intake_first(spark, entry):
    df = entry.queries()["stream_status"](spark, SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in p and p.count("FileScan parquet") == 2         # the orders and the sink, once each
