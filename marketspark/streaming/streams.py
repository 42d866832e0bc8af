"""Structured Streaming forms of the batch operators (M1-M6).

Semantics are those of the batch twins; tests check that a stream over
several micro-batches gives the batch result over their union.

Sources: any streaming DataFrame with the batch schema (Kafka, a file
source, a table). `replay_to_sink` runs a job on a real file source for
tests and benchmarks: the table is split by time into file sets once, and
after each set is appended to the source folder the job runs on what is new.
Files keep the table's own parallelism; rows without a time come first.

Sinks are written per micro-batch with foreachBatch into
<base>/<table>/batch_id=<n>, overwriting that folder, so a replayed batch
after a failure rewrites the same output (idempotent). Beside the main table
"sink" a job may write side tables ("rejected", "late"). State and offsets
live in the query's checkpoint location, also under spark.checkpoint.dir.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import inspect
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import promotions as G
from ..session import delete_folder, release, scratch_path, ship_package
from .stateful import CART_OUT, SUB_OUT, Cart, Ledger

# ---- replay and sink helpers ------------------------------------------------

Batch = DataFrame | dict[str, DataFrame]


@dataclass
class Past:
    """What earlier micro-batches of a job wrote: a replayed batch sees the
    same past, as its own folder does not belong to it."""
    spark: SparkSession
    base: str
    batch_id: int
    held: list[DataFrame] = field(default_factory=list)

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.base}/{name}"
        if not folder_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{schema}, batch_id long").option("basePath", path).parquet(path)
        return read.filter(F.col("batch_id") < self.batch_id).drop("batch_id")

    def hold(self, df: DataFrame) -> DataFrame:
        """Keep df until the batch's tables are written."""
        self.held.append(df.persist())
        return df


def folder_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


Transform = Callable[[DataFrame], Batch] | Callable[[DataFrame, Past], Batch]


def _sink_writer(base: str, transform: Transform | None = None):
    """Write a micro-batch's tables. A transform of two arguments also gets
    the job's Past."""
    def write(batch: DataFrame, batch_id: int) -> None:
        def put(table: str, df: DataFrame) -> None:
            df.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
                f"{base}/{table}/batch_id={batch_id}")

        if transform is None:
            put("sink", batch)
            return
        past = Past(batch.sparkSession, base, batch_id)
        past.hold(batch)              # several tables are written from one evaluation
        try:
            out = transform(batch, past) if len(inspect.signature(transform).parameters) > 1 else transform(batch)
            for table, df in (out if isinstance(out, dict) else {"sink": out}).items():
                put(table, df)
        finally:
            for df in past.held:
                df.unpersist()
    return write


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB):
    """The state store of queries started inside: a query takes the setting
    over when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run_to_sink(stream: DataFrame, base: str, output_mode: str = "append",
                transform: Transform | None = None) -> None:
    """Run `stream` on what its source holds that is new (availableNow). State
    is kept in RocksDB, which the keyed state of M2 and M3 needs; the
    session's own choice of store is put back."""
    with state_store(stream.sparkSession):
        q = _writer(stream, base, output_mode, transform).trigger(availableNow=True).start()
    q.awaitTermination()


def _writer(stream: DataFrame, base: str, output_mode: str, transform: Transform | None):
    return (stream.writeStream.outputMode(output_mode)
            .option("checkpointLocation", f"{base}/_checkpoint")
            .foreachBatch(_sink_writer(base, transform)))


def replay_to_sink(df: DataFrame, name: str, ts_col: str, build: Callable[[DataFrame], DataFrame],
                   output_mode: str = "append", transform: Transform | None = None,
                   n_batches: int = 4, restart: bool = True) -> str:
    """Feed df to the job `build(stream)` in n time-ordered file sets and
    return the folder of its tables. The table is scanned once, and what was
    fed and the job's checkpoint go when they are used up.

    Every set is a run of its own, and each run loads the state anew beside
    the copies of the runs before. With restart=False one run takes all sets
    and holds the state once. It may see a set in parts: for jobs to which the
    order of events means nothing."""
    spark = df.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    timed = df.withColumn("_us", _us(ts_col))
    lo, hi = timed.agg(F.min("_us"), F.max("_us")).first()
    span = max(1, (hi or 0) - (lo or 0) + 1)
    part = F.coalesce(F.floor((F.col("_us") - F.lit(lo or 0)) * n_batches / F.lit(span)), F.lit(0)).cast("int")
    timed.withColumn("_part", part).drop("_us").write.partitionBy("_part").parquet(f"{base}/parts")
    running = None
    try:
        for i in range(n_batches):
            if not folder_exists(spark, f"{base}/parts/_part={i}"):
                continue
            spark.read.schema(df.schema).parquet(f"{base}/parts/_part={i}").write.mode("append").parquet(f"{base}/source")
            delete_folder(spark, f"{base}/parts/_part={i}")
            if running is not None:
                running.processAllAvailable()
                continue
            stream = build(spark.readStream.schema(df.schema).parquet(f"{base}/source"))
            if restart:
                run_to_sink(stream, base, output_mode, transform)
                continue
            with state_store(spark):
                running = _writer(stream, base, output_mode, transform).start()
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    for used_up in ("parts", "source", "_checkpoint"):
        delete_folder(spark, f"{base}/{used_up}")
    release(spark)
    return base


def read_latest(spark: SparkSession, sink: str, keys: list[str], schema: str, single: bool = False) -> DataFrame:
    """Rows of the last micro-batch that emitted each key (update mode); keys
    with a null are left out. A stream without input has written no folder: no
    rows. `single` says that a batch emits a key at most once: the rows then
    move once, not for their key's last batch and again to meet it."""
    if not folder_exists(spark, sink):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(sink)
    if single:
        values = F.struct(*[c for c in df.columns if c not in (*keys, "_batch", "batch_id")])
        return df.dropna(subset=keys).groupBy(*keys).agg(F.max_by(values, "_batch").alias("_r")).select(*keys, "_r.*")
    last = df.groupBy(*keys).agg(F.max("_batch").alias("_last"))
    return (df.join(last, keys).filter(F.col("_batch") == F.col("_last"))
              .drop("_batch", "_last", "batch_id"))


def read_all(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    if not folder_exists(spark, sink):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(sink).drop("_batch", "batch_id")


# ---- M1: order intake -------------------------------------------------------


SEEN = "request_id string, requested_at timestamp_ntz, _batch long"
KEEP_DAYS = 30


def stream_order_intake(requests: DataFrame) -> DataFrame:
    """M1: the request stream, to be passed to `run_to_sink` with
    `intake_batch(...)` as transform. De-duplication is done there and not by
    dropDuplicatesWithinWatermark, which drops what arrives behind its
    watermark: here every request ends up in a table."""
    return requests


def intake_batch(products: DataFrame, live: DataFrame | None = None, keep_days: int = KEEP_DAYS) -> Callable[[DataFrame, Past], Batch]:
    """M1 per micro-batch: the batch intake over requests not seen before.

    Tables: `sink` (vendor orders), `rejected` (with the reason), `repeated`
    (a request_id that came before, or twice in this batch: retried calls),
    `late` (dated over keep_days behind the newest request of earlier
    batches: whether it came before is no longer known, so it is set aside
    whole, not placed), and `seen`, the job's memory: id and time of each
    request taken. A request without a time counts as new, never as late.

    A batch reads the part of `seen` not older than its horizon, which prunes
    the Parquet scan by time; the newest time of earlier batches comes from
    the same table's file statistics. The screened requests and their lines
    are computed once and held while the tables are written from them."""
    def f(batch: DataFrame, past: Past) -> Batch:
        seen = past.table("seen", SEEN).drop("_batch")
        newest = seen.agg(F.max("requested_at")).first()[0]
        horizon = None if newest is None else newest - dt.timedelta(days=keep_days)
        at = F.col("requested_at")
        is_late = F.lit(False) if horizon is None else F.coalesce(at < F.lit(horizon), F.lit(False))
        marked = batch.withColumn("_late", is_late)
        on_time = marked.filter(~F.col("_late")).drop("_late")
        known = seen.select("request_id", "requested_at") if horizon is None else seen.filter(at.isNull() | (at >= F.lit(horizon)))
        known = known.select("request_id").distinct().withColumn("_known", F.lit(True))
        # of equal ids in one batch the first by time is taken; the hash orders rows of the same time
        order = Window.partitionBy("request_id").orderBy(at.asc_nulls_first(), F.xxhash64(*batch.columns))
        split = past.hold(on_time.withColumn("_nth", F.row_number().over(order)).join(known, "request_id", "left"))
        fresh_row = (F.col("_nth") == 1) & F.col("_known").isNull()
        fresh = split.filter(fresh_row).drop("_nth", "_known")
        screened = past.hold(O.screen_requests(fresh))
        it = O.Intake(screened=screened, matched=past.hold(O.matched_lines(screened, products, live).select(*O.MATCHED_COLS)), requests=fresh)
        return {"sink": it.vendor_orders(), "rejected": it.rejected(),
                "repeated": split.filter(~fresh_row).drop("_nth", "_known"),
                "late": marked.filter("_late").drop("_late"),
                "seen": fresh.select("request_id", "requested_at")}
    return f


def _us(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


# ---- M2: cart state ----------------------------------------------------------

def stream_cart_state(events: DataFrame) -> DataFrame:
    """M2: changes of the carts' lines, with one state entry per (user,
    product). Events without a user, or but for clears without a product,
    change nothing (C1). No timeout: an entry lives as long as its line."""
    ship_package(events.sparkSession)
    e = events.filter(F.col("user_id").isNotNull() & ((F.col("kind") == "clear") | F.col("product_id").isNotNull()))
    return (e.select("user_id", _us("ts").alias("us"), "seq", "kind", "product_id", F.col("qty").cast("double").alias("qty"), "snap.name",
                     F.col("snap.price").cast("decimal(18,2)").alias("price"),
                     F.col("snap.original_price").cast("decimal(18,2)").alias("original_price"), "snap.vendor")
             .groupBy("user_id").transformWithState(Cart(), CART_OUT, "Update", "None"))


def read_carts(spark: SparkSession, sink: str) -> DataFrame:
    """The lines that the cart job's table stands for: each line's last row,
    unless the user's cart was cleared in a later batch."""
    if not folder_exists(spark, sink):
        return spark.createDataFrame([], CART_OUT)
    rows = spark.read.parquet(sink)
    # a clear is its user's row without product; the last row per line, marked with its user's last clear
    cleared = rows.filter(F.col("row_kind") == "clear").groupBy("user_id").agg(F.max("_batch").alias("_cleared"))
    line = rows.filter(F.col("row_kind") != "clear").groupBy("user_id", "product_id").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in ("user_id", "product_id", "batch_id")]), "_batch").alias("r"))
    return (line.join(cleared, "user_id", "left").select("user_id", "product_id", "r.*", "_cleared")
                .filter((F.col("row_kind") == "line") & (F.col("_cleared").isNull() | (F.col("_batch") >= F.col("_cleared"))))
                .drop("_batch", "_cleared"))


def cart_batch(batch: DataFrame) -> Batch:
    """Changed lines, and beside them the events that came too late to be
    applied."""
    late = F.col("row_kind") == "late"
    return {"sink": batch.filter(~late), "late": batch.filter(late)}


# ---- M3: subscription ledger ---------------------------------------------------

LEDGER_DELAY = "7 days"


def stream_subscriptions(events: DataFrame, delay: str = LEDGER_DELAY) -> DataFrame:
    """M3: subscription row per vendor as of the watermark, which runs
    `delay` behind the newest event. Events without a vendor are clock ticks:
    they advance the watermark, so a quiet ledger is applied to its end. (The
    state passes them over; a filter would be pushed below the watermark.)

    The watermark's own column is dropped before the state: the engine then
    drops no rows by it, and late events come out as rows."""
    ship_package(events.sparkSession)
    return (events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay).drop("_at")
                  .select("vendor_id", _us("ts").alias("us"), "seq", "kind", "plan", "days")
                  .groupBy("vendor_id").transformWithState(Ledger(), SUB_OUT, "Update", "EventTime"))


def tick(events: DataFrame, days: int = 8) -> DataFrame:
    """A clock tick `days` after the newest event."""
    at = events.agg((F.max("ts") + F.make_dt_interval(F.lit(days))).alias("ts"))
    return at.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def ledger_batch(batch: DataFrame) -> Batch:
    """Subscription rows, and beside them the events that came too late."""
    late = F.col("row_kind") == "late"
    return {"sink": batch.filter(~late).drop("row_kind", "late_seq", "late_kind"),
            "late": batch.filter(late).select("vendor_id", "plan", F.col("updated_at").alias("ts"), "late_seq", "late_kind")}


# ---- M4, M5: streaming aggregates in update mode --------------------------------


def stream_status(changes: DataFrame) -> DataFrame:
    """M4: latest accepted status change per vendor order (streaming
    max; the state is one row per vendor order). `tracking.set_latest`
    applies them to the vendor orders."""
    from ..operators.tracking import MAX_NOTE
    from ..functions import expr as K
    ok = (changes.filter(F.col("status").isin(*K.ORDER_STATUSES)
                         & (F.col("status_note").isNull() | (F.char_length("status_note") <= MAX_NOTE))
                         & ((F.col("actor_role") == "admin")
                            | ((F.col("actor_role") == "vendor") & (F.col("actor_vendor_id") == F.col("vendor_id"))))))
    return (ok.groupBy("order_key", "vendor_id")
              .agg(F.max(F.struct("ts", "seq", "status", "status_note")).alias("c"))
              .select("order_key", "vendor_id", "c.status", "c.status_note", "c.ts"))


def stream_wishlist(events: DataFrame) -> DataFrame:
    """M5: toggle count and last toggle per (user, product)."""
    return (events.groupBy("user_id", "product_id")
                  .agg(F.count(F.lit(1)).alias("n_toggles"), F.max(F.struct("ts", "seq")).alias("last")))


def wishlist_from_counts(counts: DataFrame) -> DataFrame:
    return (counts.filter(F.col("n_toggles") % 2 == 1)
                  .select("user_id", "product_id", F.col("last.ts").alias("added_at"),
                          F.col("last.seq").alias("added_seq")))


# ---- M6: stream-static interval join ---------------------------------------------


def stream_promo_tag(views: DataFrame, promotions: DataFrame) -> DataFrame:
    """M6: impressions tagged with live promotions as views arrive (the
    promotions side is static)."""
    return G.promo_impressions(views, promotions)


__all__ = ["replay_to_sink", "run_to_sink", "state_store", "folder_exists", "read_latest", "read_all", "stream_order_intake", "intake_batch",
           "stream_cart_state", "read_carts", "cart_batch", "tick", "stream_subscriptions", "ledger_batch", "stream_status", "stream_wishlist",
           "wishlist_from_counts", "stream_promo_tag"]
