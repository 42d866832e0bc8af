"""SparkSession helper with the settings every job here assumes."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "marketspark") -> SparkSession:
    """Build (or reuse) a session: AQE on (with skew-join splitting and
    broadcasts decided only on measured sizes), UTC, ANSI, UI off.

    On a cluster pass master=None and let spark-submit decide; the
    shuffle partition count then comes from the cluster config.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          # broadcast only what AQE has measured: no plan-time broadcasts from
          # size estimates (a compressed file can be far larger in memory)
          .config("spark.sql.autoBroadcastJoinThreshold", "-1")
          .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    A cluster sets spark.checkpoint.dir to a shared file system; only when
    it is unset do we make one under the local temp folder, and only in
    local mode: anywhere else an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="marketspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def _context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for intermediate tables."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "tables", name)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Jobs that start inside drop their shuffle files when they end. They are
    of use only to the job that wrote them, but would lie on the executors'
    disks until the driver's JVM happens to collect its handles. For jobs that
    leave a table or checkpoint behind, so that nothing needs the files again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df's reliable checkpoint, without the shuffle files that led to it."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)        # a new plan, as df's own was told before


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table under the shared checkpoint dir and read back:
    what led to it goes, and it can be read more than once."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that shuffles_end
    does not reach (a stream's): once their handles are collected, it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, path) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Delete a stored() table that nothing will read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete_folder(table.sparkSession, table.sparkSession.sparkContext._jvm.java.net.URI(folder))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (the runtime form of
    spark-submit --py-files): zip it once per application and addPyFile.
    Needed only by operators that run Python on executors (the pandas
    state functions of the streaming folds)."""
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="marketspark-pyfiles-"), "marketspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
