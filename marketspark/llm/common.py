"""Helpers shared by the operators: shared-folder tables, words, lines."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package


#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 rows can
#: take hundreds of megabytes in a Python worker.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, and keep their
    batches small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def settle() -> None:
    """Give memory that a finished task no longer needs back to the system:
    Python workers are reused, and their free memory counts as theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library: nothing to trim
        pass


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a Python worker keeps from one task of an operator to the next,
    such as a tokenizer and the words it has met."""
    return _kept.setdefault(owner, {})


def drop_kept(owner: str = "") -> None:
    """Drop what the worker keeps for operators other than owner: it is reused
    by later stages, for which that would be memory taken for nothing."""
    others = _kept.keys() - {owner}
    for o in others:
        del _kept[o]
    if others:
        settle()


def tidy(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """A mapInArrow or mapInPandas function that settles when it ends, and that
    starts without what other operators than owner have kept()."""
    def tidied(batches: Iterator) -> Iterator:
        drop_kept(owner)
        try:
            yield from run(batches)
        finally:
            settle()
    return tidied


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a parquet table under spark.checkpoint.dir
    and read it back. Lost executors do not lose it, its size is known to
    the planner, and later branches see exactly the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, os.path.join("llm", f"{name}-{uuid.uuid4().hex}"))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialize()d tables that nothing will read any more."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished phases: it
    does so once the driver's JVM has collected their handles."""
    import gc
    gc.collect()
    if spark.sparkContext._jvm is not None:
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_word_count(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """rows with the text column replaced by its number of words (null: 0),
    counted over UTF-8 bytes in Arrow batches."""
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*keep, name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
    return rows.select(text_col, *keep).mapInArrow(tidy(run), fields + f"`{name}` long")


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, doc_id, text) with a distinct ord that ascends as documents do:
    the id itself, or, where ids are null or repeated, a row's place in the
    order by (id, nulls last; text hash)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if rows.where(F.col("doc_id").isNull()).isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("ord"), "doc_id", "text")
    placed = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("ord", F.monotonically_increasing_id())
    return materialize(placed.select("ord", "doc_id", "text"), "ordered")


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges [start, start + len)."""
    total = int(lens.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    out_start = np.cumsum(lens) - lens
    return np.repeat(starts - out_start, lens) + np.arange(total, dtype=np.int64)


def text_slices(batch_texts: list, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Cut a list of byte strings into index ranges of about max_bytes, so
    that vectorised work is bounded; one longer text forms its own range."""
    lo = 0
    size = 0
    for i, t in enumerate(batch_texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > max_bytes:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(batch_texts):
        yield lo, len(batch_texts)
