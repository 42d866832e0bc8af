"""Connected components of a link table, for tables of any size.

Links are contracted inside tasks to spanning stars, then alternating
large-star and small-star steps run until nothing changes. Every step is an
aggregate and a join on node ids: a hub with a third of all links is
pre-aggregated before its minimum is shuffled and its join side is split by
the adaptive skew join. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, tidy

_BATCH = 500_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) for every node that is
    not the smallest, by min-label propagation with pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    u, v = inv[:n], inv[n:]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        lo, hi = np.minimum(pu, pv), np.maximum(pu, pv)
        live = lo != hi
        if not live.any():
            break
        np.minimum.at(parent, hi[live], lo[live])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        u, v = u[live], v[live]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _contract(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0

        def star():
            x, y = local_components(np.concatenate(a), np.concatenate(b))
            return x, y

        for batch in batches:
            if batch.num_rows == 0:
                continue
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n > _BATCH:
                x, y = star()
                if len(x) > _BATCH // 2:        # hardly any repetition: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                    a, b, n = [], [], 0
                else:
                    a, b, n = [x], [y], len(x)
        if a:
            x, y = star()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, component): for every node in a
    link, the smallest node reachable. Null or self links are ignored."""
    ship(links.sparkSession)
    e = materialize(_contract(links.where("a <> b")).distinct(), "cc-links")   # a > b: a points down to b
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = materialize(large, "cc-large")
        # small star: smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where("a <> b").distinct())
        small = materialize(small, "cc-small")
        # done when every link points at a root (a node that points nowhere) and has one target
        pending = small.select(F.col("b").alias("a")).join(small.select("a").distinct(), "a", "left_semi").limit(1).count()
        e = small
        if pending == 0 and small.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
