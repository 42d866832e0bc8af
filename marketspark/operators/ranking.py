"""Ranking and prefix scans inside groups without a whole group in one task.

A plain `row_number() over (partition by g order by ...)` sends every row of
a group to one task; when one vendor or user holds a third of the rows that
task does a third of the work. Here instead:

1. `repartitionByRange(g, order...)` samples the keys, so a hot group is
   spread over many range partitions; rows are sorted inside partitions.
2. `monotonically_increasing_id` is then increasing in the global order; its
   upper bits are the partition index. It also tells rows with equal keys
   apart: repeated rows stay as many as they were, each with its own place.
3. A small aggregate gives, per (partition, group) run, what the run adds
   (its size, sums, last values); a window over those runs (at most one per
   partition for any group) gives what earlier runs carry into each.
4. Each row combines its place inside the run with the run's carry-in, after
   an equi join on (partition, group) - a key that is never skewed, because
   the partition index splits hot groups.

Steps 3 and 4 both read the sorted rows, and Spark does not reuse a range
exchange across two branches (each would sample its own bounds), so the sorted
rows are checkpointed once (reliable checkpoint in the folder named by
spark.checkpoint.dir; the session removes checkpoints that are no longer
used). The input is evaluated for that copy alone; nothing is joined back to
it. The number of range partitions is left to AQE, which sizes them by bytes.

`top_k_per_group` keeps the k first rows per group. It is a filter on
`row_number() <= k`, which Catalyst plans with a partial
WindowGroupLimit before the exchange: each map task forwards at most k
rows per group, so even a hot group shuffles only k x tasks rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _sorted_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    """df over range partitions sorted by (group, order), with _mid ascending
    in the global order and _pid the partition; checkpointed."""
    names = [f"_k{i}" for i in range(len(order))]
    df = df.withColumns(dict(zip(names, _cols(order))))
    cols = [*(F.col(g) for g in group), *(F.col(n) for n in names)]
    s = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    s = s.sortWithinPartitions(*cols).drop(*names).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    return checkpointed(s)


def _with_carry(rows: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows with the columns of their (partition, group) run; null groups are
    groups, too."""
    keys = ["_pid", *group]
    f = carry.withColumnsRenamed({k: f"_f_{k}" for k in keys})
    on = [rows[k].eqNullSafe(f[f"_f_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(f, cond).drop(*[f"_f_{k}" for k in keys])


def _run_windows(group: Sequence[str]):
    """(rows of a run up to the current one, earlier runs of the group, all
    its runs in order)."""
    own = Window.partitionBy("_pid", *group).orderBy("_mid")
    runs = Window.partitionBy(*group).orderBy("_pid")
    return own, runs.rowsBetween(Window.unboundedPreceding, -1), runs


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add `rank_col` = 1-based position of each row inside its group by
    `order`. Rows equal in group and order get places next to each other, in
    no particular order among them."""
    g = list(group)
    s = _sorted_rows(df.drop(rank_col), g, order, num_partitions)
    _, earlier, _ = _run_windows(g)
    runs = s.groupBy("_pid", *g).agg(F.min("_mid").alias("_start"), F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = _with_carry(s, runs, g)
    return (ranked.withColumn(rank_col, (F.col("_mid") - F.col("_start") + 1 + F.col("_off")).cast("bigint"))
            .drop("_mid", "_pid", "_start", "_off"))


MANY = 100_000      # rows of a group that one task may sort


def rank_stored(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                rank_col: str = "rank", many: int = MANY) -> DataFrame:
    """rank_within for a df that is cheap to evaluate again, as a stored table
    is. Its groups are counted first; those of up to `many` rows are sorted by
    a task each, so their rows move once and are not kept. Only the larger
    groups go through rank_within. They are no more than rows / many, so their
    keys are broadcast."""
    g = list(group)
    df = df.drop(rank_col)
    hot = checkpointed(df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > many).drop("_n"))
    w = Window.partitionBy(*g).orderBy(*_cols(order))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    if hot.isEmpty():
        return ranked(df)
    keys = F.broadcast(hot.withColumnsRenamed({k: f"_f_{k}" for k in g}))
    on = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in g]
    return ranked(df.join(keys, on, "left_anti")).unionByName(rank_within(df.join(keys, on, "left_semi"), g, order, rank_col))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Keep the first k rows of each group, with their 1-based rank."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def extend_scan(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                t_col: str, d_col: str, out_col: str = "end_us", num_partitions: int | None = None,
                last: dict[str, Column] | None = None, following: dict[str, str] | None = None,
                placed: bool = False) -> DataFrame:
    """Running `end = max(end_prev, t) + d` inside each group, in `order`.

    Closed form: with S the running sum of d, end_i = S_i + max_{k<=i}(t_k - S_{k-1}).
    (S, M) pairs combine associatively - segment A then B gives
    S = S_A + S_B and M = max(M_A, M_B - S_A) - so the scan runs as a
    segmented parallel prefix: range partitions of the sorted data compute
    local prefixes, one small table of per-(partition, group) totals gives
    each run its carry-in, and a hot group spans many tasks.
    `t_col` and `d_col` are longs (microseconds); nulls in d count as 0.

    On the same sorted rows, `last` adds columns holding the latest non-null
    value of an expression up to the current row, and `following` the value
    of a (never null) column in the group's next row, null for its last.
    `placed` says that df, or what it was filtered from, is already sorted
    and cut off its lineage: its columns _pid and _mid are used as they are.
    """
    g, last, following = list(group), last or {}, following or {}
    extra = {f"_l_{n}": c for n, c in last.items()}
    d = F.coalesce(F.col(d_col), F.lit(0)).cast("long")
    rows = df.drop(out_col).withColumns({"_t": F.col(t_col), "_d": d, **extra})
    s = rows if placed else _sorted_rows(rows, g, order, num_partitions)
    own, earlier, runs_in_order = _run_windows(g)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_sl", F.sum("_d").over(so_far))
    s = s.withColumn("_ml", F.max(F.col("_t") - (F.col("_sl") - F.col("_d"))).over(so_far))
    s = s.withColumns({f"_o_{n}": F.last(n, ignorenulls=True).over(so_far) for n in extra})
    s = s.withColumns({f"_n_{n}": F.lead(c).over(own) for n, c in following.items()})
    runs = s.groupBy("_pid", *g).agg(
        F.sum("_d").alias("_sr"), F.max("_ml").alias("_mr"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_mid"))).alias(f"_r{n}") for n in extra],
        *[F.min_by(c, "_mid").alias(f"_first_{n}") for n, c in following.items()])
    runs = runs.withColumn("_sb", F.coalesce(F.sum("_sr").over(earlier), F.lit(0)))
    # each earlier run's maximum is shifted by that run's own carry-in
    runs = runs.withColumn("_mb", F.max(F.col("_mr") - F.col("_sb")).over(earlier))
    runs = runs.withColumns({f"_c{n}": F.last(f"_r{n}", ignorenulls=True).over(earlier) for n in extra})
    runs = runs.withColumns({f"_next_{n}": F.lead(f"_first_{n}").over(runs_in_order) for n in following})
    carried = ["_sb", "_mb", *[f"_c{n}" for n in extra], *[f"_next_{n}" for n in following]]
    ends = _with_carry(s, runs.select("_pid", *g, *carried), g)
    m = F.greatest(F.col("_mb"), F.col("_ml") - F.col("_sb"))
    out = ends.withColumns({
        out_col: F.col("_sb") + F.col("_sl") + m,
        **{n: F.coalesce(F.col(f"_o__l_{n}"), F.col(f"_c_l_{n}")) for n in last},
        **{n: F.coalesce(F.col(f"_n_{n}"), F.col(f"_next_{n}")) for n in following}})
    return out.select(*[c for c in df.columns if c not in (out_col, *last, *following)], out_col, *last, *following)


def transition_scan(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], step: Column, n_states: int,
                    start: int = 0, out_col: str = "state", num_partitions: int | None = None, keep_place: bool = False) -> DataFrame:
    """The state before each row when the rows of a group, in `order`, move a
    small state 0 .. n_states - 1 that begins with `start`. `step` is the
    row's transition: an array with the next state for each state.

    Transitions compose associatively (an array of n_states states again), so
    the scan is split like the others: every (partition, group) run composes
    its rows into one transition, the small table of runs composes those in
    order into each run's first state, and a second pass over the sorted rows
    gives the states. Rows pass through Arrow in sorted batches; a worker
    holds one transition or state, never a run. `keep_place` leaves the rows'
    places (_pid, _mid) in the result, for a later scan in the same order.
    """
    g = list(group)
    s = _sorted_rows(df.drop(out_col).withColumn("_step", step), g, order, num_partitions)
    _, earlier, runs_in_order = _run_windows(g)
    runs = s.groupBy("_pid", *g).agg(F.min("_mid").alias("_run"))       # a run's number is the place of its first row
    runs = runs.withColumn("_ends", F.lead("_pid").over(runs_in_order).isNull())
    # only runs that go on in the next partition hand a transition on
    open_rows = _with_carry(s.select("_pid", *g, "_mid", "_step"), runs.filter(~F.col("_ends")), g)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, moved = None, list(range(n_states))
        done: list[tuple[int, list[int]]] = []
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if r != run:
                    if run is not None:
                        done.append((run, moved))
                    run, moved = r, list(range(n_states))
                moved = [t[x] for x in moved]
        if run is not None:
            done.append((run, moved))       # a partition's runs, at most one of a group
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int32()))], names=["_run", "_moved"])

    moved = (open_rows.select("_run", "_mid", "_step").repartition("_run").sortWithinPartitions("_run", "_mid")
             .mapInArrow(compose, "_run long, _moved array<int>"))
    carry = runs.join(moved, "_run", "left").withColumn("_before", F.collect_list("_moved").over(earlier))
    carry = carry.select("_pid", *g, "_run", F.aggregate("_before", F.lit(start), lambda at, f: F.element_at(f, at + 1)).alias("_first"))
    ready = _with_carry(s, carry, g).repartition("_run").sortWithinPartitions("_run", "_mid")
    keep = [c for c in df.columns if c != out_col] + (["_pid", "_mid"] if keep_place else [])
    ready = ready.select("_run", "_step", "_first", *keep)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = None, start
        for b in batches:
            before = []
            for r, t, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r != run:
                    run, at = r, first
                before.append(at)
                at = t[at]
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(before, pa.int32())], names=[*keep, out_col])

    schema = T.StructType([*ready.select(*keep).schema.fields, T.StructField(out_col, T.IntegerType())])
    return ready.mapInArrow(states, schema)
