"""Data-quality queries: J1-J4 over the raw tables, J5 over built orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import quality as J
from ..operators import subscriptions as H
from ..session import scratch_path
from ..sources import loaders as L
from ..sources.raw_sql import NOT_NULL, REFERENCES, UNIQUE
from ..sources.sinks import write_marts
from .inputs import intake
from .queries import query


@query("check_rules")
def q_check_rules(t):
    """Rows checked and rule violations per table and rule."""
    return J.check_rules({name: t.raw_table(name) for name in J.rules()})


@query("check_unique")
def q_check_unique(t):
    """Duplicate keys across the marketplace tables."""
    return J.check_unique({f"{table}.{'_'.join(keys)}": (t.raw_table(table), keys, F.expr(where) if where else None)
                           for table, keys, where in UNIQUE})


@query("check_foreign_keys")
def q_check_foreign_keys(t):
    """Orphan counts per reference."""
    tables = {name: t.raw_table(name) for name in {*REFERENCES, *(parent for refs in REFERENCES.values() for _, parent, _ in refs)}}
    return J.check_foreign_keys({child: (tables[child], [(ck, tables[parent], pk) for ck, parent, pk in refs])
                                 for child, refs in REFERENCES.items()})


@query("check_not_null")
def q_check_not_null(t):
    """Nulls in not-null columns."""
    return J.check_not_null({table: (t.raw_table(table), cols) for table, cols in NOT_NULL.items()})


@query("reconcile_orders")
def q_reconcile_orders(t):
    """Orders reconciled with their vendor orders."""
    it = intake(t).keep()
    return J.reconcile_orders(it.orders(), it.vendor_orders())


@query("write_marts")
def q_write_marts(t):
    """Orders, vendor orders and payments written as marts; the rows and
    amounts of each mart and day as read back."""
    it = intake(t).keep()
    pays = H.renewal_periods(H.classify_events(t.subscription_events())).filter(F.col("kind") == "pay")
    paths = write_marts(scratch_path(t.spark, f"marts-{uuid.uuid4().hex}"), it.orders(), it.vendor_orders(),
                        pays.select("vendor_id", "seq", "plan", "amount", "period_start", "period_end"))
    out = None
    for mart, amount in (("orders", "total"), ("vendor_orders", "subtotal"), ("payments", "amount")):
        m = (t.spark.read.parquet(paths[mart]).groupBy(F.lit(mart).alias("mart"), F.col("date").cast("string").alias("day"))
             .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(amount).cast("decimal(38,2)").alias("amount")))
        out = m if out is None else out.unionByName(m)
    return out
