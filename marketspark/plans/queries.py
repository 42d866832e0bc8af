"""Query registry: one callable (spark, sf_dir) -> DataFrame per inventory key.

Each query adapts the driver's tables (``sources.testdata``) and runs the
operators. Results are flat (nested values as ordered JSON text) so they
can be compared with the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import TestTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[TestTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(TestTables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import importlib
    for m in ("q_orders", "q_catalog", "q_subscriptions", "q_visibility", "q_promotions",
              "q_cart", "q_tracking", "q_registry", "q_quality", "q_expr", "q_streams"):
        importlib.import_module(f"{__package__}.{m}")
    return dict(QUERIES)
