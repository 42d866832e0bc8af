"""Plan checks: no pairing joins, no Python in batch plans, pruned scans."""

import pytest

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _batch_keys():
    import __spark_entry__ as E
    return sorted(k for k in E.queries() if not k.startswith("stream_"))


@pytest.mark.parametrize("key", _batch_keys())
def test_no_cartesian_no_python(spark, entry, key):
    p = _plan(entry.queries()[key](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_reads_only_needed_columns(spark, entry):
    p = _plan(entry.queries()["filter_max_price"](spark, SMALL))
    scans = [l for l in p.split("\n") if "FileScan parquet" in l and "part.parquet" in l]
    assert scans and all("p_name" not in l and "p_brand" not in l for l in scans)


def test_catalogue_join_pushes_in_stock_filter(spark, entry):
    from marketspark.operators import orders as O
    from marketspark.sources.loaders import load_products, normalize_products  # noqa: F401
    df = spark.read.parquet(f"{SMALL}/part.parquet").selectExpr(
        "concat('p', p_partkey) AS id", "'v1' AS vendor", "p_name AS name",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS price", "p_size > 10 AS in_stock",
        "CAST(NULL AS STRING) AS image", "CAST(NULL AS STRING) AS size")
    p = _plan(O.catalogue_for_orders(df))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(p_size,10)" in pushed and "IsNotNull(p_retailprice)" in pushed


def test_availability_check_parses_each_item_list_once_a_side(spark, entry):
    """A filter on the number of lines must not repeat the JSON check below it."""
    p = entry.queries()["availability_check"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("from_json(") <= 2
