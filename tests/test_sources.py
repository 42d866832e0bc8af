"""A1/A2 readers: explicit schemas over parquet, json and csv, with the
catalogue defaults applied."""

import os
import tempfile
from decimal import Decimal

from marketspark.sources import loaders as L


def test_load_vendors_json_defaults(spark):
    d = tempfile.mkdtemp(prefix="ms-src-")
    p = os.path.join(d, "vendors.json")
    with open(p, "w") as f:
        f.write('{"id":"v1","name":"One","rating":0,"categories":null,"page":"","pos":1}\n')
        f.write('{"id":"v2","name":"Two","rating":4.5,"review_count":7,"categories":["a"],"page":"x.html","pos":2}\n')
    got = {r["id"]: r for r in L.load_vendors(spark, p, "json").collect()}
    assert got["v1"]["rating"] == Decimal("5.0") and got["v1"]["review_count"] == 0
    assert got["v1"]["categories"] == [] and got["v1"]["page"] == "store.html?vendor=v1"
    assert got["v2"]["rating"] == Decimal("4.5") and got["v2"]["page"] == "x.html"


def test_load_products_csv_and_parquet(spark):
    d = tempfile.mkdtemp(prefix="ms-src-")
    p = os.path.join(d, "products.csv")
    with open(p, "w") as f:      # CSV in schema order, without the array column `sizes`
        f.write("id,vendor,name,description,price,original_price,in_stock,badge,category,size,image,"
                "review_count,pos\n")
        f.write("p1,v1,Soap,,10.5,,true,New,Home,,img,,1\n")
        f.write("p2,v1,NoPrice,,,,true,,Home,,img,3,2\n")
    got = {r["id"]: r for r in L.load_products(spark, p, "csv").collect()}
    assert set(got) == {"p1", "p2"} and got["p2"]["price"] is None     # J4 reports it, D4 does not sell it
    assert got["p1"]["price"] == Decimal("10.50") and got["p1"]["original_price"] is None
    assert got["p1"]["review_count"] == 0 and got["p1"]["sizes"] == []
    out = os.path.join(d, "products.parquet")
    spark.read.option("header", True).csv(p).select("id", "vendor", "name", "price").write.parquet(out)
    pq = {r["id"]: r for r in L.load_products(spark, out, "parquet").collect()}
    assert set(pq) == {"p1", "p2"} and pq["p1"]["in_stock"] is None and pq["p1"]["price"] == Decimal("10.50")
