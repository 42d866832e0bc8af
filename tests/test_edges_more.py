"""More edge rows: registry merges, write policies, home page lists,
related products and the order response."""

import datetime as dt
import json
from decimal import Decimal

from marketspark.operators import catalog as B
from marketspark.operators import orders as O
from marketspark.operators import promotions as G
from marketspark.operators import registry as R
from marketspark.operators import visibility as V

T0 = dt.datetime(2024, 1, 1)


def _full_products(df):
    """df with the product columns it leaves out."""
    from pyspark.sql import functions as F
    for f in R.PRODUCT_FIELDS:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("array<string>" if f == "sizes" else "decimal(18,2)" if f == "original_price" else "string"))
    return df


def test_product_log_field_mask_and_deletes(spark):
    products = spark.createDataFrame(
        [("a", "v1", "A", Decimal("1.00"), True, "New"), ("b", "v1", "B", Decimal("2.00"), True, None),
         ("c", "v2", "C", Decimal("3.00"), False, None)],
        "id string, vendor string, name string, price decimal(18,2), in_stock boolean, badge string")
    changes = spark.createDataFrame(
        [("a", "v1", 1, "update", None, Decimal("9.00"), None, None, ["price"]),          # only price changes
         ("a", "v1", 2, "update", "A2", None, None, "", ["name", "badge"]),              # name; empty badge -> null
         ("b", "v1", 3, "delete", None, None, None, None, []),
         ("b", "v1", 4, "update", "ghost", None, None, None, ["name"]),                  # update after delete: nothing
         ("c", "v2", 5, "delete", None, None, None, None, []),
         ("c", "v2", 6, "upsert", "C2", Decimal("4.00"), None, "", []),                  # re-created: in_stock default true
         ("d", "v3", 7, "upsert", "D", Decimal("5.00"), False, "Hot", []),
         ("d", "v3", 8, "update", None, None, None, None, ["badge"])],                   # a sent null clears
        "id string, vendor string, seq long, op string, name string, price decimal(18,2), "
        "in_stock boolean, badge string, fields array<string>")
    got = {r["id"]: (r["name"], r["price"], r["in_stock"], r["badge"], r["source"])
           for r in R.merge_products(_full_products(products), _full_products(changes)).collect()}
    assert got == {"a": ("A2", Decimal("9.00"), True, None, "updated"),
                   "c": ("C2", Decimal("4.00"), True, None, "upserted"),
                   "d": ("D", Decimal("5.00"), False, None, "upserted")}


def test_vendor_registry_validation_and_last_change(spark):
    staff = spark.createDataFrame([("boss@x.io", "admin", None, None)],
                                  "email string, role string, vendor_id string, user_id string")
    ch = spark.createDataFrame(
        [(" Shop-1 ", 1, T0, "upsert", "Shop One", "o@x.io", "+234 801 234 5678", None),
         ("shop-1", 2, T0 + dt.timedelta(1), "upsert", "Shop Uno", "o@x.io", "2348012345678", "tag"),
         ("kitchen", 3, T0, "delete", None, None, None, None),
         ("s", 4, T0, "upsert", "X", "o@x.io", "2348012345678", None),
         ("shop-2", 5, T0, "upsert", "Two", "boss@x.io", "2348012345678", None),
         ("shop-3", 6, T0, "upsert", "Three", "bad", "2348012345678", None),
         ("shop-4", 7, T0, "upsert", "Four", "f@x.io", "123", None),
         ("shop-5", 8, T0, "upsert", "  ", "f@x.io", "2348012345678", None),
         ("shop-6", 9, T0, "rename", "Six", "f@x.io", "2348012345678", None)],
        "id string, seq long, ts timestamp_ntz, op string, name string, email string, whatsapp string, "
        "tagline string")
    cleaned = R.clean_vendor_changes(ch, staff)
    reasons = {r["seq"]: r["reason"] for r in cleaned.collect()}
    assert reasons == {1: None, 2: None, 3: "core_vendor", 4: "invalid_vendor_id", 5: "admin_email",
                       6: "invalid_email", 7: "invalid_whatsapp", 8: "name_required", 9: "unsupported_action"}
    no_orders = spark.createDataFrame([], "vendor_id string")
    vendors = spark.createDataFrame([], "id string, name string, tagline string, whatsapp string, "
                                        "rating decimal(3,1), review_count int, page string")
    merged = {r["vendor_id"]: r for r in
              R.merge_vendors(vendors, R.accepted_vendor_changes(cleaned, no_orders)).collect()}
    assert set(merged) == {"shop-1"}
    assert merged["shop-1"]["name"] == "Shop Uno" and merged["shop-1"]["tagline"] == "tag"
    assert merged["shop-1"]["rating"] == Decimal("5.0") and merged["shop-1"]["page"] == "store.html?vendor=shop-1"


def test_write_policies(spark):
    rows = [
        (1, "vendors", "update", "vendor", "u1", "v1", "v1", "v1", None, None, None, None, None, None, None),
        (2, "vendors", "update", "vendor", "u1", "v1", "v1", "v2", None, None, None, None, None, None, None),
        (3, "orders", "insert", "authenticated", "u1", None, None, None, None, "u1", "pending", None, None, None, None),
        (4, "orders", "insert", "authenticated", "u1", None, None, None, None, "u1", "paid", None, None, None, None),
        (5, "vendor_orders", "insert", "authenticated", "u1", None, None, "v1", None, "u1", "pending", None, None,
         ["v1", "v1"], None),
        (6, "vendor_orders", "insert", "authenticated", "u1", None, None, "v1", None, "u1", "pending", None, None,
         ["v1", "v2"], None),
        (7, "vendor_orders", "update", "vendor", "u9", "v1", "v1", "v1", None, None, None, None, None, None,
         ["status", "status_note"]),
        (8, "vendor_orders", "update", "vendor", "u9", "v1", "v1", "v1", None, None, None, None, None, None,
         ["status", "subtotal"]),
        (9, "promotions", "insert", "admin", "u0", None, None, None, None, None, None, "u0", None, None, None),
        (10, "promotions", "insert", "admin", "u0", None, None, None, None, None, None, "u5", None, None, None),
        (11, "payments", "insert", "admin", "u0", None, None, None, None, None, None, None, "u0", None, None),
        (12, "products", "delete", "anon", None, None, "v1", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "change_id long, tbl string, op string, actor_role string, actor_user_id string, "
                                     "actor_vendor_id string, old_vendor_id string, new_vendor_id string, "
                                     "old_user_id string, new_user_id string, new_status string, created_by string, "
                                     "confirmed_by string, item_vendors array<string>, changed_columns array<string>")
    got = {r["change_id"]: r["accepted"] for r in V.check_changes(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False,
                   9: True, 10: False, 11: True, 12: False}


PROMO_SCHEMA = ("id string, promotion_type string, vendor_id string, product_id string, title string, "
                "subtitle string, image_url string, link_url string, placement_level smallint, "
                "amount_paid decimal(12,2), payment_status string, status string, starts_at timestamp_ntz, "
                "ends_at timestamp_ntz, created_at timestamp_ntz")


def test_home_featured_cut_before_subtraction(spark):
    """Sponsored first; organic = first 8 badged minus sponsored ids (cut
    before subtracting, as on the page); 8 in total."""
    prods = spark.createDataFrame([(f"p{i}", "v1", f"P{i}", "Hot", i) for i in range(12)],
                                  "id string, vendor string, name string, badge string, pos long")
    vendors = spark.createDataFrame([("v1", 0)], "id string, pos long")
    s, e = T0, T0 + dt.timedelta(days=9)
    promos = spark.createDataFrame(
        [("m1", "product", "v1", "p5", None, None, None, None, 3, Decimal(1), "paid", "active", s, e, T0),
         ("m2", "product", "v1", "p1", None, None, None, None, 1, Decimal(1), "paid", "active", s, e, T0),
         ("m3", "product", "v1", "gone", None, None, None, None, 2, Decimal(1), "paid", "active", s, e, T0)],
        PROMO_SCHEMA)
    got = [r["product_id"] for r in
           sorted(G.homepage_featured(prods, promos, vendors, T0 + dt.timedelta(days=1)).collect(), key=lambda r: r["rank"])]
    assert got == ["p5", "p1", "p0", "p2", "p3", "p4", "p6", "p7"]


def test_related_products_exclude_self_and_cap(spark):
    prods = spark.createDataFrame([(f"p{i}", "v1" if i < 9 else "v2", i) for i in range(10)],
                                  "id string, vendor string, pos long")
    rel = {}
    for r in B.related_products(prods).collect():
        rel.setdefault(r["product_id"], []).append((r["rank"], r["related_id"]))
    assert [x for _, x in sorted(rel["p0"])] == ["p1", "p2", "p3", "p4", "p5", "p6"]
    assert [x for _, x in sorted(rel["p3"])] == ["p0", "p1", "p2", "p4", "p5", "p6"]
    assert "p9" not in rel                                   # alone in its vendor


def test_order_response_json_shape(spark):
    reqs = spark.createDataFrame(
        [("r1", "u1", T0, "Ada", "0801", None, "St", '[{"id":"p1","qty":2},{"id":"p3","qty":1}]')],
        "request_id string, user_id string, requested_at timestamp_ntz, customer_name string, "
        "customer_phone string, customer_email string, customer_address string, items string")
    products = spark.createDataFrame(
        [("p1", "vA", "Soap", Decimal("10.00"), True, None, None), ("p3", "vB", "Oil", Decimal("2.50"), True, "i", "s")],
        "id string, vendor string, name string, price decimal(18,2), in_stock boolean, image string, size string")
    r = O.order_response(O.intake(reqs, products)).collect()[0]
    body = json.loads(r["response"])
    assert body["orderId"] == r["order_id"] and str(body["total"]) == "22.5"
    assert [v["vendorId"] for v in body["vendorOrders"]] == ["vA", "vB"]
    assert body["vendorOrders"][0]["items"][0]["qty"] == 2 and body["vendorOrders"][0]["status"] == "pending"
    assert body["vendorOrders"][1]["items"][0]["image"] == "i"


def test_featured_lists_vendor_by_vendor(spark):
    """The catalogue is the vendors' products one vendor after the other."""
    from marketspark.operators import catalog as C
    prods = spark.createDataFrame([("p1", "vB", "Hot", 1), ("p2", "vA", "Hot", 2), ("p3", "vB", "Hot", 3), ("p4", "vA", "", 0), ("p5", "vX", "Hot", 0)],
                                  "id string, vendor string, badge string, pos long")
    vendors = spark.createDataFrame([("vA", 1), ("vB", 2)], "id string, pos long")
    got = [r["id"] for r in sorted(C.featured_products(prods, vendors, 3).collect(), key=lambda r: r["rank"])]
    assert got == ["p2", "p1", "p3"]


def test_proven_edges(spark):
    """Cases that once gave wrong answers: stars outside 0..5, final line
    breaks, trailing text, objects as item lists, untouched products."""
    from marketspark.functions import expr as K
    from marketspark.operators import orders as O
    from marketspark.operators import quality as J
    from marketspark.operators import registry as R
    from pyspark.sql import functions as F
    stars = spark.createDataFrame([(5.5,), (-0.5,), (5.0,), (4.5,), (0.2,)], "r double").select(K.star_parts("r").alias("s")).collect()
    assert [tuple(r.s) for r in stars] == [(5, False, 0), (0, False, 5), (5, False, 0), (4, True, 0), (0, False, 5)]
    items = ['[{"id":"a","qty":"5\\n"}]', '[{"id":"a","qty":1}] x', '[{"id":"a","qty":"5"}]']
    got = O.parse_items(spark.createDataFrame([(x,) for x in items], "items string")).collect()
    assert [r.item_reason for r in got] == [O.R_ITEM, O.R_COUNT, None]
    bad = spark.createDataFrame([('{"a":1}',), ("broken",), ("[]",), (None,), ("[1]",)], "items string").select(
        "items", F.lit(1).alias("total"), F.lit("paid").alias("status"))
    assert [len(r.violations) for r in J.violations(bad, "orders").collect()] == [1, 1, 1, 0, 0]
    assert not spark.range(1).select(F.lit("v5\n").rlike(R.VENDOR_ID_RE).alias("x")).first().x
    cols = ("id string, vendor string, name string, price int, in_stock boolean, badge string, description string, "
            "original_price int, image string, category string, sizes array<string>, size string, material string, "
            "origin string, notes string")
    rest = ("text", 9, "i", "c", None, "", "m", "o", "n")
    prods = spark.createDataFrame([("p1", "v", "A", 1, None, " Hot ", *rest), ("p2", "v", "B", 2, None, "", *rest)], cols)
    none = (None,) * 9
    ch = spark.createDataFrame([("p2", "v", "B2", None, None, None, *none, 1, "update", ["name", "description"]),
                                ("p9", "v", "gone", 1, None, None, *none, 2, "update", ["name"])],
                               cols + ", seq long, op string, fields array<string>")
    rows = {r.id: (r.name, r.in_stock, r.badge, r.description, r.size, r.source) for r in R.merge_products(prods, ch).collect()}
    assert rows == {"p1": ("A", None, " Hot ", "text", "", "existing"), "p2": ("B2", True, None, None, None, "updated")}


def test_products_without_price_stay_but_are_not_ordered(spark):
    from marketspark.operators import orders as O
    from marketspark.sources import loaders as L
    raw = spark.createDataFrame([("p1", "v", None, True), ("p2", "v", 3, True)], "id string, vendor string, price int, in_stock boolean")
    p = L.normalize_products(L.conform(raw, L.PRODUCT_SCHEMA))
    assert p.count() == 2
    assert [r.product_id for r in O.catalogue_for_orders(p).collect()] == ["p2"]
