"""E1 per viewer, and the tiles of the impression join."""

import datetime as dt

from marketspark.operators import promotions as G
from marketspark.operators import tracking as E
from marketspark.operators.visibility import Viewer

T = dt.datetime(2024, 1, 1)
ITEM = '[{"id":"p1","name":"Oil","price":12.50,"qty":2},{"id":"p2","name":"Soap","price":3}]'
VO = "id string, order_id string, user_id string, vendor_id string, items string, subtotal decimal(38,2), status string, status_note string, created_at timestamp_ntz"


def _orders(spark):
    def row(i, user, vendor, day, items=ITEM, status="pending", note=None):
        return (i, i, user, vendor, items, None, status, note, T + dt.timedelta(days=day))
    return spark.createDataFrame([
        row("a", "u1", "v1", 1), row("b", "u1", "v2", 2, note=""), row("c", "u2", "v1", 3, note="on its way", status="shipped"),
        row("d", None, "v1", 4, items="[]"), row("e", "su1", "v1", 5), row("f", "su1", "v2", 5, items=None, status="odd")], VO)


def _vendors(spark):
    return spark.createDataFrame([("v1", "One")], "id string, name string")


def test_page_of_one_viewer(spark):
    def page(viewer):
        rows = E.my_orders(_orders(spark), _vendors(spark), viewer).collect()
        return [r["id"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert page(Viewer("admin")) == ["e", "f", "d", "c", "b", "a"]
    assert page(Viewer("vendor", "su1", "v1")) == ["e", "f", "d", "c", "a"]      # own orders and the vendor's
    assert page(Viewer("authenticated", "u1")) == ["b", "a"]
    assert page(Viewer("authenticated", "u1", "v1")) == ["b", "a"]               # a vendor id without the role gives nothing
    assert page(Viewer("anon")) == []


def test_cards_show_lines_and_note(spark):
    got = {r["id"]: r for r in E.my_orders(_orders(spark), _vendors(spark)).collect()}
    assert [(x["name"], x["qty"], str(x["total"])) for x in got["a"]["lines"]] == [("Oil", 2, "25.00"), ("Soap", 1, "3.00")]
    assert str(got["a"]["lines_total"]) == "28.00"
    assert (got["b"]["status_note"], got["c"]["status_note"], got["c"]["status_label"]) == (None, "on its way", "Shipped")
    assert (got["b"]["vendor_name"], got["a"]["vendor_name"]) == ("v2", "One")
    assert (got["d"]["n_lines"], got["d"]["lines"], got["f"]["lines"]) == (0, [], None)
    assert (got["b"]["rank"], got["a"]["rank"]) == (1, 2)


def test_all_viewers_equal_one_by_one(spark):
    viewers = [("w1", "admin", "u0", None), ("w2", "vendor", "su1", "v1"), ("w3", "authenticated", "u1", None), ("w4", "anon", None, None),
               ("w5", "vendor", None, "v2"), ("w6", None, "u1", None), ("w7", "admin", None, None), ("w8", "vendor", "u2", None)]
    table = spark.createDataFrame(viewers, "viewer_id string, role string, user_id string, vendor_id string")
    got = {}
    for r in E.my_orders_by_viewer(_orders(spark), table).collect():
        got.setdefault(r["viewer_id"], []).append((r["rank"], r["id"]))
    for name, role, user, vendor in viewers:
        one = E.my_orders(_orders(spark), _vendors(spark), Viewer(role or "anon", user, vendor)).collect()
        assert sorted(got.get(name, [])) == sorted((r["rank"], r["id"]) for r in one), name
    assert E.my_orders_by_viewer(_orders(spark), table.limit(0)).count() == 0


def _promo(i, days, start=T):
    return (i, "product", "p1", None, "active", "paid", start, start + days)


PROMO = "id string, promotion_type string, product_id string, vendor_id string, status string, payment_status string, starts_at timestamp_ntz, ends_at timestamp_ntz"


def test_impressions_of_short_and_long_promotions(spark):
    spans = [dt.timedelta(microseconds=1), dt.timedelta(hours=5), dt.timedelta(days=1), dt.timedelta(days=7, hours=3), dt.timedelta(days=64),
             dt.timedelta(days=365 * 30), dt.timedelta(0)]
    starts = [T, T + dt.timedelta(hours=23, minutes=59), dt.datetime(1969, 12, 20)]
    promos = [_promo(f"m{i}{j}", d, s) for i, d in enumerate(spans) for j, s in enumerate(starts)]
    views = [(n, "p1" if n % 5 else None, "v1", s + d * f) for n, (s, d, f) in enumerate(
        (s, d, f) for s in starts for d in spans for f in (0, 0.5, 1))]
    views += [(1000 + n, "p1", None, T + dt.timedelta(days=x)) for n, x in enumerate((-1, 0, 3, 400, 4000, 20000))]
    v = spark.createDataFrame(views, "event_id int, product_id string, vendor_id string, ts timestamp_ntz")
    got = sorted((r[0], r[1]) for r in G.promo_impressions(v, spark.createDataFrame(promos, PROMO)).collect())
    want = sorted((e, p[0]) for e, prod, _, ts in views for p in promos if prod == "p1" and p[6] <= ts < p[7])
    assert got == want


def test_no_promotions_no_impressions(spark):
    v = spark.createDataFrame([(1, "p1", "v1", T)], "event_id int, product_id string, vendor_id string, ts timestamp_ntz")
    assert G.promo_impressions(v, spark.createDataFrame([], PROMO)).count() == 0


def test_a_promotion_of_any_length_covers_three_tiles_at_most(spark):
    from pyspark.sql import functions as F
    days = spark.range(1, 12000, 7).select(F.col("id").cast("int").alias("n"), F.explode(F.array(*[F.lit(x) for x in (-5000, 19000, 19001, 20479, 23170)])).alias("first"))
    width = F.length(F.bin("n")) - 1
    worst = days.select(F.max(G._tile(F.col("first") + F.col("n") - 1, width) - G._tile(F.col("first"), width) + 1)).first()[0]
    assert worst <= 3
