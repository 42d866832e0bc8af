"""Hand-made edge rows (FIXTURES section 3) for each operator family."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketspark.functions import expr as K
from marketspark.operators import cart as C
from marketspark.operators import orders as O
from marketspark.operators import promotions as G
from marketspark.operators import quality as J
from marketspark.operators import subscriptions as H
from marketspark.operators import visibility as V

T0 = dt.datetime(2024, 1, 1)
REQ_SCHEMA = ("request_id string, user_id string, requested_at timestamp_ntz, customer_name string, "
              "customer_phone string, customer_email string, customer_address string, items string")


def _req(spark, rows):
    full = [(r[0], r[1] if len(r) > 2 else "u1", T0, "Ada", "0801", None, "Street", r[-1]) for r in rows]
    return spark.createDataFrame(full, REQ_SCHEMA)


def _products(spark):
    return spark.createDataFrame(
        [("p1", "vA", "Soap & Co (big)\nline", Decimal("10.00"), True, None, None),
         ("p2", "vA", "Out", Decimal("5.00"), False, None, None),
         ("p3", "vB", "Oil", Decimal("2.50"), True, "img", "50ml")],
        "id string, vendor string, name string, price decimal(18,2), in_stock boolean, image string, size string")


def test_item_list_rules(spark):
    big = "[" + ",".join('{"id":"p1","qty":1}' for _ in range(51)) + "]"
    cases = {
        "null": (None, O.R_COUNT), "empty": ("[]", O.R_COUNT), "object": ('{"id":"a","qty":1}', O.R_COUNT),
        "51": (big, O.R_COUNT), "number": ("[5]", O.R_ITEM), "qty0": ('[{"id":"a","qty":0}]', O.R_ITEM),
        "q03": ('[{"id":"a","qty":"03"}]', O.R_ITEM), "q100": ('[{"id":"a","qty":100}]', O.R_ITEM),
        "q3.0": ('[{"id":"a","qty":3.0}]', O.R_ITEM), "qs7": ('[{"id":"a","qty":"7"}]', None),
        "id_empty": ('[{"id":"","qty":1}]', O.R_ITEM), "id_missing": ('[{"qty":1}]', O.R_ITEM),
        "ok": ('[{"id":"p1","qty":2},{"id":"p3","qty":99}]', None), "bad_json": ("[{", O.R_COUNT),
        "str_elem": ('["a"]', O.R_ITEM), "null_elem": ('[null]', O.R_ITEM), "arr_elem": ('[[1]]', O.R_ITEM),
        "mixed": ('[{"id":"a","qty":1},5]', O.R_ITEM), "qbool": ('[{"id":"a","qty":true}]', O.R_ITEM),
        "qnull": ('[{"id":"a","qty":null}]', O.R_ITEM), "num_id": ('[{"id":5,"qty":1}]', None),
        "extra": ('[{"id":"a","qty":1,"size":"L"}]', None), "spaced": (' [ {"id":"a","qty":12} ] ', None),
    }
    df = _req(spark, [(k, v[0]) for k, v in cases.items()])
    got = {r["request_id"]: r["item_reason"] for r in O.parse_items(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_header_rules_first_failing(spark):
    rows = [("a", None, T0, " ", "0801", None, "St", "[]"),           # no user wins over blank name
            ("b", "u", T0, "Ada", "   ", None, "St", "[]"),
            ("c", "u", T0, "x" * 151, "0801", None, "St", "[]"),
            ("d", "u", T0, "Ada", "0801", "e" * 321, "St", "[]"),
            ("e", "u", T0, " Ada ", "0801", None, "St", "[]")]
    df = spark.createDataFrame(rows, REQ_SCHEMA)
    got = {r["request_id"]: r["reason"] for r in O.validate_headers(df).collect()}
    assert got == {"a": O.R_NO_USER, "b": O.R_MISSING, "c": O.R_TOO_LONG, "d": O.R_TOO_LONG, "e": None}


def test_merge_reprice_availability_and_split(spark):
    reqs = _req(spark, [("r1", '[{"id":"p1","qty":60},{"id":"p1","qty":60}]'),       # 120 -> unavailable
                        ("r2", '[{"id":"p1","qty":1},{"id":"p2","qty":1}]'),        # p2 out of stock
                        ("r3", '[{"id":"p1","qty":2},{"id":"p3","qty":1},{"id":"p1","qty":3}]'),
                        ("r4", '[{"id":"zz","qty":1}]')])                          # unknown product
    it = O.intake(reqs, _products(spark))
    orders = {r["request_id"]: r for r in it.orders().collect()}
    assert set(orders) == {"r3"}
    assert orders["r3"]["total"] == Decimal("52.50") and orders["r3"]["n_items"] == 2
    assert orders["r3"]["items"].startswith('[{"id":"p1","vendor":"vA"')
    assert orders["r3"]["id"].startswith("ORD-240101-")
    vo = it.vendor_orders().collect()
    assert sorted((r["vendor_id"], r["subtotal"]) for r in vo) == [("vA", Decimal("50.00")), ("vB", Decimal("2.50"))]
    assert sum(r["subtotal"] for r in vo) == orders["r3"]["total"]
    rej = {r["request_id"]: r["reason"] for r in it.rejected().collect()}
    assert rej == {"r1": O.R_UNAVAILABLE, "r2": O.R_UNAVAILABLE, "r4": O.R_UNAVAILABLE}


def test_whatsapp_outbox_text_and_link(spark):
    reqs = _req(spark, [("r3", '[{"id":"p1","qty":1}]')])
    vo = O.intake(reqs, _products(spark)).vendor_orders()
    vendors = spark.createDataFrame([("vA", "Shop A", None)], "id string, name string, whatsapp string")
    r = O.whatsapp_outbox(vo, vendors).collect()[0]
    assert r["number"] == K.DEFAULT_WHATSAPP
    assert "  • Soap & Co (big)\nline (×1) — ₦10" in r["message"]
    assert "*Boutique:* Shop A" in r["message"] and "✉️ Email: Not provided" in r["message"]
    assert r["url"].startswith(f"https://wa.me/{K.DEFAULT_WHATSAPP}?text=")
    assert "Soap%20%26%20Co%20(big)%0Aline" in r["url"]


CART_SCHEMA = ("user_id string, seq long, ts timestamp_ntz, kind string, product_id string, qty int, "
               "snap struct<name:string,price:decimal(18,2),original_price:decimal(18,2),vendor:string>")


def _cart(spark, evs):
    snap = ("n", Decimal("1.00"), None, "v")
    return spark.createDataFrame([("u", s, T0 + dt.timedelta(minutes=s), k, p, q, snap) for s, k, p, q in evs],
                                 CART_SCHEMA)


def test_cart_fold_edges(spark):
    # clear empties every line; set on an absent line does nothing; set 0
    # removes; a set after the line exists replaces qty; later adds add on
    evs = [(1, "add", "p2", 1), (2, "clear", None, None), (3, "set", "p2", 3),
           (4, "set", "p1", 5), (5, "add", "p1", 2), (6, "set", "p1", 0), (7, "add", "p1", 1),
           (8, "set", "p1", 7), (9, "add", "p1", 2),
           (10, "remove", "p3", None), (11, "add", "p3", 4)]
    got = {r["product_id"]: (r["qty"], r["added_seq"]) for r in C.cart_state(_cart(spark, evs)).collect()}
    assert got == {"p1": (9, 7), "p3": (4, 11)}


SUB_SCHEMA = "vendor_id string, seq long, ts timestamp_ntz, kind string, plan string, days int, notes string"


def _d(m, d):
    return dt.datetime(2024, m, d)


def test_ledger_edges(spark):
    ev = [("vA", 0, _d(1, 1), "trial", None, 30, None), ("vA", 1, _d(2, 15), "pay", "monthly", None, " "),
          ("vB", 0, _d(1, 1), "trial", None, 30, None), ("vB", 1, _d(1, 10), "pay", "monthly", None, None),
          ("vC", 0, _d(1, 1), "trial", None, 30, None)]
    ev += [("vC", i, _d(1, 1 + i), "pay", "launch", None, None) for i in range(1, 5)]
    ev += [("vD", 0, _d(1, 1), "trial", None, 30, None), ("vD", 1, _d(1, 2), "pay", "gold", None, None),
           ("vD", 2, _d(1, 3), "grant", None, 0, None), ("vD", 3, _d(1, 4), "grant", None, 366, None),
           ("vD", 4, _d(1, 5), "suspend", None, None, None), ("vD", 5, _d(1, 6), "grant", None, 5, None),
           ("vE", 0, _d(1, 1), "trial", None, 30, None), ("vE", 1, _d(1, 2), "suspend", None, None, None),
           ("vE", 2, _d(1, 3), "resume", None, None, None),
           ("vF", 1, _d(1, 2), "pay", "monthly", None, None)]
    c = H.classify_events(spark.createDataFrame(ev, SUB_SCHEMA))
    reasons = {(r["vendor_id"], r["seq"]): r["reason"] for r in c.collect()}
    assert reasons[("vC", 4)] == "launch_limit_reached"
    assert reasons[("vD", 1)] == "invalid_plan"
    assert reasons[("vD", 2)] == reasons[("vD", 3)] == "invalid_days"
    assert reasons[("vF", 1)] == "subscription_not_found"
    periods = {(r["vendor_id"], r["seq"]): (r["period_start"], r["period_end"])
               for r in H.renewal_periods(c).collect()}
    assert periods[("vA", 1)] == (_d(2, 15), _d(3, 16))        # paid after expiry: starts at payment
    assert periods[("vB", 1)] == (_d(1, 31), _d(3, 1))         # paid before expiry: chained
    assert periods[("vC", 3)][1] == _d(4, 30)
    st = {r["vendor_id"]: r for r in H.subscription_state(c, H.renewal_periods(c)).collect()}
    assert "vF" not in st
    assert st["vD"]["status"] == "suspended" and st["vD"]["access_ends_at"] == _d(2, 5)
    assert st["vE"]["status"] == "trial"
    assert st["vC"]["plan"] == "launch" and st["vC"]["n_payments"] == 3
    pay = {r["vendor_id"]: r for r in H.payment_history(H.renewal_periods(c)).collect() if r["rank"] == 1}
    assert pay["vA"]["notes"] is None


PROMO_SCHEMA = ("id string, promotion_type string, vendor_id string, product_id string, title string, "
                "subtitle string, image_url string, link_url string, placement_level smallint, "
                "amount_paid decimal(12,2), payment_status string, status string, starts_at timestamp_ntz, "
                "ends_at timestamp_ntz, created_at timestamp_ntz")


def test_promotion_boundaries_and_ties(spark):
    s, e = _d(1, 10), _d(1, 12)
    promos = spark.createDataFrame(
        [("b", "product", "v1", "x", None, None, None, None, 2, Decimal(1), "paid", "active", s, e, T0),
         ("a", "product", "v1", "x", None, None, None, None, 2, Decimal(1), "paid", "active", s, e, T0),
         ("c", "product", "v1", "y", None, None, None, None, 3, Decimal(1), "pending", "active", s, e, T0)],
        PROMO_SCHEMA)
    ranks = {r["id"]: r["rank"] for r in G.active_promotions(promos, "product", s).collect()}
    assert ranks == {"a": 1, "b": 2}
    views = spark.createDataFrame(
        [(1, s, "x", "v9"), (2, e, "x", "v9"), (3, e - dt.timedelta(microseconds=1), "x", "v9")],
        "event_id long, ts timestamp_ntz, product_id string, vendor_id string")
    hits = sorted((r["event_id"], r["promotion_id"]) for r in G.promo_impressions(views, promos).collect())
    assert hits == [(1, "a"), (1, "b"), (3, "a"), (3, "b")]


def test_rules_null_passes_false_violates(spark):
    promos = spark.createDataFrame(
        [("p", "product", "v1", None, None, None, None, None, 1, Decimal(1), "paid", "active", _d(1, 1), _d(1, 2), T0),
         ("q", "banner", None, None, None, None, None, None, None, None, "paid", "active", _d(1, 1), _d(1, 2), T0)],
        PROMO_SCHEMA)
    got = {r["id"]: r["violations"] for r in J.violations(promos, "promotions").collect()}
    assert got["p"] == ["target_valid"]
    assert got["q"] == ["target_valid"]          # null level / amount pass, missing title fails


def test_percent_off_and_phone(spark):
    df = spark.createDataFrame(
        [(Decimal(12500), Decimal(16000)), (Decimal(1005), Decimal(1000)), (Decimal(5), Decimal(0)),
         (Decimal(5), None)], "p decimal(18,2), o decimal(18,2)")
    assert [r[0] for r in df.select(K.percent_off(F.col("p"), F.col("o"))).collect()] == [22, 0, 0, 0]
    ph = spark.createDataFrame([("08012345678",), ("002348012345678",), ("+447911123456",), ("12345",)], "x string")
    assert [r[0] for r in ph.select(K.phone_e164(F.col("x"))).collect()] == [
        "+2348012345678", "+2348012345678", "+447911123456", None]


def test_vendor_visibility(spark):
    at = _d(1, 20)
    vendors = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "id string")
    subs = spark.createDataFrame([("v1", "active", _d(2, 1)), ("v2", "trial", at), ("v3", "suspended", _d(3, 1))],
                                 "vendor_id string, status string, access_ends_at timestamp_ntz")
    ids = lambda v: sorted(r["id"] for r in V.visible_vendors(vendors, subs, v, at).collect())
    assert ids(V.Viewer("anon")) == ["v1"]
    assert ids(V.Viewer("vendor", "u3", "v3")) == ["v1", "v3"]
    assert ids(V.Viewer("admin", "u0")) == ["v1", "v2", "v3"]


def test_cart_moves_log_rows_once(spark):
    """Without broadcasts, one exchange carries log rows (the adds); the others
    carry one row per line, per shopper or per line and task."""
    from marketspark.sources.testdata import TestTables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.cart_state(TestTables(spark, "/root/testdata/sf0.001").cart_events())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    whole = [x for x in below if "Aggregate" not in x and "_la" not in x and "_reset" not in x]     # not the marks
    assert "Window" not in plan and "Python" not in plan
    assert len(whole) == 1 and "snap" in whole[0], below


def test_cart_events_without_user_or_product(spark):
    t = dt.datetime(2024, 1, 1)
    row = lambda u, s, k, p, q: (u, s, t + dt.timedelta(seconds=s), k, p, q, ("n", Decimal("1.00"), None, "v"))
    df = spark.createDataFrame(
        [row("u", 1, "add", "p", 2), row(None, 2, "add", "p", 5), row("u", 3, "add", None, 5), row(None, 4, "clear", None, None),
         row("u", 5, "remove", None, None), row("u", 6, "set", "q", 4), row("u", 7, "add", "q", None)],
        "user_id string, seq long, ts timestamp_ntz, kind string, product_id string, qty int, "
        "snap struct<name:string,price:decimal(18,2),original_price:decimal(18,2),vendor:string>")
    got = {(r["user_id"], r["product_id"]): r["qty"] for r in C.cart_state(df).collect()}
    assert got == {("u", "p"): 2, ("u", "q"): 0}
    assert C.cart_state(df.limit(0)).count() == 0


def test_foreign_keys_in_one_pass(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    other = spark.createDataFrame([(1,)], "no int")
    child = spark.createDataFrame([("a", "x", 1), ("b", "a", 2), ("z", None, None), ("z", "x", 2), (None, "x", 1)], "p string, q string, o int")
    checks = {"child": (child, [("p", parent, "id"), ("q", parent, "id"), ("o", other, "no")]), "none": (child.limit(0), [("p", parent, "id")])}
    df = J.check_foreign_keys(checks)
    assert {r["check"]: r["n_orphans"] for r in df.collect()} == {"child.p": 2, "child.q": 3, "child.o": 2, "none.p": 0}
    empty = {"child": (child, [("p", parent.limit(0), "id")])}
    assert [tuple(r) for r in J.check_foreign_keys(empty).collect()] == [("child.p", 4)]
