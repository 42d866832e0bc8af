"""What the intake sends through its exchanges, and that the rows stay the same."""

import datetime as dt
import json
import re
from decimal import Decimal

from marketspark.operators import orders as O
from marketspark.operators import subscriptions as H
from marketspark.operators import visibility as V

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
REQUEST = ("request_id string, user_id string, requested_at timestamp_ntz, customer_name string, customer_phone string, customer_email string, "
           "customer_address string, items string, caller_role string, caller_vendor_id string")
PRODUCT = "id string, vendor string, name string, price decimal(18,2), in_stock boolean, image string, size string"


def _products(spark):
    return spark.createDataFrame([(f"p{i}", f"v{i % 2}", f"Soap {i}", Decimal(i), True, None, None) for i in range(1, 7)], PRODUCT)


def _request(rid, items, name="Ada", email=None, at=T0, role="admin"):
    return (rid, "u", at, name, "0801", email, "St", json.dumps([{"id": p, "qty": 1} for p in items]), role, None)


def test_lines_move_without_headers_and_not_by_day(spark, entry):
    p = entry.queries()["split_by_vendor"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(product_id#.*\n.*Project \[(.*?)\]\n", p)
    assert moved and all("customer_" not in cols for cols in moved)
    assert "_day#" not in p


def test_repeated_and_missing_request_ids_keep_their_headers(spark):
    rows = [_request("a", ["p1", "p2"]), _request("a", ["p3", "p4"], name="Bo"),            # four lines met, two asked: none placed
            _request("b", ["p1"]), _request("b", ["gone", "p2"], name="Bo"),                # two met: the second counts as whole
            _request("c", ["p1"], name=" Eve "), _request("c", ["gone"], name="Eve"),       # headers alike once trimmed
            _request(None, ["p1", "p2"]), _request(None, ["gone", "p3"], email="x@y.org"),  # lines without an id are pooled, too
            _request("d", ["p5", "p6"], email=" e@f.org ")]
    got = [(r.request_id, r.vendor_id, r.customer_name, r.customer_email, [i["id"] for i in json.loads(r["items"])])
           for r in O.intake(spark.createDataFrame(rows, REQUEST), _products(spark)).vendor_orders().collect()]
    key = lambda r: (r[0] or "", r[1], r[2])
    assert sorted(got, key=key) == sorted([("b", "v0", "Bo", None, ["p2"]), ("c", "v1", "Eve", None, ["p1"]),
                                           ("d", "v0", "Ada", "e@f.org", ["p6"]), ("d", "v1", "Ada", "e@f.org", ["p5"])], key=key)


def test_vendors_of_many_spans_are_met_by_day(spark, monkeypatch):
    events = []
    for v in ("v0", "v1"):
        events.append((v, -1, T0, "trial", None, None, None))
        for d in range(1, 20, 2 if v == "v1" else 10):          # v1 goes live anew every other day
            events += [(v, 2 * d, T0 + dt.timedelta(days=d), "suspend", None, None, None), (v, 2 * d + 1, T0 + dt.timedelta(days=d, hours=20), "resume", None, None, None)]
    live = H.live_intervals(H.classify_events(spark.createDataFrame(events, "vendor_id string, seq long, ts timestamp_ntz, kind string, plan string, days int, notes string")))
    rows = [_request(f"{p}-{h}", [p], at=T0 + dt.timedelta(hours=5 * h), role="authenticated") for p in ("p1", "p2") for h in range(-2, 160)] + [_request("none", ["p1"], at=None, role=None)]
    asked = spark.createDataFrame(rows, REQUEST)
    spans = {r.vendor_id: r for r in V.vendor_spans(live, most=5).collect()}
    assert spans["v1"]._busy and not spans["v0"]._busy and len(spans["v0"]._spans) == 3
    assert all(r._busy for r in V.vendor_spans(live, merged=2).collect())
    want = None
    for most in (64, 5, 0):
        monkeypatch.setattr(O, "vendor_spans", lambda x, most=most: V.vendor_spans(x, most=most))
        got = sorted(r.request_id for r in O.intake(asked, _products(spark), live).orders().collect())
        want = want or got
        assert got == want and 0 < len(got) < len(rows)


def test_messages_are_made_once(spark, entry):
    p = entry.queries()["whatsapp_outbox"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("from_json(") == 2           # the request's items and the vendor order's


def test_orders_and_vendor_orders_share_one_intake(spark, entry):
    rows = [_request("a", ["p1", "p2"]), _request("b", ["gone", "p2"]), _request("c", ["p3"], name="Bo"), _request(None, ["p4"]), _request("c", ["p3"], name="Bo")]
    it = O.intake(spark.createDataFrame(rows, REQUEST), _products(spark))
    kept = it.keep()
    for of in (O.Intake.orders, O.Intake.vendor_orders):
        assert sorted(map(str, of(kept).collect())) == sorted(map(str, of(it).collect())) and of(kept).columns == of(it).columns
    p = entry.queries()["reconcile_orders"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in p and "l_orderkey" not in p


def test_lines_are_sorted_once_by_request(spark, entry):
    p = entry.queries()["split_by_vendor"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[request_id#\d+ ASC NULLS FIRST, _head", p)) == 1


def test_response_takes_the_items_as_they_are(spark):
    products = spark.createDataFrame([("p1", "v1", 'A "b" \\ é\n', Decimal("1.50"), True, None, "5ml"), ("p2", "v2", None, Decimal(2), True, "i.jpg", None)], PRODUCT)
    df = O.order_response(O.intake(spark.createDataFrame([_request("a", ["p1", "p2", "p1"])], REQUEST), products))
    # the request's own list is the only text read
    assert df._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
    (row,) = df.collect()
    line = {"image": None, "size": None}
    assert json.loads(row.response) == {"orderId": row.order_id, "total": 5.0, "vendorOrders": [
        {"id": f"{row.order_id}/v1", "vendorId": "v1", "total": 3.0, "status": "pending",
         "items": [{**line, "id": "p1", "vendor": "v1", "name": 'A "b" \\ é\n', "price": 1.5, "size": "5ml", "qty": 2}]},
        {"id": f"{row.order_id}/v2", "vendorId": "v2", "total": 2.0, "status": "pending",
         "items": [{**line, "id": "p2", "vendor": "v2", "name": None, "price": 2.0, "image": "i.jpg", "qty": 1}]}]}


def test_merge_of_distinct_and_repeated_lines(spark):
    rows = [([("a", 1), ("b", 2)],), ([("a", 1), ("b", 2), ("a", 3)],), ([],), (None,), ([(None, 4), ("b", 2)],)]
    df = spark.createDataFrame(rows, "lines array<struct<id:string,qty:int>>")
    got = [None if r.m is None else [tuple(x) for x in r.m] for r in df.select(O.merge_lines_col(df["lines"]).alias("m")).collect()]
    assert got == [[("a", 1), ("b", 2)], [("a", 4), ("b", 2)], [], None, [(None, 0), ("b", 2)]]
    # lists without repeats, nearly all, are taken over without a search per line
    p = df.select(O.merge_lines_col(df["lines"]).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (size(" in p
