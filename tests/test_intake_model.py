"""The intake against a plain-Python model of the placement call, on
random item lists (numbers, strings, decimals, booleans, nulls, bad
shapes, repeats)."""

import datetime as dt
import json
import re
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketspark.operators import orders as O

CATALOGUE = {"p1": ("vA", Decimal("10.00"), True), "p2": ("vA", Decimal("2.50"), True),
             "p3": ("vB", Decimal("7.25"), True), "p4": ("vB", Decimal("1.00"), False)}
T0 = dt.datetime(2024, 1, 1)


def text(v):
    """The text jsonb's ->> gives for a JSON value (None for null)."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dict, list)):
        return json.dumps(v, separators=(",", ":"))
    return str(v)


def model(items_text):
    """(reason, {vendor: subtotal}) the placement call would produce."""
    try:
        items = json.loads(items_text)
    except (TypeError, ValueError):
        return O.R_COUNT, None
    if not isinstance(items, list) or not 1 <= len(items) <= 50:
        return O.R_COUNT, None
    merged = {}
    for e in items:
        if not isinstance(e, dict):
            return O.R_ITEM, None
        pid, q = text(e.get("id")), text(e.get("qty"))
        if not pid or not re.fullmatch(r"[1-9][0-9]?", q or ""):
            return O.R_ITEM, None
        merged[pid] = merged.get(pid, 0) + int(q)
    out = {}
    for pid, q in merged.items():
        c = CATALOGUE.get(pid)
        if c is None or not c[2] or not 1 <= q <= 99:
            return O.R_UNAVAILABLE, None
        out[c[0]] = out.get(c[0], Decimal(0)) + c[1] * q
    return None, out


qty = st.one_of(st.integers(-1, 120), st.sampled_from(["7", "03", "12", "", "x"]),
                st.sampled_from([3.0, 2.5]), st.booleans(), st.none())
pid = st.one_of(st.sampled_from(["p1", "p2", "p3", "p4", "zz", ""]), st.just(5), st.none())
element = st.one_of(st.fixed_dictionaries({"id": pid, "qty": qty}), st.integers(0, 3), st.just("a"))
items = st.one_of(st.lists(element, min_size=0, max_size=6).map(json.dumps),
                  st.fixed_dictionaries({"id": pid, "qty": qty}).map(json.dumps), st.just("[{"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(items, min_size=1, max_size=25))
def test_intake_matches_model(spark, batch):
    rows = [(f"r{i}", "u1", T0, "Ada", "0801", None, "Street", it) for i, it in enumerate(batch)]
    df = spark.createDataFrame(rows, "request_id string, user_id string, requested_at timestamp_ntz, "
                                     "customer_name string, customer_phone string, customer_email string, "
                                     "customer_address string, items string")
    cat = spark.createDataFrame([(k, v[0], k.upper(), v[1], v[2], None, None) for k, v in CATALOGUE.items()],
                                "id string, vendor string, name string, price decimal(18,2), in_stock boolean, "
                                "image string, size string")
    it = O.intake(df, cat)
    rej = {r["request_id"]: r["reason"] for r in it.rejected().collect()}
    vo = {}
    for r in it.vendor_orders().collect():
        vo.setdefault(r["request_id"], {})[r["vendor_id"]] = r["subtotal"]
    for i, text_ in enumerate(batch):
        reason, subtotals = model(text_)
        assert rej.get(f"r{i}") == reason, text_
        assert vo.get(f"r{i}") == subtotals, text_
