"""As-of visibility, launch slots with refunds, repeated rows: against loops."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from marketspark.functions import expr as K
from marketspark.operators import orders as O
from marketspark.operators import ranking as R
from marketspark.operators import registry as G
from marketspark.operators import subscriptions as H
from marketspark.operators import visibility as V
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
EVENTS = "vendor_id string, seq long, ts timestamp_ntz, kind string, plan string, days int, notes string"


def ledger(seed, n, vendors=("a", "b", "c")):
    rng = random.Random(seed)
    rows = [(v, -1, T0, "trial", None, None, None) for v in vendors[:-1]]
    for i in range(n):
        kind = rng.choice(["pay", "pay", "refund", "grant", "suspend", "resume", "cancel", "trial", "odd"])
        plan = rng.choice(["launch", "launch", "launch", "monthly", "bogus", None]) if kind in ("pay", "refund") else None
        # a hot vendor; many events at the same time
        rows.append((rng.choice([vendors[0]] * 4 + list(vendors)), i, T0 + dt.timedelta(hours=6 * rng.randrange(n)), kind, plan,
                     rng.choice([None, 0, 1, 5]) if kind == "grant" else None, None))
    return rows


def replay(rows):
    """The calls one by one: verdicts, and the row after each accepted call."""
    state, verdict, history = {}, {}, {}
    for v, seq, ts, kind, plan, days, _ in sorted(set(rows), key=lambda r: (r[0], r[2], r[1])):
        s = state.get(v)
        if kind not in H.KINDS:
            verdict[v, seq] = "invalid_action"
            continue
        if kind == "trial":
            verdict[v, seq] = "subscription_exists" if s else None
            if not s:
                state[v] = {"plan": "trial", "status": "trial", "end": ts + dt.timedelta(days=30), "slots": 0}
                history.setdefault(v, []).append((ts, dict(state[v])))
            continue
        if not s:
            verdict[v, seq] = "subscription_not_found"
            continue
        reason = None
        if kind in ("pay", "refund") and plan not in H.PLAN_DAYS:
            reason = "invalid_plan"
        elif kind == "pay" and plan == "launch" and s["slots"] >= 3:
            reason = "launch_limit_reached"
        elif kind == "refund" and plan == "launch" and s["slots"] == 0:
            reason = "nothing_to_refund"
        elif kind == "grant" and not (days and 1 <= days <= 365):
            reason = "invalid_days"
        verdict[v, seq] = reason
        if reason:
            continue
        if kind == "refund":
            s["slots"] -= plan == "launch"
            continue
        if kind == "pay":
            s.update(plan=plan, status="active", end=max(s["end"], ts) + dt.timedelta(days=H.PLAN_DAYS[plan]))
            s["slots"] += plan == "launch"
        elif kind == "grant":
            s["end"] = max(s["end"], ts) + dt.timedelta(days=days)
            s["status"] = "suspended" if s["status"] == "suspended" else "trial" if s["plan"] == "trial" else "active"
        elif kind == "resume":
            s["status"] = "trial" if s["plan"] == "trial" else "active"
        else:
            s["status"] = {"suspend": "suspended", "cancel": "cancelled"}[kind]
        history.setdefault(v, []).append((ts, dict(s)))
    return verdict, history


def live_then(history, vendor, at):
    rows = [s for ts, s in history.get(vendor, []) if ts <= at]
    return bool(rows) and rows[-1]["status"] in ("trial", "active") and rows[-1]["end"] > at


@pytest.mark.parametrize("seed", range(3))
def test_ledger_equals_a_replay(spark, seed):
    rows = ledger(seed, 120)
    rows += rows[5:25]                                  # delivered twice
    verdict, history = replay(rows)
    events = spark.createDataFrame(rows, EVENTS).repartition(5)
    c = H.classify_events(events)
    assert {(r.vendor_id, r.seq): r.reason for r in c.collect()} == verdict
    spans = sorted((r.vendor_id, r.live_from, r.live_to) for r in H.live_intervals(c).collect())
    for a, b in zip(spans, spans[1:]):
        assert a[0] != b[0] or a[2] <= b[1]             # disjoint
    times = [T0 + dt.timedelta(hours=3 * h) for h in range(-2, 500)]
    asked = spark.createDataFrame([(f"{v}{i}", v, t) for v in "abcx" for i, t in enumerate(times)] + [("none", "a", None)],
                                  "id string, vendor string, at timestamp_ntz")
    got = {r.id: r.live for r in V.live_at(asked, H.live_intervals(c), "vendor", "at").collect()}
    assert got == {f"{v}{i}": live_then(history, v, t) for v in "abcx" for i, t in enumerate(times)} | {"none": False}


def test_intake_sees_products_as_of_each_request(spark):
    events = spark.createDataFrame([("v1", 1, T0, "trial", None, None, None), ("v1", 2, T0 + dt.timedelta(days=5), "suspend", None, None, None),
                                    ("v1", 3, T0 + dt.timedelta(days=9), "resume", None, None, None)], EVENTS)
    live = H.live_intervals(H.classify_events(events))
    products = spark.createDataFrame([("p1", "v1", "Soap", Decimal("10.00"), True, None, None)],
                                     "id string, vendor string, name string, price decimal(18,2), in_stock boolean, image string, size string")
    rows = [(f"d{d}{who}", "u", T0 + dt.timedelta(days=d), "Ada", "0801", None, "St", '[{"id":"p1","qty":1}]', *claims)
            for d in (-1, 0, 4, 5, 8, 9, 29, 30, 31) for who, claims in (("", ("authenticated", None)), ("o", ("vendor", "v1")), ("x", ("vendor", "v2")), ("a", ("admin", None)))]
    reqs = spark.createDataFrame(rows, "request_id string, user_id string, requested_at timestamp_ntz, customer_name string, customer_phone string, "
                                       "customer_email string, customer_address string, items string, caller_role string, caller_vendor_id string")
    it = O.intake(reqs, products, live)
    seen = {0, 4, 9, 29}
    placed = {r.request_id for r in it.orders().collect()}
    assert placed == {f"d{d}{w}" for d in (-1, 0, 4, 5, 8, 9, 29, 30, 31) for w in ("", "o", "x", "a") if d in seen or w in ("o", "a")}
    assert {r.request_id for r in it.rejected().collect()} == {r[0] for r in rows} - placed
    check = {r.request_id: r.available for r in O.availability_check(it.screened, products, live).collect()}
    assert {k for k, ok in check.items() if ok} == placed and len(check) == len(rows)


def test_transition_scan_equals_a_loop_over_split_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), rng.randrange(300), rng.randrange(3), i) for i in range(800)]
    table = [[1, 2, 3, 3], [0, 0, 1, 2], [0, 1, 2, 3]]
    df = spark.createDataFrame(rows, "g string, k int, m int, i int").repartition(6)
    step = F.element_at(F.lit(table), F.col("m") + 1)
    got = {r.i: r.state for r in R.transition_scan(df, ["g"], ["k", "i"], step, 4, 0, num_partitions=7).collect()}
    want, at = {}, {}
    for g, _, m, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        want[i] = at.get(g, 0)
        at[g] = table[m][at.get(g, 0)]
    assert got == want


def test_repeated_rows_stay_as_many(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 1, 5), ("g", 2, 7), (None, 1, 1), (None, 1, 1)], "g string, k int, d int")
    assert sorted((r.g or "", r.k, r["rank"]) for r in R.rank_within(df, ["g"], ["k"]).collect()) == [("", 1, 1), ("", 1, 2), ("g", 1, 1), ("g", 1, 2), ("g", 2, 3)]
    ends = R.extend_scan(df, ["g"], ["k"], "k", "d", "end").collect()
    assert sorted((r.g or "", r.end) for r in ends) == [("", 2), ("", 3), ("g", 6), ("g", 11), ("g", 18)]


@pytest.mark.parametrize("text,reason,n", [
    ('[{"id":"p","qty":1}]', None, 1), (' [ {"id":"p","qty":"9"} ] ', None, 1), ('{"id":"p","qty":1}', O.R_COUNT, None), ("[]", O.R_COUNT, None),
    ("[5]", O.R_ITEM, None), ("[null]", O.R_ITEM, None), ("[[1]]", O.R_ITEM, None), ('[{"id":"p","qty":3.0}]', O.R_ITEM, None),
    ('[{"id":"p","qty":1}] x', O.R_COUNT, None), ('[{"id":"p","qty":1}]]', O.R_COUNT, None), ('[{"id":"p","qty":1}],[{"id":"q","qty":1}]', O.R_COUNT, None),
    ('[{"id":"p","qty":1}],[{"id":"q"}]] x', O.R_COUNT, None), ("", O.R_COUNT, None), ("null", O.R_COUNT, None), (None, O.R_COUNT, None),
    ('[{"id":"p","qty":"5\\n"}]', O.R_ITEM, None), ('[{"qty":2}]', O.R_ITEM, None), ("[" + ",".join(['{"id":"p","qty":1}'] * 51) + "]", O.R_COUNT, None)])
def test_items_are_one_json_list(spark, text, reason, n):
    r = O.parse_items(spark.createDataFrame([(text,)], "items string")).select("item_reason", F.size("lines").alias("n")).first()
    assert r.item_reason == reason and (n is None or r.n == n)


def test_item_text_is_parsed_once(spark):
    df = O.parse_items(spark.createDataFrame([("x",)], "items string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_line_ends_and_white_space_in_texts(spark):
    df = spark.createDataFrame([("a@b.co",), ("a@b.co\n",), ("store.html",), (" \t store.html\n",), ("store.html\nx",)], "x string")
    got = [tuple(r) for r in df.select(K.email_ok("x"), K.safe_url("x")).collect()]
    assert got == [(True, "index.html"), (False, "index.html"), (False, "store.html"), (False, "store.html"), (False, "index.html")]


def test_a_malformed_number_fails_its_own_change_only(spark):
    rows = [(i, "upsert", f"shop{i}", f"s{i}@x.org", "2348012345678", f"Shop {i}", rating, count, T0)
            for i, (rating, count) in enumerate([("4.5", "3"), ("abc", "3"), ("", None), ("4", "1x"), ("100", "2")])]
    changes = spark.createDataFrame(rows, "seq long, op string, id string, email string, whatsapp string, name string, rating string, review_count string, ts timestamp_ntz")
    staff = spark.createDataFrame([], "email string, role string, vendor_id string, user_id string")
    c = G.clean_vendor_changes(changes, staff)
    assert [r.reason for r in c.orderBy("seq").collect()] == [None, "invalid_number", None, "invalid_number", "invalid_number"]
    none = spark.createDataFrame([], "vendor_id string")
    vendors = spark.createDataFrame([], "id string, name string, whatsapp string, rating decimal(3,1), review_count int, categories array<string>, page string")
    assert sorted((r.vendor_id, str(r.rating), r.review_count) for r in G.merge_vendors(vendors, G.accepted_vendor_changes(c, none)).collect()) == [
        ("shop0", "4.5", 3), ("shop2", "5.0", 0)]
