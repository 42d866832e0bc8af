"""Property tests: the closed-form folds and the distributed scans equal
plain Python loops on random inputs."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketspark.operators import cart as C
from marketspark.operators import ranking as R
from marketspark.operators import subscriptions as H

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def cart_loop(events):
    """The browser's cart, event by event."""
    carts = {}
    for user, seq, kind, pid, qty in sorted(events, key=lambda e: (e[1], e[0])):
        lines = carts.setdefault(user, {})
        if kind == "clear":
            lines.clear()
        elif kind == "remove" or (kind == "set" and qty <= 0):
            lines.pop(pid, None)
        elif kind == "set":
            if pid in lines:
                lines[pid][0] = qty
        elif kind == "add":
            if pid in lines:
                lines[pid][0] += qty
            else:
                lines[pid] = [qty, seq]
    return {(u, p): (v[0], v[1]) for u, ls in carts.items() for p, v in ls.items()}


event = st.tuples(st.sampled_from(["u1", "u2"]), st.sampled_from(["add", "add", "set", "remove", "clear"]),
                  st.sampled_from(["p1", "p2", "p3"]), st.integers(-1, 4))


@SETTINGS
@given(st.lists(event, min_size=1, max_size=40))
def test_cart_closed_form_equals_loop(spark, evs):
    rows = [(u, i, k, p if k != "clear" else None, q) for i, (u, k, p, q) in enumerate(evs)]
    df = spark.createDataFrame(
        [(u, s, T0 + dt.timedelta(seconds=s), k, p, q, ("n", Decimal("1.00"), None, "v")) for u, s, k, p, q in rows],
        "user_id string, seq long, ts timestamp_ntz, kind string, product_id string, qty int, "
        "snap struct<name:string,price:decimal(18,2),original_price:decimal(18,2),vendor:string>")
    got = {(r["user_id"], r["product_id"]): (r["qty"], r["added_seq"]) for r in C.cart_state(df).collect()}
    assert got == cart_loop(rows)


def ledger_loop(events):
    end = {}
    out = {}
    for v, seq, ts, d in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        e = max(end.get(v, ts), ts) + d
        end[v] = e
        out[(v, seq)] = e
    return out


ext = st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 500), st.integers(0, 400))


@SETTINGS
@given(st.lists(ext, min_size=1, max_size=60))
def test_extend_scan_equals_loop(spark, evs):
    rows = [(v, i, t, d) for i, (v, t, d) in enumerate(evs)]
    df = spark.createDataFrame(rows, "v string, seq long, t long, d long")
    got = {(r["v"], r["seq"]): r["end_us"] for r in
           R.extend_scan(df, ["v"], ["t", "seq"], "t", "d", "end_us", num_partitions=3).collect()}
    assert got == ledger_loop(rows)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", "hot"]), st.integers(0, 50)), min_size=1, max_size=80))
def test_rank_within_equals_sorted(spark, rows):
    data = [(g, k, i) for i, (g, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, k int, i long")
    got = {r["i"]: r["rank"] for r in R.rank_within(df, ["g"], ["k", "i"], num_partitions=4).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for n, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])), 1):
            want[d[2]] = n
    assert got == want


def test_ledger_state_matches_stream_fold(spark):
    """Batch ledger vs the stream's step applied event by event (plain Python)."""
    import pandas as pd
    from marketspark.streaming.stateful import ledger_step

    ev = [("v", -1, T0, "trial", None, 30, None)]
    kinds = ["pay", "grant", "suspend", "resume", "cancel"]
    plans = ["launch", "monthly", "annual", "bogus"]
    for i in range(1, 40):
        k = kinds[i % 4]
        ev.append(("v", i, T0 + dt.timedelta(days=i * 3), k, plans[i % 4] if k == "pay" else None,
                   (i * 7) % 40 if k == "grant" else None, None))
    df = spark.createDataFrame(ev, "vendor_id string, seq long, ts timestamp_ntz, kind string, plan string, "
                                   "days int, notes string")
    c = H.classify_events(df)
    batch = H.subscription_state(c, H.renewal_periods(c)).collect()[0]

    row = None
    for _, _, ts, kind, plan, days, _ in ev:
        row = ledger_step(row, int(pd.Timestamp(ts).value) // 1000, kind, plan, days)
    at = lambda us: pd.Timestamp(us, unit="us")
    out = {**row, "access_ends_at": at(row["ends"]), "current_period_start": at(row["period"])}
    assert out["status"] == batch["status"] and out["plan"] == batch["plan"]
    assert pd.Timestamp(out["access_ends_at"]) == pd.Timestamp(batch["access_ends_at"])
    assert pd.Timestamp(out["current_period_start"]) == pd.Timestamp(batch["current_period_start"])
    assert out["n_payments"] == batch["n_payments"]
