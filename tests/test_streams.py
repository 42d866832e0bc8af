"""Stream over several micro-batches = batch over their union."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from marketspark.operators import subscriptions as H
from marketspark.operators.cart import cart_state
from marketspark.session import scratch_path
from marketspark.streaming import streams as M
from marketspark.streaming.stateful import compact

SMALL = "/root/testdata/sf0.001"

PAIRS = [("stream_order_intake", "split_by_vendor"), ("stream_cart_state", "cart_state"),
         ("stream_subscriptions", "subscription_state"), ("stream_wishlist", "wishlist_state"),
         ("stream_promo_tag", "promo_impressions"), ("stream_status", "apply_status_changes")]


@pytest.mark.parametrize("stream_key,batch_key", PAIRS)
def test_stream_equals_batch(spark, entry, stream_key, batch_key):
    s = entry.queries()[stream_key](spark, SMALL)
    b = entry.queries()[batch_key](spark, SMALL).select(*s.columns)
    assert rows_of(s) == rows_of(b)


T0 = dt.datetime(2024, 1, 1)
CART = ("user_id string, seq long, ts timestamp_ntz, kind string, product_id string, qty int, "
        "snap struct<name:string,price:decimal(18,2),original_price:decimal(18,2),vendor:string>")


def _cart_runs(spark, batches):
    """The cart job over the batches, one run each: (lines, late seqs, rows of the last run)."""
    src, base = scratch_path(spark, "cart-src-" + uuid.uuid4().hex), scratch_path(spark, "cart-base-" + uuid.uuid4().hex)
    for rows in batches:
        spark.createDataFrame(rows, CART).coalesce(1).write.mode("append").parquet(src)
        M.run_to_sink(M.stream_cart_state(spark.readStream.schema(CART).parquet(src)), base, "update", M.cart_batch)
    lines = sorted((r.user_id, r.product_id, r.qty, r.added_seq, r.name, r.price) for r in M.read_carts(spark, f"{base}/sink").collect())
    late = sorted(r.added_seq for r in M.read_all(spark, f"{base}/late", M.CART_OUT).collect())
    return lines, late, spark.read.parquet(f"{base}/sink").filter(F.col("batch_id") == len(batches) - 1).collect()


def _add(user, seq, product, qty, kind="add", name="n"):
    return (user, seq, T0 + dt.timedelta(minutes=seq), kind, product, qty, (name, Decimal("1.50"), None, "v"))


def test_cart_state_is_kept_per_line(spark):
    """Late events are set aside; a clear empties lines that the batch does not
    name; a batch writes only the lines it changes."""
    batches = [[_add("u", 2, "p1", 2), _add("u", 3, "p2", 1), _add("w", 3, "p1", 1)],
               [_add("u", 1, None, None, "clear"), _add("u", 4, "p1", 1, name="later"), _add("u", 5, "p1", 9, "remove"),
                _add("u", 6, "p1", 4, name="again"), _add("u", 7, "p2", 0, "set"), _add(None, 8, "p1", 1), _add("u", 9, None, 1)],
               [_add("w", 10, "p1", 5, "set"), _add("w", 11, "p9", 5, "set"), _add("u", 12, None, None, "clear"), _add("u", 13, "p3", 1)]]
    lines, late, _ = _cart_runs(spark, batches[:2])
    assert late == [1]
    assert lines == [("u", "p1", 4, 6, "again", Decimal("1.50")), ("w", "p1", 1, 3, "n", Decimal("1.50"))]
    lines, late, last = _cart_runs(spark, batches)
    assert lines == [("u", "p3", 1, 13, "n", Decimal("1.50")), ("w", "p1", 5, 3, "n", Decimal("1.50"))]
    assert sorted((r.user_id, r.product_id, r.row_kind) for r in last if r.product_id) == [("u", "p3", "line"), ("w", "p1", "line")]


def test_one_user_with_very_many_events_in_a_batch(spark):
    """100,000 events of one user: the stream agrees with the batch fold."""
    e = spark.range(100_000).select(
        F.lit("u").alias("user_id"), F.col("id").alias("seq"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"),
        F.expr("CASE WHEN id = 60000 THEN 'clear' ELSE element_at(array('add', 'add', 'set', 'remove', 'add', 'add', 'add'), cast(1 + xxhash64(id) % 3 + 3 as int)) END").alias("kind"),
        F.expr("'p' || (xxhash64(id, 1) % 20000)").alias("product_id"), F.expr("cast(1 + pmod(id, 5) as int)").alias("qty"),
        F.expr("named_struct('name', 'n' || id, 'price', cast(id as decimal(18,2)), 'original_price', cast(null as decimal(18,2)), 'vendor', 'v')").alias("snap"))
    base = M.replay_to_sink(e.repartition(8), "many", "ts", M.stream_cart_state, "update", M.cart_batch, n_batches=1)
    got = sorted((r.product_id, r.qty, r.added_seq, r.name) for r in M.read_carts(spark, f"{base}/sink").collect())
    assert got == sorted((r.product_id, r.qty, r.added_seq, r.snap["name"]) for r in cart_state(e).collect()) and len(got) > 1000


def test_compact_drops_nothing_that_counts():
    """The chunk summary is a fixed point of any split of a user's events."""
    import random

    import pandas as pd
    rnd = random.Random(3)
    for _ in range(100):
        ev = pd.DataFrame([(i, i, rnd.choice(["add", "add", "set", "remove", "clear"]), rnd.choice("ab"), rnd.randint(-1, 3)) for i in range(rnd.randint(1, 12))],
                          columns=["us", "seq", "kind", "product_id", "qty"])
        mixed = ev.sample(frac=1, random_state=rnd.randint(0, 99))
        cut = rnd.randint(0, len(ev))
        held = compact(mixed[:cut]) if cut else mixed[:0]
        whole = compact(pd.concat([held, mixed[cut:]], ignore_index=True))
        assert whole.values.tolist() == compact(ev).values.tolist()


LEDGER = "vendor_id string, seq long, ts timestamp_ntz, kind string, plan string, days int, notes string"


def test_ledger_in_any_order_inside_the_watermark(spark):
    """Shuffled arrival gives the batch ledger; only what the watermark has
    passed is late; nothing is applied before its turn."""
    import random
    rnd = random.Random(5)
    ev = [(f"v{v}", -1, T0, "trial", None, None, None) for v in range(3)]
    for i in range(90):
        kind = rnd.choice(["pay", "grant", "suspend", "resume", "cancel", "refund"])
        ev.append((f"v{rnd.randrange(3)}", i, T0 + dt.timedelta(hours=3 * i + 1), kind,
                   rnd.choice(["launch", "monthly", "annual"]) if kind in ("pay", "refund") else None, rnd.randint(0, 40), None))
    log = spark.createDataFrame(ev, LEDGER)
    want = {r.vendor_id: r.asDict() for r in (lambda c: H.subscription_state(c, H.renewal_periods(c)))(H.classify_events(log)).collect()}
    arrival = sorted(ev, key=lambda e: (e[2] + dt.timedelta(hours=rnd.randrange(140)), e[1]))   # less than the delay of 7 days
    src, base = scratch_path(spark, "led-src-" + uuid.uuid4().hex), scratch_path(spark, "led-base-" + uuid.uuid4().hex)

    def run(rows):
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(src)
        M.run_to_sink(M.stream_subscriptions(spark.readStream.schema(LEDGER).parquet(src)), base, "update", M.ledger_batch)

    for i in range(0, len(arrival), 40):
        run(arrival[i:i + 40])
    assert M.read_all(spark, f"{base}/late", LEDGER).count() == 0
    run(M.tick(log).collect())
    run([("v0", 500, T0, "suspend", None, None, None)])
    got = {r.vendor_id: r.asDict() for r in M.read_latest(spark, f"{base}/sink", ["vendor_id"], M.SUB_OUT).collect()}
    assert {v: {k: r[k] for k in want[v]} for v, r in got.items()} == want
    assert [(r.vendor_id, r.late_seq) for r in M.read_all(spark, f"{base}/late", LEDGER).collect()] == [("v0", 500)]


def test_intake_stream_drops_repeated_requests(spark):
    """A request that arrives twice (a retried call) within the watermark is
    placed once."""
    import datetime as dt
    from decimal import Decimal
    from marketspark.streaming import streams as M

    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", "u1", t0, "Ada", "0801", None, "St", '[{"id":"p1","qty":1}]'),
            ("r2", "u2", t0 + dt.timedelta(days=2), "Bo", "0802", None, "St", '[{"id":"p1","qty":2}]'),
            ("r1", "u1", t0 + dt.timedelta(days=3), "Ada", "0801", None, "St", '[{"id":"p1","qty":1}]'),
            ("r3", "u3", t0 + dt.timedelta(days=4), "Cy", "0803", None, "St", '[{"id":"p1","qty":3}]')]
    reqs = spark.createDataFrame(rows, "request_id string, user_id string, requested_at timestamp_ntz, "
                                       "customer_name string, customer_phone string, customer_email string, "
                                       "customer_address string, items string")
    products = spark.createDataFrame([("p1", "v1", "Soap", Decimal("10.00"), True, None, None)],
                                     "id string, vendor string, name string, price decimal(18,2), "
                                     "in_stock boolean, image string, size string")
    base = M.replay_to_sink(reqs, "dup", "requested_at", M.stream_order_intake, "append",
                            M.intake_batch(products), n_batches=2)
    got = sorted((r["request_id"], r["subtotal"]) for r in M.read_all(spark, f"{base}/sink", "id string").collect())
    assert got == [("r1", Decimal("10.00")), ("r2", Decimal("20.00")), ("r3", Decimal("30.00"))]


def test_rejected_requests_and_rows_without_time_are_kept(spark):
    """Rejected requests go to a side table; a null time is no reason to
    lose a row; files are not gathered into one."""
    import datetime as dt
    from decimal import Decimal
    from marketspark.streaming import streams as M

    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", "u1", None, "Ada", "0801", None, "St", '[{"id":"p1","qty":1}]'),
            ("r2", None, t0, "Bo", "0802", None, "St", '[{"id":"p1","qty":2}]'),
            ("r3", "u3", t0 + dt.timedelta(days=4), "Cy", "0803", None, "St", '[{"id":"p9","qty":3}]'),
            ("r4", "u4", t0 + dt.timedelta(days=5), "Di", "0804", None, "St", '[{"id":"p1","qty":4}]')]
    reqs = spark.createDataFrame(rows, "request_id string, user_id string, requested_at timestamp_ntz, "
                                       "customer_name string, customer_phone string, customer_email string, "
                                       "customer_address string, items string").repartition(4)
    products = spark.createDataFrame([("p1", "v1", "Soap", Decimal("10.00"), True, None, None)],
                                     "id string, vendor string, name string, price decimal(18,2), "
                                     "in_stock boolean, image string, size string")
    base = M.replay_to_sink(reqs, "side", "requested_at", lambda s: s, "append", M.intake_batch(products), n_batches=2)
    placed = {r["request_id"] for r in M.read_all(spark, f"{base}/sink", "id string").collect()}
    rejected = {(r["request_id"], r["reason"]) for r in M.read_all(spark, f"{base}/rejected", "id string").collect()}
    assert placed == {"r1", "r4"}
    assert rejected == {("r2", "sign_in_required"), ("r3", "unavailable")}


def test_missing_sink_is_empty_but_other_errors_surface(spark):
    from marketspark.session import scratch_path
    from marketspark.streaming import streams as M
    assert M.read_all(spark, scratch_path(spark, "nowhere"), "a int").count() == 0
    bad = scratch_path(spark, "not-parquet")
    spark.range(3).selectExpr("cast(id as string) v").write.mode("overwrite").text(bad)
    with pytest.raises(Exception):
        M.read_all(spark, bad, "a int").count()


def _requests(spark, rows):
    return spark.createDataFrame(rows, "request_id string, user_id string, requested_at timestamp_ntz, customer_name string, "
                                       "customer_phone string, customer_email string, customer_address string, items string")


def test_every_request_of_the_stream_ends_up_in_a_table(spark):
    """Late, repeated, rejected and placed requests: nothing vanishes, and a
    batch run again after a failure writes the same."""
    import datetime as dt
    from decimal import Decimal
    from marketspark.session import scratch_path
    from marketspark.streaming import streams as M

    t0 = dt.datetime(2024, 6, 1)
    def req(i, days, pid="p1", user="u"):
        return (i, user, None if days is None else t0 + dt.timedelta(days=days), "Ada", "0801", None, "St", f'[{{"id":"{pid}","qty":1}}]')
    products = spark.createDataFrame([("p1", "v1", "Soap", Decimal("10.00"), True, None, None)],
                                     "id string, vendor string, name string, price decimal(18,2), in_stock boolean, image string, size string")
    src, base = scratch_path(spark, "m1-src"), scratch_path(spark, "m1-base")
    batches = [[req("a", 0), req("b", 1), req("a", 0), req("n", None)],
               [req("old", -150), req("b", 2), req("c", 3, "p9"), req("d", 4), req("n", 4)],
               [req("b", 5), req("e", 40, user=None)], [req("f", 9), req("g", 41)]]
    for rows in batches:
        _requests(spark, rows).coalesce(1).write.mode("append").parquet(src)
        M.run_to_sink(spark.readStream.schema(_requests(spark, []).schema).parquet(src), base, "append", M.intake_batch(products))
    got = {t: sorted(r["request_id"] for r in spark.read.parquet(f"{base}/{t}").collect()) for t in ("sink", "rejected", "repeated", "late")}
    assert got == {"sink": ["a", "b", "d", "g", "n"], "rejected": ["c", "e"], "repeated": ["a", "b", "b", "n"], "late": ["f", "old"]}
    assert sum(map(len, got.values())) == sum(map(len, batches))
    past = M.Past(spark, base, 1)
    again = M.intake_batch(products)(_requests(spark, batches[1]), past)
    assert sorted(r.request_id for r in again["sink"].collect()) == ["d"]
    assert sorted(r.request_id for r in again["late"].collect()) == ["old"]


class _Kept:
    """State of one key, held in memory: what the state classes call of it."""

    def __init__(self):
        self.value, self.map, self.reads = None, {}, 0

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def getValue(self, k):
        self.reads += 1
        return self.map.get(k)

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        self.map.pop(k, None)

    def clear(self):
        self.map.clear()


def test_cart_rows_are_folded_one_by_one(monkeypatch):
    """Rows, no data frame per user; summing up what is held changes nothing;
    a new user's lines are not looked up."""
    import random

    from pyspark.sql import Row
    from marketspark.streaming import stateful
    rnd = random.Random(7)
    event = Row("user_id", "us", "seq", "kind", "product_id", "qty", "name", "price", "original_price", "vendor")
    ev = [event("u", i // 3, i, rnd.choice(["add", "add", "add", "set", "remove", "clear"] if i % 9 else ["add"]), f"p{rnd.randrange(4)}",
                float(rnd.randint(-1, 3)), f"n{i}", Decimal(i), None, "v") for i in range(400)]
    runs = []
    for most in (5, 10_000):
        monkeypatch.setattr(stateful, "_CHUNK", most)
        cart, kept, out = stateful.Cart(), _Kept(), []
        cart.init(kept)
        for part in (ev[:200], ev[200:], ev[:3]):
            out.append(sorted(map(str, cart.handleInputRows(("u",), iter(rnd.sample(part, len(part))), None))))
            assert len(out) > 1 or kept.reads == 0
        assert all("late" in r for r in out[2]) and len(out[2]) == 3
        runs.append((out[:2], kept.map, kept.value))
    assert runs[0] == runs[1] and runs[0][1]
