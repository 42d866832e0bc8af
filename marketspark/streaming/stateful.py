"""Keyed state of the cart (M2) and ledger (M3) streams, for
transformWithState on the RocksDB state store: state is read and written
entry by entry and need not fit in memory. A key's rows are folded one by
one; data frames per key would cost more than most keys' rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import subscriptions as H

NEVER = np.iinfo(np.int64).min                # stands for a missing time, before all others
DAY_US = 86_400_000_000
_EPOCH = dt.datetime(1970, 1, 1)


def _time(us) -> dt.datetime | None:
    return None if us is None or us == NEVER else _EPOCH + dt.timedelta(microseconds=us)


# ---- M2 ------------------------------------------------------------------------

CART_OUT = ("user_id string, product_id string, qty int, added_at timestamp_ntz, added_seq long, "
            "name string, price decimal(18,2), original_price decimal(18,2), vendor string, row_kind string")
_cart_row = Row(*[c.split()[0] for c in CART_OUT.replace("(18,2)", "").split(",")])
CART_LINE = ("qty long, added_us long, added_seq long, name string, price decimal(18,2), "
             "original_price decimal(18,2), vendor string")


def resets(ev: pd.DataFrame) -> tuple[int, pd.Series]:
    """Of one user's events in order: the place of the last clear (-1: none)
    and, per row, the place of its product's last removal or that clear."""
    at = np.arange(len(ev))
    cleared = int(at[(ev["kind"] == "clear").to_numpy()].max(initial=-1))
    removal = (ev["kind"] == "remove") | ((ev["kind"] == "set") & (ev["qty"] <= 0))
    removed = pd.Series(np.where(removal, at, -1)).groupby(ev["product_id"].to_numpy(), dropna=False).transform("max")
    return cleared, removed.clip(lower=cleared)


def compact(ev: pd.DataFrame) -> pd.DataFrame:
    """The events of one user, in order, that can still decide a line whatever
    other events of the micro-batch come: the last clear, each product's last
    removal after it, and the adds and the last positive set after both."""
    ev = (ev.sort_values(["us", "seq", "kind", "product_id"], kind="stable").drop_duplicates(["us", "seq"]).reset_index(drop=True))
    cleared, reset = resets(ev)
    at = np.arange(len(ev))
    is_set = ((ev["kind"] == "set") & (ev["qty"] > 0)).to_numpy()
    last_set = pd.Series(np.where(is_set, at, -1)).groupby(ev["product_id"].to_numpy(), dropna=False).transform("max").to_numpy()
    after = at > reset.to_numpy()
    keep = ((at == cleared) | ((ev["kind"] == "add").to_numpy() & after) | (is_set & after & (at == last_set))
            | ((at == reset.to_numpy()) & (at > cleared)))
    return ev[keep].reset_index(drop=True)


_EVENT = ["us", "seq", "kind", "product_id", "qty", "name", "price", "original_price", "vendor"]
_CHUNK = 10_000            # events of a user held before they are first summed up


def _in_order(e: tuple):
    return e[0], e[1], e[2] is None, e[2] or "", e[3] is None, e[3] or ""


def summed_up(events: list[tuple]) -> list[tuple]:
    """compact() of events as tuples."""
    kept = compact(pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "qty" else "int64" if c in ("us", "seq") else "object")
                                 for c, v in zip(_EVENT, zip(*events))}))
    kept["qty"] = kept["qty"].astype("object").where(kept["qty"].notna(), None)
    return list(kept.itertuples(index=False, name=None))


class Cart(StatefulProcessor):
    """One entry per product of the user's cart, and the last event applied.

    A micro-batch's events of a user are folded as C1 does, in order. What is
    held of them is summed up as it grows to what can still decide a line, so
    a user with any number of events between resets costs the adds since then.
    Only the products named in the batch are read and written.

    Rows out: `line` (a product's line as it is now), `gone` (its line went),
    `clear` (all lines of earlier batches went), `late` (an event not later
    than the last one of earlier batches: set aside, not applied). Of events
    of one batch with the same (ts, seq) one counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "product_id string", CART_LINE)
        self.last = handle.getValueState("last", "us long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        user = key[0]
        last = self.last.get()
        newest = None
        held: list[tuple] = []
        most = _CHUNK
        for r in rows:
            us, seq = NEVER if r.us is None else r.us, NEVER if r.seq is None else r.seq
            if last is not None and (us, seq) <= (last[0], last[1]):
                yield _cart_row(user, r.product_id, None if r.qty is None else int(r.qty), _time(us), r.seq, None, None, None, None, "late")
                continue
            if newest is None or (us, seq) > newest:
                newest = us, seq
            held.append((us, seq, r.kind, r.product_id, r.qty, r.name, r.price, r.original_price, r.vendor))
            if len(held) > most:
                held = summed_up(held)
                most = max(_CHUNK, 2 * len(held))
        if newest is not None:
            self.last.update(newest)
            yield from self._apply(user, held, last is not None)

    def _apply(self, user, events: list[tuple], known: bool) -> Iterator[Row]:
        """The rows out of one user's events; `known`: there may be lines of
        earlier batches."""
        before: dict[str, tuple | None] = {}       # of the products named since the last clear
        lines: dict[str, list | None] = {}
        cleared, at = False, None
        for us, seq, kind, product, qty, *snap in sorted(events, key=_in_order):
            if (us, seq) == at:
                continue
            at = us, seq
            if kind == "clear":
                cleared = True
                before.clear()
                lines.clear()
                continue
            removal = kind == "remove" or (kind == "set" and qty is not None and qty <= 0)
            if product is None or not (removal or kind == "add" or (kind == "set" and qty is not None)):
                continue
            if product not in lines:
                was = self.lines.getValue((product,)) if known and not cleared else None
                before[product] = was
                lines[product] = None if was is None else list(was)
            line = lines[product]
            if removal:
                lines[product] = None
            elif kind == "add":
                if line is None:
                    line = lines[product] = [0, us, seq, *snap]
                line[0] += int(qty or 0)
            elif line is not None:
                line[0] = int(qty)
        if cleared:
            if known:
                self.lines.clear()
            yield _cart_row(user, None, None, None, None, None, None, None, None, "clear")
        for product, line in lines.items():
            if line is not None:
                self.lines.updateValue((product,), tuple(line))
                yield _cart_row(user, product, line[0], _time(line[1]), *line[2:], "line")
            elif before[product] is not None:
                self.lines.removeKey((product,))
                yield _cart_row(user, product, None, None, None, None, None, None, None, "gone")


# ---- M3 ------------------------------------------------------------------------

SUB_OUT = ("vendor_id string, plan string, status string, access_started_at timestamp_ntz, "
           "current_period_start timestamp_ntz, access_ends_at timestamp_ntz, last_payment_at timestamp_ntz, "
           "updated_at timestamp_ntz, n_payments long, n_late long, row_kind string, late_seq long, late_kind string")
_sub_row = Row(*[c.split()[0] for c in SUB_OUT.split(",")])
SUB_ROW = ("plan string, status string, started long, period long, ends long, paid long, updated long, "
           "launch int, n_payments long")
SUB_EVENT = "us long, seq long, kind string, plan string, days int"


def ledger_step(s: dict | None, us: int, kind: str, plan: str | None, days: int | None) -> dict | None:
    """One event of the ledger applied to a vendor's row, as the payment and
    management calls do; events that those calls refuse change nothing."""
    if kind == "trial":
        return s or {"plan": "trial", "status": "trial", "started": us, "period": us, "ends": us + H.TRIAL_DAYS * DAY_US,
                     "paid": None, "updated": us, "launch": 0, "n_payments": 0}
    if s is None:
        return None
    running = "trial" if s["plan"] == "trial" else "active"
    if kind == "refund":                      # gives a launch slot back, leaves the rest as it is
        return {**s, "launch": s["launch"] - 1} if plan == "launch" and s["launch"] > 0 else s
    if kind == "pay":
        if plan not in H.PLAN_DAYS or (plan == "launch" and s["launch"] >= H.LAUNCH_LIMIT):
            return s
        start = max(s["ends"], us)
        return {**s, "plan": plan, "status": "active", "period": start, "ends": start + H.PLAN_DAYS[plan] * DAY_US, "paid": us,
                "updated": us, "launch": s["launch"] + (plan == "launch"), "n_payments": s["n_payments"] + 1}
    if kind == "grant":
        if days is None or not H.GRANT_MIN_DAYS <= days <= H.GRANT_MAX_DAYS:
            return s
        return {**s, "ends": max(s["ends"], us) + days * DAY_US, "status": s["status"] if s["status"] == "suspended" else running, "updated": us}
    status = {"suspend": "suspended", "cancel": "cancelled", "resume": running}.get(kind)
    return s if status is None else {**s, "status": status, "updated": us}


class Ledger(StatefulProcessor):
    """One row per vendor, and the events that wait for the watermark.

    An event waits in state until the watermark has passed its time; a timer
    then applies all that are due in (ts, seq) order, and they leave the
    state. Order of arrival does not matter inside the watermark's delay. An
    event whose time the watermark had passed before it came is not applied:
    it is counted, and emitted as a `late` row (so is one without a time).
    An event that comes twice while it waits counts once. Events without a
    vendor only move the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", SUB_ROW)
        self.waiting = handle.getListState("waiting", SUB_EVENT)
        self.n_late = handle.getValueState("n_late", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        mark = timerValues.getCurrentWatermarkInMs()
        due, n_late = None, 0
        new: list[tuple] = []
        for r in rows:
            us = NEVER if r.us is None else r.us
            if us // 1000 <= mark:
                n_late += 1
                yield _sub_row(key[0], r.plan, None, None, None, None, None, _time(us), None, None, "late", r.seq, r.kind)
                continue
            new.append((us, r.seq, r.kind, r.plan, r.days))
            due = us // 1000 if due is None else min(due, us // 1000)
            if len(new) == _CHUNK:
                self.waiting.appendList(new)
                new = []
        if n_late:
            before = self.n_late.get()
            self.n_late.update(((before[0] if before else 0) + n_late,))
        if new:
            self.waiting.appendList(new)
        if due is not None:                   # every waiting event has a timer at or before its time
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        events = sorted({tuple(e) for e in self.waiting.get()}, key=lambda e: (e[0], e[1], str(e[2:])))
        due = [e for e in events if e[0] // 1000 <= mark]
        if not due:
            return
        rest = events[len(due):]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
        names = [c.split()[0] for c in SUB_ROW.split(",")]
        row = self.row.get()
        s = None if row is None else dict(zip(names, row))
        for us, _, kind, plan, days in due:
            s = ledger_step(s, us, kind, plan, days)
        if s is None:
            return
        self.row.update(tuple(s[c] for c in names))
        n_late = self.n_late.get()
        yield _sub_row(key[0], s["plan"], s["status"], _time(s["started"]), _time(s["period"]), _time(s["ends"]), _time(s["paid"]),
                       _time(s["updated"]), s["n_payments"], n_late[0] if n_late else 0, "row", None, None)
