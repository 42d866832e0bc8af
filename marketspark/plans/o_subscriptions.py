"""Oracle SQL for the subscription ledger (H1-H9): the access end is
replayed event by event with a recursive CTE, as the calls would run."""

from .oracle import ADAPTERS, oracle

ADAPTERS["mk_sub_events"] = """
SELECT 'v' || s_suppkey AS vendor_id, CAST(-1 AS BIGINT) AS seq, TIMESTAMP '2023-12-15 00:00:00' AS ts,
       'trial' AS kind, CAST(NULL AS VARCHAR) AS plan, 30 AS days, CAST(NULL AS VARCHAR) AS notes
FROM supplier
UNION ALL
SELECT 'v' || (user_id % (SELECT count(*) FROM supplier)), event_id, ts,
       CASE event_type WHEN 'purchase' THEN 'pay' WHEN 'click' THEN 'grant'
            WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'suspend' WHEN 1 THEN 'cancel' ELSE 'refund' END
            WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'resume' ELSE 'grant' END ELSE 'pay' END,
       CASE WHEN event_type = 'signup' THEN 'launch'
            WHEN event_type = 'error' THEN CASE event_id % 12 WHEN 2 THEN 'monthly' WHEN 3 THEN NULL ELSE 'launch' END
            WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'launch' WHEN 1 THEN 'monthly'
                 WHEN 2 THEN 'annual' ELSE 'bogus' END END,
       CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value) AS INTEGER) % 40 END,
       CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'ref ' || event_id END
FROM events, unnest(CASE WHEN event_id % 29 = 0 THEN [1, 2] ELSE [1] END) AS d(delivery)"""

# an event delivered twice counts once
ADAPTERS["s_events"] = "SELECT DISTINCT * FROM mk_sub_events"

ADAPTERS["s_ft"] = """
SELECT vendor_id, ts AS t0_ts, seq AS t0_seq FROM (
  SELECT vendor_id, ts, seq, row_number() OVER (PARTITION BY vendor_id ORDER BY ts, seq) AS rn
  FROM s_events WHERE kind = 'trial') WHERE rn = 1"""

ADAPTERS["s_base"] = """
SELECT e.*, f.t0_ts, f.t0_seq,
       f.t0_ts IS NOT NULL AND (e.ts > f.t0_ts OR (e.ts = f.t0_ts AND e.seq > f.t0_seq)) AS after_trial,
       f.t0_ts IS NOT NULL AND e.ts = f.t0_ts AND e.seq = f.t0_seq AS is_first_trial
FROM s_events e LEFT JOIN s_ft f USING (vendor_id)"""

# launch slots replayed move by move
ADAPTERS["s_moves"] = """
SELECT vendor_id, seq, kind, row_number() OVER (PARTITION BY vendor_id ORDER BY ts, seq) AS n
FROM s_base WHERE kind IN ('pay', 'refund') AND plan = 'launch' AND after_trial"""

ADAPTERS["s_launch"] = """
SELECT vendor_id, seq, n, 0 AS used, CASE kind WHEN 'pay' THEN 1 ELSE 0 END AS then_used FROM s_moves WHERE n = 1
UNION ALL
SELECT m.vendor_id, m.seq, m.n, l.then_used,
       CASE m.kind WHEN 'pay' THEN least(l.then_used + 1, 3) ELSE greatest(l.then_used - 1, 0) END
FROM s_launch l JOIN s_moves m ON m.vendor_id = l.vendor_id AND m.n = l.n + 1"""

ADAPTERS["s_cls"] = """
SELECT b.vendor_id, b.seq, b.ts, b.kind, b.plan, b.days, b.notes,
  CASE WHEN b.kind IS NULL OR b.kind NOT IN ('trial', 'pay', 'grant', 'suspend', 'resume', 'cancel', 'refund') THEN 'invalid_action'
       WHEN b.kind = 'trial' AND b.is_first_trial THEN NULL
       WHEN b.kind = 'trial' THEN 'subscription_exists'
       WHEN NOT b.after_trial THEN 'subscription_not_found'
       WHEN b.kind IN ('pay', 'refund') AND coalesce(b.plan, '') NOT IN ('launch', 'monthly', 'annual') THEN 'invalid_plan'
       WHEN b.kind = 'pay' AND b.plan = 'launch' AND l.used >= 3 THEN 'launch_limit_reached'
       WHEN b.kind = 'refund' AND b.plan = 'launch' AND l.used = 0 THEN 'nothing_to_refund'
       WHEN b.kind = 'grant' AND (b.days IS NULL OR b.days < 1 OR b.days > 365) THEN 'invalid_days'
  END AS reason
FROM s_base b LEFT JOIN s_launch l ON l.vendor_id = b.vendor_id AND l.seq = b.seq"""

ADAPTERS["s_acc"] = """
SELECT *, reason IS NULL AS accepted,
       CASE WHEN reason IS NOT NULL THEN NULL
            WHEN kind = 'trial' THEN 30
            WHEN kind = 'pay' THEN CASE plan WHEN 'annual' THEN 365 ELSE 30 END
            WHEN kind = 'grant' THEN days END AS d_days,
       CASE WHEN reason IS NULL AND kind = 'pay' THEN
            CAST(CASE plan WHEN 'launch' THEN 5000 WHEN 'monthly' THEN 10000 ELSE 100000 END AS DECIMAL(12,2))
       END AS amount
FROM s_cls"""

ADAPTERS["s_ext"] = """
SELECT vendor_id, seq, ts, kind, plan, notes, d_days, amount,
       row_number() OVER (PARTITION BY vendor_id ORDER BY ts, seq) AS n
FROM s_acc WHERE accepted AND d_days IS NOT NULL"""

ADAPTERS["s_fold"] = """
SELECT vendor_id, seq, ts, kind, plan, notes, d_days, amount, n, ts + to_days(d_days) AS period_end
FROM s_ext WHERE n = 1
UNION ALL
SELECT e.vendor_id, e.seq, e.ts, e.kind, e.plan, e.notes, e.d_days, e.amount, e.n,
       greatest(f.period_end, e.ts) + to_days(e.d_days)
FROM s_fold f JOIN s_ext e ON e.vendor_id = f.vendor_id AND e.n = f.n + 1"""

ADAPTERS["s_periods"] = "SELECT *, period_end - to_days(d_days) AS period_start FROM s_fold"

# plan and status replayed call by call
ADAPTERS["s_calls"] = """
SELECT vendor_id, ts, kind, plan, d_days, row_number() OVER (PARTITION BY vendor_id ORDER BY ts, seq) AS n
FROM s_acc WHERE accepted AND kind <> 'refund'"""

ADAPTERS["s_status"] = """
SELECT vendor_id, n, 'trial' AS plan, 'trial' AS status FROM s_calls WHERE n = 1
UNION ALL
SELECT c.vendor_id, c.n, CASE WHEN c.kind = 'pay' THEN c.plan ELSE s.plan END,
       CASE c.kind WHEN 'pay' THEN 'active' WHEN 'suspend' THEN 'suspended' WHEN 'cancel' THEN 'cancelled'
            WHEN 'resume' THEN CASE WHEN s.plan = 'trial' THEN 'trial' ELSE 'active' END
            WHEN 'grant' THEN CASE WHEN s.status = 'suspended' THEN 'suspended' WHEN s.plan = 'trial' THEN 'trial' ELSE 'active' END
            ELSE s.status END
FROM s_status s JOIN s_calls c ON c.vendor_id = s.vendor_id AND c.n = s.n + 1"""

# the subscription row after each call, and the last of calls at the same time
ADAPTERS["s_ends"] = """
SELECT vendor_id, n, ts + to_days(d_days) AS access_ends_at FROM s_calls WHERE n = 1
UNION ALL
SELECT c.vendor_id, c.n, CASE WHEN c.d_days IS NULL THEN e.access_ends_at ELSE greatest(e.access_ends_at, c.ts) + to_days(c.d_days) END
FROM s_ends e JOIN s_calls c ON c.vendor_id = e.vendor_id AND c.n = e.n + 1"""

ADAPTERS["s_asof"] = """
SELECT vendor_id, ts, arg_max(s_status.status, n) AS status, arg_max(access_ends_at, n) AS access_ends_at
FROM s_calls JOIN s_status USING (vendor_id, n) JOIN s_ends USING (vendor_id, n) GROUP BY vendor_id, ts"""

ADAPTERS["s_state"] = """
WITH a AS (SELECT * FROM s_acc WHERE accepted AND kind <> 'refund'),
last_pay AS (
  SELECT vendor_id, plan AS paid_plan FROM (
    SELECT vendor_id, plan, row_number() OVER (PARTITION BY vendor_id ORDER BY ts DESC, seq DESC) AS rn
    FROM a WHERE kind = 'pay') WHERE rn = 1),
agg AS (
  SELECT vendor_id, min(CASE WHEN kind = 'trial' THEN ts END) AS access_started_at,
         max(CASE WHEN kind = 'pay' THEN ts END) AS last_payment_at,
         max(ts) AS updated_at, count(CASE WHEN kind = 'pay' THEN 1 END) AS n_payments
  FROM a GROUP BY vendor_id),
per AS (
  SELECT vendor_id, max(period_end) AS access_ends_at FROM s_periods GROUP BY vendor_id),
cps AS (
  SELECT vendor_id, period_start AS current_period_start FROM (
    SELECT vendor_id, period_start, row_number() OVER (PARTITION BY vendor_id ORDER BY ts DESC, seq DESC) AS rn
    FROM s_periods WHERE kind IN ('trial', 'pay')) WHERE rn = 1)
SELECT agg.vendor_id, coalesce(paid_plan, 'trial') AS plan, final.status,
       access_started_at, current_period_start, access_ends_at, last_payment_at, updated_at, n_payments
FROM agg JOIN per USING (vendor_id) LEFT JOIN cps USING (vendor_id)
LEFT JOIN (SELECT vendor_id, arg_max(status, n) AS status FROM s_status GROUP BY vendor_id) final USING (vendor_id)
LEFT JOIN last_pay USING (vendor_id)"""

oracle("renewal_periods", """WITH RECURSIVE
SELECT vendor_id, seq, kind, plan, d_days, amount, period_start, period_end FROM s_periods""")

oracle("launch_cap", """
SELECT vendor_id, seq, plan, reason IS NULL AS accepted, reason, amount FROM s_acc WHERE kind = 'pay'""")

oracle("plan_pricing", """
SELECT plan, count(*) AS n_payments, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue
FROM s_acc WHERE kind = 'pay' AND accepted GROUP BY plan""")

oracle("grant_days", """WITH RECURSIVE
SELECT a.vendor_id, a.seq, a.days, a.accepted, a.reason, p.period_end AS access_ends_at
FROM s_acc a LEFT JOIN s_periods p ON p.vendor_id = a.vendor_id AND p.seq = a.seq AND p.kind = 'grant'
WHERE a.kind = 'grant'""")

oracle("subscription_status", "WITH RECURSIVE SELECT vendor_id, plan, status FROM s_state")

oracle("subscription_state", "WITH RECURSIVE SELECT * FROM s_state")

oracle("live_subscriptions", """WITH RECURSIVE
SELECT vendor_id, status, access_ends_at FROM s_state
WHERE status IN ('trial', 'active') AND access_ends_at > TIMESTAMP '2024-01-20 00:00:00'""")

oracle("start_trials", """WITH RECURSIVE
SELECT vendor_id, plan, status, access_started_at, current_period_start, access_ends_at, false AS is_new
FROM s_state WHERE n_payments > 0
UNION ALL
SELECT id, 'trial', 'trial', TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00',
       TIMESTAMP '2024-03-02 00:00:00', true
FROM nv WHERE id NOT IN (SELECT vendor_id FROM s_state WHERE n_payments > 0)""")

oracle("payment_history", """WITH RECURSIVE
SELECT vendor_id, seq, plan, amount, period_start, period_end, nullif(trim(notes), '') AS notes,
       row_number() OVER (PARTITION BY vendor_id ORDER BY ts DESC, seq DESC) AS rank
FROM s_periods WHERE kind = 'pay'""")
