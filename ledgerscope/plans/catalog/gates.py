"""Hard pattern gates and their legitimacy filters."""

from pyspark.sql import functions as F

from ledgerscope.operators import gates as G
from ledgerscope.operators.graph import paths as H
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.catalog.graph import CYCLES_SQL
from ledgerscope.plans.catalog.profile import _FLOW_SQL, SIDES_SQL, r
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()
_T = "TIMESTAMP '2024-01-31 00:00:00'"

RELAY_SQL = (
    SIDES_SQL
    + f""", fl AS (SELECT account_id, {_FLOW_SQL} FROM sides WHERE ts >= {_T} - INTERVAL 168 HOUR GROUP BY account_id),
  oc AS (SELECT src AS account_id, count(*) AS c FROM edges WHERE ts > {_T} - INTERVAL 1 HOUR GROUP BY src),
  rr AS (SELECT account_id, CASE WHEN inflow_1h < 5000 THEN inflow_6h ELSE inflow_1h END AS inflow, CASE WHEN inflow_1h < 5000 THEN outflow_6h ELSE outflow_1h END AS outflow, coalesce(c, 0) AS outgoing
    FROM fl LEFT JOIN oc USING (account_id)),
  relay AS (SELECT *, CASE WHEN inflow > 0 THEN outflow / inflow END AS ratio FROM rr)"""
)


@q(
    "r0_rapid_relay",
    with_views(
        "edges",
        RELAY_SQL
        + """ SELECT account_id, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, round(ratio, 6) AS conservation_ratio, outgoing AS outgoing_txn_count_1h,
        coalesce(inflow >= 5000 AND ratio >= 0.8 AND outgoing >= 3, FALSE) AS fired, coalesce(inflow >= 5000 AND ratio >= 0.8 AND outgoing >= 3, FALSE) AS detected FROM relay""",
    ),
)
def _(spark, d):
    rows = G.rapid_relay(V.edges(spark, d), as_of(), live=True).select("account_id", "fired", "detected", "evidence.*")
    return r(r(rows, "inflow", "outflow", places=2), "conservation_ratio", places=6)


@q(
    "r8_relay_pilot",
    with_views(
        "edges",
        RELAY_SQL
        + " SELECT account_id, round(inflow, 2) AS inflow, outgoing AS outgoing_txn_count_1h FROM relay WHERE inflow >= 5000 AND ratio >= 0.8 AND outgoing >= 3",
    ),
)
def _(spark, d):
    rows = G.relay_pilot_report(V.edges(spark, d), as_of())
    return r(rows, "inflow", places=2).select("account_id", "inflow", "outgoing_txn_count_1h")


# Payments of some accounts moved back in time, so silent accounts exist.
def aged_edges(spark, d):
    e = V.edges(spark, d)
    silent = (F.col("src") % 10 == 7) | (F.col("dst") % 10 == 7)
    stopped = F.col("src") % 10 == 3
    return e.withColumn(
        "ts",
        F.when(silent, F.col("ts") - F.expr("INTERVAL 45 DAYS"))
        .when(stopped, F.col("ts") - F.expr("INTERVAL 62 DAYS"))
        .otherwise(F.col("ts")),
    )


SINK_SQL = f""", ae AS (SELECT * REPLACE (CASE WHEN src % 10 = 7 OR dst % 10 = 7 THEN ts - INTERVAL 45 DAY WHEN src % 10 = 3 THEN ts - INTERVAL 62 DAY ELSE ts END AS ts) FROM edges),
 asd AS (SELECT src AS account_id, 'out' AS dir, dst AS other, amount, ts FROM ae UNION ALL SELECT dst, 'in', src, amount, ts FROM ae),
 sk AS (SELECT account_id, count(DISTINCT other) FILTER (WHERE dir = 'in') / (count(DISTINCT other) FILTER (WHERE dir = 'in') + count(DISTINCT other) FILTER (WHERE dir = 'out'))::DOUBLE AS sink_score,
   (epoch_us({_T}) - epoch_us(max(ts) FILTER (WHERE dir = 'in'))) / 86400000000.0::DOUBLE AS rec, (epoch_us({_T}) - epoch_us(max(ts) FILTER (WHERE dir = 'out'))) / 86400000000.0::DOUBLE AS snd,
   coalesce(sum(amount) FILTER (WHERE dir = 'in' AND ts > {_T} - INTERVAL 30 DAY), 0) AS i30, coalesce(sum(amount) FILTER (WHERE dir = 'out' AND ts > {_T} - INTERVAL 30 DAY), 0) AS o30,
   coalesce(sum(amount) FILTER (WHERE dir = 'in' AND ts > {_T} - INTERVAL 90 DAY), 0) AS i90, coalesce(sum(amount) FILTER (WHERE dir = 'out' AND ts > {_T} - INTERVAL 90 DAY), 0) AS o90 FROM asd GROUP BY account_id),
 sf AS (SELECT *, CASE WHEN i30 > 0 THEN greatest(1 - o30 / i30, 0.0::DOUBLE) ELSE 0.0 END AS ret, CASE WHEN i90 > 0 THEN greatest(1 - o90 / i90, 0.0::DOUBLE) ELSE 0.0 END AS ret90 FROM sk),
 s2a AS (SELECT account_id, coalesce(rec > 30 AND snd > 30 AND sink_score > 0.5 AND ret90 > 0.6, FALSE) AS fired, rec, sink_score, ret90 FROM sf),
 s2b AS (SELECT sf.account_id, coalesce(i30 > 50000 AND ret > 0.8 AND snd > 30 AND a.account_age_days < 180 AND NOT (coalesce(account_type IN ('JAN_DHAN'), FALSE)
   OR coalesce(lower(kyc_occupation) IN ('merchant','retailer','shopkeeper'), FALSE)), FALSE) AS fired, i30, ret, snd, a.account_age_days FROM sf JOIN acct a ON sf.account_id = a.id)"""


@q(
    "r2a_two_path_sink",
    with_views("edges acct", SINK_SQL + " SELECT account_id, fired, CASE WHEN fired THEN 'abandoned_sink_d01' END AS gate, round(rec, 6) AS days_since_last_receive, round(ret90, 6) AS retention_ratio_long FROM s2a"),
)
def _(spark, d):
    gate = G.abandoned_sink_two_path(G.sink_features(aged_edges(spark, d), as_of()))
    rows = gate.select("account_id", "fired", "gate", "evidence.days_since_last_receive", "evidence.retention_ratio_long")
    return r(rows, "days_since_last_receive", "retention_ratio_long", places=6)


@q(
    "r2b_abandoned_sink",
    with_views(
        "edges acct",
        SINK_SQL
        + """ SELECT account_id, fired, CASE WHEN fired THEN 'abandoned_sink' END AS gate, round(i30, 4) AS inflow_last_30d, round(ret, 6) AS retention_ratio,
        round(snd, 6) AS days_since_last_send, account_age_days FROM s2b""",
    ),
)
def _(spark, d):
    gate = G.abandoned_sink(G.sink_features(aged_edges(spark, d), as_of()), V.acct(spark, d))
    rows = gate.select("account_id", "fired", "gate", "evidence.*")
    return r(r(rows, "inflow_last_30d"), "retention_ratio", "days_since_last_send", places=6)


BIPARTITE_SQL = """, bp AS (SELECT dst, src, count(*) AS n FROM edges GROUP BY ALL),
  bq AS (SELECT dst, count(*) AS sender_count, CAST(sum(n) AS BIGINT) AS edge_count FROM bp GROUP BY dst),
  bs AS (SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sender_ids FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM bp) WHERE rn <= 10 GROUP BY dst),
  bip AS (SELECT bq.dst AS account_id, sender_count, edge_count / sender_count::DOUBLE AS density, sender_ids,
    coalesce(sender_count >= 5 AND edge_count / sender_count::DOUBLE > 0.7 AND NOT coalesce(lower(kyc_occupation) IN ('salary_processor','payroll_processor','insurance_company','tax_collector','utility_provider'), FALSE)
      AND NOT coalesce(is_merchant AND edge_count / sender_count::DOUBLE < 0.85, FALSE), FALSE) AS fired
    FROM bq JOIN bs USING (dst) LEFT JOIN acct a ON bq.dst = a.id)"""


@q(
    "r3_bipartite_core",
    with_views("edges acct", BIPARTITE_SQL + " SELECT account_id, fired, sender_count, round(density, 6) AS density, sender_ids FROM bip"),
)
def _(spark, d):
    gate = G.bipartite_core(V.edges(spark, d), V.acct(spark, d))
    rows = gate.select(
        "account_id",
        "fired",
        "evidence.sender_count",
        "evidence.density",
        F.array_join(F.col("evidence.sender_ids").cast("array<string>"), ",").alias("sender_ids"),
    )
    return r(rows, "density", places=6)


CASH_SQL = f""", ci AS (SELECT payee_account_id AS account_id, sum(amount) AS inflow_7d FROM txn WHERE ts > {_T} - INTERVAL 7 DAY GROUP BY 1),
  cc AS (SELECT account_id, coalesce(sum(amount) FILTER (WHERE ts > {_T} - INTERVAL 48 HOUR), 0) AS cash, max(ts) AS last_atm FROM txn WHERE channel = 'ATM' GROUP BY 1),
  ca AS (SELECT t.account_id, count(*) AS after FROM txn t JOIN cc USING (account_id) WHERE t.channel <> 'ATM' AND t.ts > cc.last_atm GROUP BY 1),
  cash AS (SELECT ci.account_id, a.account_age_days, inflow_7d, coalesce(cash, 0) AS cash_withdrawn_48h, coalesce(cash, 0) / inflow_7d AS cash_ratio, coalesce(after, 0) AS after,
    coalesce(a.account_age_days <= 180 AND inflow_7d >= 50000 AND coalesce(cash, 0) / inflow_7d >= 0.8 AND coalesce(after, 0) <= 2 AND NOT coalesce(account_type IN ('JAN_DHAN'), FALSE)
      AND NOT coalesce(lower(kyc_occupation) IN ('vegetable_vendor','daily_wage','agricultural_worker','street_vendor'), FALSE), FALSE) AS fired
    FROM ci JOIN acct a ON ci.account_id = a.id LEFT JOIN cc ON ci.account_id = cc.account_id LEFT JOIN ca ON ci.account_id = ca.account_id)"""


@q(
    "r4_cash_mule_sink",
    with_views(
        "txn acct",
        CASH_SQL
        + """ SELECT account_id, fired, account_age_days, round(inflow_7d, 4) AS inflow_7d, round(cash_withdrawn_48h, 4) AS cash_withdrawn_48h, round(cash_ratio, 6) AS cash_ratio,
        after AS digital_sends_after_withdrawal FROM cash""",
    ),
)
def _(spark, d):
    gate = G.cash_mule_sink(V.txn(spark, d), V.acct(spark, d), as_of())
    rows = gate.select("account_id", "fired", "evidence.*")
    return r(r(rows, "inflow_7d", "cash_withdrawn_48h"), "cash_ratio", places=6)


TERMINAL_SQL = f""", tm AS (SELECT merchant_terminal_id, amount, ts, merchant_mcc FROM txn WHERE merchant_terminal_id IS NOT NULL),
  tk AS (SELECT merchant_terminal_id, min(merchant_mcc) AS mcc FROM tm GROUP BY 1),
  td AS (SELECT * FROM tm WHERE ts > {_T} - INTERVAL 24 HOUR),
  ta AS (SELECT merchant_terminal_id, count(*) AS n, avg(amount) AS mean FROM td GROUP BY 1),
  tn AS (SELECT merchant_terminal_id, avg(c) AS normal FROM (SELECT merchant_terminal_id, date_trunc('day', ts) AS day, count(*) AS c FROM tm WHERE ts > {_T} - INTERVAL 30 DAY GROUP BY ALL) GROUP BY 1),
  tx AS (SELECT ta.*, mcc, normal, CASE mcc WHEN '5411' THEN 5000.0::DOUBLE WHEN '5812' THEN 3000.0 WHEN '5912' THEN 2000.0 WHEN '7011' THEN 10000.0 WHEN '5999' THEN 5000.0 ELSE 50000.0 END AS emax
    FROM ta JOIN tk USING (merchant_terminal_id) JOIN tn USING (merchant_terminal_id)),
  ty AS (SELECT merchant_terminal_id, sum(abs(amount - mean)) AS dev, count(*) FILTER (WHERE amount > emax * 3) AS big FROM td JOIN tx USING (merchant_terminal_id) GROUP BY 1),
  terminal AS (SELECT tx.merchant_terminal_id, mcc, n, mean, dev / (mean * n) AS unif, emax, big, normal, n / normal AS vel,
    CASE WHEN n >= 5 AND dev / (mean * n) < 0.05 THEN 'merchant_terminal_amount_uniformity' WHEN big >= 3 THEN 'merchant_terminal_mcc_mismatch' WHEN n / normal > 50 THEN 'merchant_terminal_velocity_spike' END AS gate
    FROM tx JOIN ty USING (merchant_terminal_id))"""


@q(
    "r5_merchant_terminal",
    with_views(
        "txn",
        TERMINAL_SQL
        + """ SELECT merchant_terminal_id, gate IS NOT NULL AS fired, gate, mcc, n AS receipt_count_24h, round(mean, 4) AS mean_amount, round(unif, 6) AS uniformity_score, emax AS expected_max_amount,
        big AS oversized_count, round(normal, 6) AS normal_daily_avg, round(vel, 6) AS velocity_ratio FROM terminal""",
    ),
)
def _(spark, d):
    rows = G.merchant_terminal(V.txn(spark, d), as_of()).select("merchant_terminal_id", "fired", "gate", "evidence.*")
    return r(r(rows, "mean_amount"), "uniformity_score", "normal_daily_avg", "velocity_ratio", places=6)


# Two declared relations per account.
def relations(spark, d):
    ids = V.acct(spark, d).select(F.col("id").alias("a"))
    return ids.withColumn("b", (F.col("a") * 7 + 3) % 100)


LEGIT_SQL = (
    CYCLES_SQL
    + """, rel AS (SELECT DISTINCT least(id, (id * 7 + 3) % 100) AS lo, greatest(id, (id * 7 + 3) % 100) AS hi FROM acct),
  kept AS (SELECT start, ids, nodes, hops, rank FROM cyc WHERE rank <= 5),
  cm AS (SELECT c.start, c.ids, u.node FROM kept c, LATERAL (SELECT DISTINCT unnest(c.nodes) AS node) u),
  ck AS (SELECT cm.start, cm.ids, bool_and(coalesce(is_merchant, FALSE)) AS merch, bool_or(coalesce(kyc_completeness_score, 0) < 0.3 OR coalesce(account_age_days, 0) < 90) AS shell,
    bool_or(cm.node <> cm.start AND EXISTS (SELECT 1 FROM rel WHERE lo = least(cm.node, cm.start) AND hi = greatest(cm.node, cm.start))) AS related
    FROM cm JOIN acct a ON cm.node = a.id GROUP BY cm.start, cm.ids),
  ce AS (SELECT c.*, e1.amount AS entry_amount, e2.amount AS exit_amount, abs(floor((epoch_us(e2.ts) - epoch_us(e1.ts)) / 86400000000.0)) AS dur
    FROM kept c JOIN be e1 ON e1.transaction_id = c.ids[1] JOIN be e2 ON e2.transaction_id = c.ids[-1]),
  judged AS (SELECT ce.*, CASE WHEN coalesce(a.account_type, 'SAVINGS') IN ('INTERNAL','TREASURY','NOSTRO','VOSTRO') THEN 'internal_transfer' WHEN ck.related THEN 'known_relationship'
      WHEN lower(a.kyc_occupation) IN ('employer','corporate','payroll_processor') AND dur <= 30 AND exit_amount <= entry_amount THEN 'salary_advance_return'
      WHEN ck.merch AND NOT ck.shell THEN 'merchant_settlement_cycle' WHEN entry_amount > 0 AND exit_amount / entry_amount < 0.7 THEN 'fee_or_partial_repayment' END AS reason
    FROM ce LEFT JOIN acct a ON ce.start = a.id LEFT JOIN ck ON ce.start = ck.start AND ce.ids = ck.ids)"""
)


def judged(spark, d):
    found = H.cycles(V.edges(spark, d), as_of())
    return G.cycle_legitimacy(found, V.acct(spark, d), relations(spark, d))


@q(
    "r6_cycle_legitimacy",
    with_views(
        "edges acct",
        LEGIT_SQL
        + " SELECT start, array_to_string(ids, ',') AS edge_ids, entry_amount, exit_amount, CAST(dur AS BIGINT) AS cycle_duration_days, reason FROM judged",
        recursive=True,
    ),
)
def _(spark, d):
    return judged(spark, d).select(
        "start",
        F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edge_ids"),
        "entry_amount",
        "exit_amount",
        "cycle_duration_days",
        "reason",
    )


@q(
    "r1_confirmed_cycle",
    with_views(
        "edges acct",
        LEGIT_SQL
        + """ SELECT start AS account_id, TRUE AS fired, 'confirmed_cycle' AS gate, CAST(hops AS INTEGER) AS hops, entry_amount, exit_amount
        FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, ids) AS rn FROM judged WHERE reason IS NULL) WHERE rn = 1""",
        recursive=True,
    ),
)
def _(spark, d):
    return G.confirmed_cycle(judged(spark, d)).select(
        "account_id", "fired", "gate", "evidence.hops", "evidence.entry_amount", "evidence.exit_amount"
    )


FIRST_GATE_SQL = (
    LEGIT_SQL
    + RELAY_SQL
    + SINK_SQL
    + BIPARTITE_SQL
    + CASH_SQL
    + TERMINAL_SQL
    + """, acct_gate AS (SELECT account_id, arg_min(gate, p) AS gate FROM (
    SELECT account_id, 0 AS p, 'rapid_relay' AS gate FROM relay WHERE inflow >= 5000 AND ratio >= 0.8 AND outgoing >= 3
    UNION ALL SELECT DISTINCT start, 1, 'confirmed_cycle' FROM judged WHERE reason IS NULL UNION ALL SELECT account_id, 2, 'abandoned_sink_d01' FROM s2a WHERE fired
    UNION ALL SELECT account_id, 3, 'abandoned_sink' FROM s2b WHERE fired UNION ALL SELECT account_id, 4, 'bipartite_core' FROM bip WHERE fired
    UNION ALL SELECT account_id, 5, 'cash_mule_sink' FROM cash WHERE fired) GROUP BY account_id)"""
)


def account_gates(spark, d, live=True):
    """The account gates in their order, over the test views."""
    e, a, t = V.edges(spark, d), V.acct(spark, d), V.txn(spark, d)
    sinks = G.sink_features(aged_edges(spark, d), as_of())
    return [
        G.rapid_relay(e, as_of(), live=live),
        G.confirmed_cycle(judged(spark, d)),
        G.abandoned_sink_two_path(sinks),
        G.abandoned_sink(sinks, a),
        G.bipartite_core(e, a),
        G.cash_mule_sink(t, a, as_of()),
    ]


@q(
    "r7_first_gate",
    with_views(
        "edges acct txn",
        FIRST_GATE_SQL
        + """ SELECT t.transaction_id, coalesce(g.gate, m.gate) AS gate_fired FROM txn t LEFT JOIN acct_gate g USING (account_id)
        LEFT JOIN terminal m ON t.merchant_terminal_id = m.merchant_terminal_id""",
        recursive=True,
    ),
)
def _(spark, d):
    t = V.txn(spark, d)
    out = G.run_gates(t, account_gates(spark, d), G.merchant_terminal(t, as_of()))
    return out.select("transaction_id", "gate_fired")
