"""Alerts, feedback routing, evidence, reports, erasure, and the scored payments."""

from pyspark.sql import functions as F

from ledgerscope.functions.vectors import top_contributions
from ledgerscope.operators import committee as M
from ledgerscope.operators import evidence as E
from ledgerscope.operators import gates as G
from ledgerscope.operators import profile as P
from ledgerscope.operators.graph import paths as H
from ledgerscope.operators.graph.features import account_graph_features
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.catalog.gates import (
    BIPARTITE_SQL, CASH_SQL, FIRST_GATE_SQL, SINK_SQL, TERMINAL_SQL, account_gates, aged_edges,
)
from ledgerscope.plans.catalog.graph import all_trails
from ledgerscope.plans.catalog.models import COMMITTEE_SQL, explained
from ledgerscope.plans.catalog.profile import r
from ledgerscope.plans.catalog.rules import CONTEXT_SQL, FINGERPRINT_SQL, context, feature_map
from ledgerscope.plans.chain import run_chain
from ledgerscope.plans.scoring import score_payments
from ledgerscope.sources import tables
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()


@q(
    "e3_make_alerts",
    with_views(
        "scores",
        """SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS alert_id,
        transaction_id, score, gate_fired AS gate, action, 'OPEN' AS status, 'PENDING' AS trail_status FROM (SELECT *, sha256(CAST(transaction_id AS VARCHAR)) AS h FROM scores) WHERE action IN ('REVIEW', 'HIGH_RISK')""",
    ),
)
def _(spark, d):
    return E.make_alerts(V.scores(spark, d)).drop("account_id", "created_at")


def _feedback(spark, d):
    t = F.col("transaction_id")
    return V.alerts(spark, d).select(
        "alert_id",
        F.concat(F.lit("inv"), (t % 4).cast("string")).alias("investigator_id"),
        F.col("investigator_decision").alias("confirmed_fraud"),
        F.when(t % 2 == 0, "mule").alias("fraud_type"),
        F.lit(None).cast("string").alias("notes"),
        "created_at",
    )


def _scored(spark, d):
    """Stored scores with feature vectors; every seventh payment has no stored score."""
    rows = V.scores(spark, d).filter(F.col("transaction_id") % 7 != 0)
    return rows.withColumn("feature_vector", feature_map(F.col("account_id")))


@q(
    "e1_route_feedback",
    with_views(
        "alerts txn",
        FINGERPRINT_SQL
        + """, fb AS (SELECT *, transaction_id % 7 <> 0 AS scored FROM alerts)
        SELECT 'curated' AS target, CAST(label AS VARCHAR) AS detail, count(*) AS n FROM (SELECT CAST(investigator_decision AS INTEGER) AS label FROM fb WHERE scored) GROUP BY ALL
        UNION ALL SELECT 'registry', '0', count(DISTINCT fingerprint) FROM fb JOIN fp USING (account_id) WHERE scored AND NOT investigator_decision
        UNION ALL SELECT 'candidates', CASE WHEN transaction_id % 2 = 0 THEN 'mule' ELSE 'unknown' END, count(*) FROM fb WHERE scored AND investigator_decision GROUP BY ALL
        UNION ALL SELECT 'log', CAST(CAST(investigator_decision AS INTEGER) AS VARCHAR), count(*) FROM fb GROUP BY ALL
        UNION ALL SELECT 'audit', 'FEEDBACK', count(*) FROM fb UNION ALL SELECT 'audit', 'FEEDBACK_ROUTING', count(*) FROM fb WHERE scored""",
    ),
)
def _(spark, d):
    routes = E.route_feedback(_feedback(spark, d), V.alerts(spark, d), _scored(spark, d))

    def tally(df, target, column):
        return df.groupBy(F.lit(target).alias("target"), F.col(column).cast("string").alias("detail")).agg(
            F.count(F.lit(1)).alias("n")
        )

    return (
        tally(routes.curated, "curated", "label")
        .unionByName(tally(routes.registry, "registry", "label"))
        .unionByName(tally(routes.candidates, "candidates", "fraud_type"))
        .unionByName(tally(routes.log, "log", "label"))
        .unionByName(tally(routes.audit, "audit", "event_type"))
    )


@q(
    "e1_benign_registry",
    with_views(
        "alerts txn",
        FINGERPRINT_SQL
        + """ SELECT fingerprint, CAST(0 AS INTEGER) AS label, min(transaction_id) AS source_transaction_id FROM alerts JOIN fp USING (account_id)
        WHERE transaction_id % 7 <> 0 AND NOT investigator_decision GROUP BY fingerprint""",
    ),
)
def _(spark, d):
    routes = E.route_feedback(_feedback(spark, d), V.alerts(spark, d), _scored(spark, d))
    return routes.registry.select("fingerprint", "label", "source_transaction_id")


@q(
    "e2_alert_status",
    with_views(
        "alerts",
        """SELECT alert_id, CASE WHEN transaction_id % 5 = 0 THEN status WHEN transaction_id % 2 = 0 THEN 'CONFIRMED_FRAUD' ELSE 'FALSE_POSITIVE' END AS status FROM alerts""",
    ),
)
def _(spark, d):
    t = F.col("transaction_id")
    a = V.alerts(spark, d)
    judged = a.filter(t % 5 != 0)
    old = judged.select("alert_id", (t % 2 == 1).alias("confirmed_fraud"), "created_at")
    new = judged.select("alert_id", (t % 2 == 0).alias("confirmed_fraud"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return E.alert_status(a, old.unionByName(new)).select("alert_id", "status")


# Whether an alert has trails follows from single transfers; the trails themselves are
# compared with enumeration in the tests.
_HAS_TRAILS = """EXISTS (SELECT 1 FROM edges e WHERE e.src = a.account_id AND e.ts >= a.created_at) AS has_forward,
  EXISTS (SELECT 1 FROM edges e WHERE e.dst = a.account_id AND e.ts <= a.created_at) AS has_backward"""


@q("e7_trail_package", with_views("edges alerts", f"SELECT a.alert_id, {_HAS_TRAILS} FROM alerts a"))
def _(spark, d):
    package = E.trail_package(V.alerts(spark, d), all_trails(spark, d, "forward"), all_trails(spark, d, "backward"))
    return package.select(
        "alert_id", (F.col("forward_hops") > 0).alias("has_forward"), (F.col("backward_hops") > 0).alias("has_backward")
    )


@q("a24_trail_summary")
def _(spark, d):
    return P.trail_summary(all_trails(spark, d, "forward"), "seed_id")


@q("o5_longest_paths")
def _(spark, d):
    return H.longest_paths(all_trails(spark, d, "forward"), "seed_id", 3).select(
        "seed_id", "hops", F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edge_ids")
    )


def _contributions(spark, d):
    parts = F.array(
        F.struct(F.lit("sink_score").alias("feature"), F.lit(0.4).alias("contribution")),
        F.struct(F.lit("burst_score").alias("feature"), F.lit(-0.2).alias("contribution")),
    )
    odd = V.scores(spark, d).filter(F.col("transaction_id") % 2 == 1)
    return odd.select("transaction_id", parts.alias("top"))


@q(
    "e5_report_draft",
    with_views(
        "alerts txn",
        """SELECT a.alert_id, t.amount AS amount_inr, t.channel, round(a.score, 4) AS fraud_score, a.gate AS gate_fired,
        'System fraud score: ' || printf('%.2f', a.score * 100) || '%.' ||
        CASE a.gate WHEN 'bipartite_core' THEN ' Account sits at the center of a many-to-one aggregation network consistent with mule coordination.'
          WHEN 'confirmed_cycle' THEN ' A confirmed circular fund transfer cycle was detected.' ELSE '' END ||
        CASE WHEN a.transaction_id % 2 = 1 THEN ' Top contributing factors: sink_score, burst_score.' ELSE '' END || ' Recommend STR filing under PMLA Section 12 within 7 days.' AS narrative,
        'PENDING' AS trail_state FROM alerts a JOIN txn t USING (transaction_id)""",
    ),
)
def _(spark, d):
    drafts = E.report_draft(V.alerts(spark, d), V.txn(spark, d), _contributions(spark, d))
    return drafts.select(
        "alert_id",
        "transaction.amount_inr",
        "transaction.channel",
        "risk_assessment.fraud_score",
        "risk_assessment.gate_fired",
        "narrative",
        F.col("fund_trail_summary.status").alias("trail_state"),
    )


# The same report with the boosted model's own leading features.
@q("e5_report_factors")
def _(spark, d):
    top = explained(spark, d).select(
        F.col("o_orderkey").alias("transaction_id"), top_contributions(F.col("contributions"), 5).alias("top")
    )
    drafts = E.report_draft(V.alerts(spark, d), V.txn(spark, d), top)
    return drafts.select("alert_id", "narrative", F.col("risk_assessment.fraud_score").alias("fraud_score"))


# Trails with their counts: ten hops have no SQL form, the trails themselves are compared
# with enumeration in the tests.
@q("e7_trail_counts")
def _(spark, d):
    packages = E.trail_package(V.alerts(spark, d), all_trails(spark, d, "forward"), all_trails(spark, d, "backward"))
    longest = lambda side: F.coalesce(F.array_max(F.transform(f"{side}_paths", lambda p: p["hops"])), F.lit(0))
    return packages.select(
        "alert_id", "forward_hops", "backward_hops", longest("forward").alias("forward_longest"), longest("backward").alias("backward_longest")
    )


@q(
    "e6_report_payload",
    with_views(
        "alerts txn",
        """SELECT a.alert_id AS report_reference, t.amount, t.account_id, 'UNKNOWN' AS fraud_type, '2024-01-31' AS report_date,
        sha256(a.alert_id || '|' || a.transaction_id || '|' || printf('%.2f', t.amount)) AS payload_hash FROM alerts a JOIN txn t USING (transaction_id)""",
    ),
)
def _(spark, d):
    a, t = V.alerts(spark, d), V.txn(spark, d)
    drafts = E.report_draft(a, t, _contributions(spark, d))
    return E.report_payload(a, t, drafts, as_of()).select(
        "report_reference",
        "amount",
        "account_id",
        "fraud_type",
        F.col("report_date").cast("string").alias("report_date"),
        "payload_hash",
    )


@q(
    "e4_evidence_package",
    with_views(
        "alerts shadow edges",
        COMMITTEE_SQL
        + """ SELECT a.alert_id, a.gate AS gate_fired, EXISTS (SELECT 1 FROM edges e WHERE e.src = a.account_id AND e.ts >= a.created_at) AS has_forward, a.transaction_id % 7 <> 0 AS has_features, round_even(CASE WHEN c.ovr THEN 1.0 ELSE c.fallback_score END, 4) AS committee_score, 'DRAFT' AS draft_status
        FROM alerts a JOIN com c USING (transaction_id)""",
        recursive=True,
    ),
)
def _(spark, d):
    a = V.alerts(spark, d)
    trails = E.trail_package(a, all_trails(spark, d, "forward"), all_trails(spark, d, "backward"))
    drafts = E.report_draft(a, V.txn(spark, d), _contributions(spark, d), trails)
    committee = M.aggregate_committee(V.shadow(spark, d).drop("final_committee_score"))
    package = E.evidence_package(a, _scored(spark, d), trails, drafts, M.committee_breakdown(committee))
    return package.select(
        "alert_id",
        "gate_fired",
        (F.col("fund_trail.forward_hops") > 0).alias("has_forward"),
        F.col("feature_vector").isNotNull().alias("has_features"),
        F.col("committee_breakdown.final_score").alias("committee_score"),
        F.col("str_draft.status").alias("draft_status"),
    )


_SEALED = ["alert_id", "transaction_id", "score", "action", "gate"]


@q(
    "e8_seal_verify",
    with_views("alerts", "SELECT alert_id, transaction_id % 4 NOT IN (1, 2) AS intact FROM alerts"),
)
def _(spark, d):
    a = V.alerts(spark, d)
    t = F.col("transaction_id")
    sealed = E.seal(a.filter(t % 4 != 1), _SEALED, as_of())
    older = sealed.withColumn("sealed_at", F.col("sealed_at") - F.expr("INTERVAL 1 DAY")).withColumn("evidence_hash", F.lit("stale"))
    changed = a.withColumn("score", F.when(t % 4 == 2, F.col("score") + 1).otherwise(F.col("score")))
    return E.verify_seal(changed, _SEALED, sealed.unionByName(older))


@q(
    "e9_erase",
    with_views(
        "txn acct",
        """SELECT 'account' AS kind, id AS ref, CASE WHEN id % 10 <> 0 THEN kyc_occupation END AS field FROM acct
        UNION ALL SELECT 'payment', transaction_id, CASE WHEN account_id % 10 <> 0 THEN CAST(device_id AS VARCHAR) END FROM txn""",
    ),
)
def _(spark, d):
    a, t = V.acct(spark, d), V.txn(spark, d)
    requests = a.select(F.col("id").alias("account_id")).filter(F.col("account_id") % 10 == 0)
    accounts, payments = E.erase(a, t, requests)
    left = accounts.select(F.lit("account").alias("kind"), F.col("id").alias("ref"), F.col("kyc_occupation").alias("field"))
    right = payments.select(
        F.lit("payment").alias("kind"), F.col("transaction_id").alias("ref"), F.col("device_id").cast("string").alias("field")
    )
    return left.unionByName(right)


@q(
    "e10_expired_features",
    "SELECT o_custkey AS account_id, max(o_orderdate) AS computed_at FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '2001-06-01 00:00:00'",
)
def _(spark, d):
    features = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.max("o_orderdate").alias("computed_at")
    )
    return E.expired_features(features, F.lit("2006-06-01 00:00:00").cast("timestamp"))


@q(
    "e11_processing_ledger",
    with_views(
        "txn",
        """SELECT DISTINCT substr(sha256(CAST(account_id AS VARCHAR)), 1, 12) AS account_id_hash, 'score' AS operation, 'payments,device' AS categories, 'legal_obligation' AS lawful_basis FROM txn""",
    ),
)
def _(spark, d):
    ledger = E.processing_ledger(V.txn(spark, d), "score", ["payments", "device"], "legal_obligation", as_of())
    return ledger.drop("processed_at")


# ── Scored payments ─────────────────────────────────────────────────────────

# The relay pilot stays silent and the cycle gate has its own query; the other
# account gates and the terminal gate decide here.
_SCORING_SQL = (
    CONTEXT_SQL
    + SINK_SQL
    + BIPARTITE_SQL
    + CASH_SQL
    + TERMINAL_SQL
    + """, ag AS (SELECT account_id, arg_min(gate, p) AS gate FROM (SELECT account_id, 2 AS p, 'abandoned_sink_d01' AS gate FROM s2a WHERE fired UNION ALL SELECT account_id, 3, 'abandoned_sink' FROM s2b WHERE fired
      UNION ALL SELECT account_id, 4, 'bipartite_core' FROM bip WHERE fired AND density > 1.05 UNION ALL SELECT account_id, 5, 'cash_mule_sink' FROM cash WHERE fired) GROUP BY account_id),
  rawq AS (SELECT t.*, coalesce(ag.gate, tm.gate) AS gf, (t.transaction_id * 7919 % 1009) / 1009.0::DOUBLE AS raw, t.account_id % 101 = 5 AS canary
    FROM tier1 t LEFT JOIN ag ON t.account_id = ag.account_id LEFT JOIN terminal tm ON t.merchant_terminal_id = tm.merchant_terminal_id),
  fac AS (SELECT *, raw * CASE WHEN daily_txn_count > 10 AND channel = 'UPI' AND lower(kyc_occupation) IN ('gig_worker','freelancer','delivery') AND hour(ts) BETWEEN 11 AND 23 THEN 0.85::DOUBLE ELSE 1.0 END
      * CASE WHEN account_type = 'JAN_DHAN' THEN 0.75::DOUBLE ELSE 1.0 END
      * CASE WHEN lower(kyc_occupation) IN ('merchant','retailer','shopkeeper') AND amount % 100 = 0 AND hour(ts) BETWEEN 18 AND 23 THEN 0.8::DOUBLE ELSE 1.0 END
      * CASE WHEN kyc_age > 60 AND night THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN kyc_age > 60 AND payee_vpa_age_days < 7 THEN 1.3::DOUBLE ELSE 1.0 END AS pr FROM rawq),
  scored AS (SELECT *, CASE WHEN canary THEN 'canary' WHEN tier1_result = 'FAST_CLEAN' THEN 'clean' WHEN gf IS NOT NULL THEN 'gate' WHEN tier1_result = 'UNCERTAIN' THEN 'unsure' ELSE 'model' END AS path, least(pr, 1.0::DOUBLE) AS adj FROM fac)"""
)


def scored_payments(spark, d, jitter_width=0.0):
    """Every payment through the whole chain; without jitter, so the rows can be compared."""
    e, a, t = V.edges(spark, d), V.acct(spark, d), V.txn(spark, d)
    sinks = G.sink_features(aged_edges(spark, d), as_of())
    crowd = G.bipartite_core(e, a)
    crowd = crowd.withColumn("fired", F.col("fired") & (F.col("evidence.density") > 1.05))
    gates = [
        G.abandoned_sink_two_path(sinks),
        G.abandoned_sink(sinks, a),
        crowd,
        G.cash_mule_sink(t, a, as_of()),
    ]
    gated = G.run_gates(context(spark, d), gates, G.merchant_terminal(t, as_of()))
    canaries = a.select(F.col("id").alias("account_id")).filter(F.col("account_id") % 101 == 5)
    raw = (F.col("transaction_id") * 7919 % 1009) / 1009.0
    return score_payments(gated, raw, canaries, jitter_width=jitter_width)


# ── The chain end to end, all gates and real scorer outputs ─────────────────


def pattern_labels(rows):
    """Payments under a gate or with two or more tier 1 flags are the examples to learn from."""
    return rows.withColumn("label", F.when(F.col("gate_fired").isNotNull() | (F.size("tier1_flags") >= 2), 1).otherwise(0))


def chain(spark, d):
    a, t = V.acct(spark, d), V.txnv(spark, d)
    canaries = a.select(F.col("id").alias("account_id")).filter(F.col("account_id") % 101 == 5)
    gates, terminal = account_gates(spark, d, live=True), G.merchant_terminal(V.txn(spark, d), as_of())
    return run_chain(t, a, V.edges(spark, d), as_of(), gates, terminal, pattern_labels, canaries, jitter_width=0.0)


@q("p19_chain")
def _(spark, d):
    return chain(spark, d).select(
        "transaction_id", "score", "action", "gate_fired", F.array_join("tier1_flags", ",").alias("flags"), "tier1_result", "tier3_score_raw"
    )


# What of the chain has a SQL form: exits, gates (the cycle gate too), fixed scores.
@q(
    "p19_chain_exits",
    with_views(
        "txnv txn acct edges",
        CONTEXT_SQL
        + FIRST_GATE_SQL
        + """, exits AS (SELECT t.transaction_id, CASE WHEN t.account_id % 101 = 5 THEN 'canary' WHEN t.tier1_result = 'FAST_CLEAN' THEN 'clean' WHEN coalesce(g.gate, m.gate) IS NOT NULL THEN 'gate'
          WHEN t.tier1_result = 'UNCERTAIN' THEN 'unsure' ELSE 'model' END AS path, coalesce(g.gate, m.gate) AS gf
          FROM tier1 t LEFT JOIN acct_gate g ON t.account_id = g.account_id LEFT JOIN terminal m ON t.merchant_terminal_id = m.merchant_terminal_id)
        SELECT transaction_id, CASE WHEN path = 'gate' THEN gf END AS gate_fired, path = 'model' AS judged,
          CASE path WHEN 'canary' THEN 0.5::DOUBLE WHEN 'clean' THEN 0.05 WHEN 'gate' THEN 1.0 WHEN 'unsure' THEN 0.1 END AS fixed_score FROM exits""",
        recursive=True,
    ),
)
def _(spark, d):
    rows = chain(spark, d)
    by_model = F.col("tier3_score_raw").isNotNull() & (F.col("tier1_flags") != F.array(F.lit("canary")))
    return rows.select(
        "transaction_id", "gate_fired", by_model.alias("judged"), F.when(~by_model, F.col("score")).alias("fixed_score")
    )


@q(
    "p19_scored_payments",
    with_views(
        "txnv acct edges",
        _SCORING_SQL
        + """ SELECT transaction_id, round(CASE path WHEN 'canary' THEN 0.5::DOUBLE WHEN 'clean' THEN 0.05 WHEN 'gate' THEN 1.0 WHEN 'unsure' THEN 0.1 ELSE adj END, 4) AS score,
        CASE path WHEN 'canary' THEN 'LOG' WHEN 'clean' THEN 'PASS' WHEN 'gate' THEN 'REVIEW' WHEN 'unsure' THEN 'LOG' ELSE CASE WHEN adj >= 0.83 THEN 'HIGH_RISK' WHEN adj >= 0.62 THEN 'REVIEW' WHEN adj >= 0.38 THEN 'LOG' ELSE 'PASS' END END AS action,
        CASE WHEN path = 'gate' THEN gf END AS gate_fired, CASE WHEN path = 'canary' THEN 'canary' ELSE flags END AS flags, CASE WHEN path = 'model' THEN raw WHEN path = 'canary' THEN 0.5 END AS tier3_score_raw FROM scored""",
    ),
)
def _(spark, d):
    rows = scored_payments(spark, d)
    return rows.select(
        "transaction_id",
        "score",
        "action",
        "gate_fired",
        F.concat_ws(",", "tier1_flags").alias("flags"),
        "tier3_score_raw",
    )


@q("g7_account_features")
def _(spark, d):
    return account_graph_features(
        tables.vertices(V.acct(spark, d)),
        V.edges(spark, d),
        V.txn(spark, d),
        V.seeds(spark, d),
        as_of(),
    )


