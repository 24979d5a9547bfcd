"""The scoring chain end to end: from payments, accounts and transfers to an action.

Context and tier 1 are worked out for all payments and stored once; the gates see what
tier 1 did not clear, and features, scorers and the committee only what no gate caught.
The exits are then joined back by payment.  Every number is computed from the tables; an
input nobody can compute from them (session fields, embeddings) stays null, and its
scorers count as missing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.operators import committee as M
from ledgerscope.operators import gates as G
from ledgerscope.operators import models as L
from ledgerscope.operators import profile as P
from ledgerscope.operators.rules import assemble_features, tier1_classify, txn_features
from ledgerscope.plans.context import payment_context
from ledgerscope.plans.scoring import needs_gates, needs_model, score_payments
from ledgerscope.scale import cut_lineage

VERSION = "V5"


def account_features(txn: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """Per-account inputs of the registry that come from payments and transfers, one row an account."""
    shape = P.bipartite_scores(P.sink_scores(P.degrees(edges)))
    parts = [
        shape,
        P.account_activity(txn, as_of),
        P.channel_entropy(txn),
        P.burst_and_velocity_ratio(txn, as_of),
        P.window_flows(edges, as_of),
        P.benford_deviation(txn, as_of),
        P.fan_in_zscore(txn, as_of),
    ]
    wanted = set(C.FEATURE_VERSIONS[VERSION])
    seen: set[str] = set()
    kept = []
    for part in parts:
        own = [c for c in part.columns if c in wanted and c not in seen]
        seen |= set(own)
        if own:
            kept.append(part.select("account_id", *own))
    return reduce(lambda a, b: a.join(b, "account_id", "full"), kept)


def model_inputs(payments: DataFrame, accounts: DataFrame, features: DataFrame) -> DataFrame:
    """Payments with their own, their context's and their account's registry columns."""
    rows = txn_features(payments)
    point_in_time = {
        "txn_count_last_1h": "velocity_1h", "txn_count_last_24h": "velocity_24h", "txn_volume_last_1h": "volume_1h",
    }
    rows = rows.withColumns({name: F.col(c).cast("double") for name, c in point_in_time.items() if c in rows.columns})
    known = accounts.select(F.col("id").alias("account_id"), "kyc_completeness_score")
    new = [c for c in features.columns if c == "account_id" or c not in rows.columns]
    joined = rows.join(features.select(*new), "account_id", "left")
    return joined.join(known, "account_id", "left") if "kyc_completeness_score" not in rows.columns else joined


def computed_columns(inputs: DataFrame) -> list[str]:
    """Registry columns that somebody computed, in the registry's order."""
    return [c for c in C.FEATURE_VERSIONS[VERSION] if c in inputs.columns]


def committee_score(inputs: DataFrame, set_rows: DataFrame, scorer_a: L.Calibrated, scorer_d: L.Calibrated | None) -> DataFrame:
    """``transaction_id`` and the committee's columns for assembled payments."""
    columns = list(scorer_a.features)
    assembled = assemble_features(inputs, VERSION, ["transaction_id", "account_id"])
    a = L.scorer_a(assembled.select("transaction_id", "account_id", *columns), scorer_a)
    # The session fields are not in the tables; the other inputs are, so A takes part.
    rows = a.withColumn("scorer_a_missing_flag", F.lit(False))
    if scorer_d is not None:
        d = L.scorer_d(set_rows, scorer_d).select("account_id", "scorer_d_score", "scorer_d_confidence", "scorer_d_missing_flag")
        rows = rows.join(d, "account_id", "left")
    for s in map(str.lower, C.SCORER_IDS):
        for name, kind in (("score", "double"), ("confidence", "double"), ("missing_flag", "boolean")):
            if f"scorer_{s}_{name}" not in rows.columns:
                rows = rows.withColumn(f"scorer_{s}_{name}", F.lit(None).cast(kind))
    keep = ["transaction_id", *[f"scorer_{s.lower()}_{n}" for s in C.SCORER_IDS for n in ("score", "confidence", "missing_flag")]]
    return M.aggregate_committee(M.normalise_outputs(rows.select(*keep)))


def run_chain(
    txn: DataFrame,
    accounts: DataFrame,
    edges: DataFrame,
    as_of: Column,
    gates: list[DataFrame],
    terminal: DataFrame | None,
    labels: Callable[[DataFrame], DataFrame],
    canaries: DataFrame | None = None,
    jitter_width: float = C.JITTER_RANGE,
    depth: int = 7,
    rounds: int = 400,
) -> DataFrame:
    """Every payment's exit, score and action.

    ``txn`` carries ``payee_vpa_created_at``; ``gates`` are account gate tables in their
    order; ``labels`` adds ``label`` to gated payments for training scorers A and D.
    """
    tiered = cut_lineage(tier1_classify(payment_context(txn, accounts, as_of)))
    gated = G.run_gates(needs_gates(tiered), gates, terminal)
    gated = cut_lineage(gated.select("transaction_id", "tier1_result", "gate_fired", "gate_evidence"))
    judged = needs_model(gated).select("transaction_id")
    features = cut_lineage(account_features(txn, edges, as_of))
    inputs = cut_lineage(model_inputs(tiered, accounts, features))
    columns = computed_columns(inputs)
    told = labels(inputs.join(gated.select("transaction_id", "gate_fired"), "transaction_id", "left"))
    scorer_a = L.train_calibrated(
        told.select("transaction_id", "label", *[F.col(c).cast("double").alias(c) for c in columns]),
        columns, "transaction_id", stratify=True, depth=depth, rounds=rounds,
    )
    sets = cut_lineage(P.set_features(txn, as_of))
    of_account = told.groupBy("account_id").agg(F.max("label").alias("label"))
    both = of_account.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").count() == 2
    scorer_d = L.train_scorer_d(sets.join(of_account, "account_id"), "account_id") if both else None
    scores = committee_score(inputs.join(judged, "transaction_id", "left_semi"), sets, scorer_a, scorer_d)
    raw = scores.select("transaction_id", F.col("final_committee_score").alias("raw_score"))
    drop = [c for c in ("tier1_result", "tier1_flags") if c in tiered.columns]
    rows = tiered.drop(*drop).join(gated.drop("tier1_result"), "transaction_id", "left").join(raw, "transaction_id", "left")
    return score_payments(rows, "raw_score", canaries, jitter_width=jitter_width)
