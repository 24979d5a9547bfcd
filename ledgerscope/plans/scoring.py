"""Score payments: canary, tier 1, gates, committee, context, action - one lazy plan.

The tier exits are branches of one expression, not separate jobs.  Expensive inputs
(gate tables, account features, scorer outputs) are joined as tables computed once
per account, so a payment row is never fanned out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import jitter, score_to_action
from ledgerscope.operators.rules import apply_context, tier1_classify


def score_payments(
    payments: DataFrame,
    raw_score: Column | str = "raw_score",
    canaries: DataFrame | None = None,
    seed: int = 42,
    jitter_width: float = C.JITTER_RANGE,
) -> DataFrame:
    """One row per payment with score, action, gate, flags, raw score and adjustments.

    ``payments`` carries the point-in-time context, ``gate_fired`` (null when no gate
    fired) and the tier 3 score.  Order of exits: canary, FAST_CLEAN, gate,
    UNCERTAIN, then the adjusted tier 3 score.
    """
    raw = F.col(raw_score) if isinstance(raw_score, str) else raw_score
    rows = tier1_classify(payments).withColumn("__raw", raw)
    if "graph_staleness_hours" not in rows.columns:
        rows = rows.withColumn("graph_staleness_hours", F.lit(None).cast("double"))
    rows = apply_context(rows, "__raw")
    canary = F.lit(False)
    if canaries is not None:
        known = canaries.select(F.col("account_id").alias("__canary")).distinct()
        rows = rows.join(known, rows["account_id"] == known["__canary"], "left")
        canary = F.col("__canary").isNotNull()
    clean = F.col("tier1_result") == "FAST_CLEAN"
    gated = F.col("gate_fired").isNotNull()
    unsure = F.col("tier1_result") == "UNCERTAIN"
    rows = rows.withColumn(
        "__path",
        F.when(canary, "canary").when(clean, "clean").when(gated, "gate").when(unsure, "unsure").otherwise("model"),
    )
    path = F.col("__path")
    final = jitter(F.col("adjusted_score"), F.col("transaction_id"), seed, jitter_width)
    rows = rows.withColumn("__final", final)
    score = (
        F.when(path == "canary", C.CANARY_SCORE)
        .when(path == "clean", C.FAST_CLEAN_SCORE)
        .when(path == "gate", C.GATE_SCORE)
        .when(path == "unsure", C.UNCERTAIN_SCORE)
        .otherwise(F.col("__final"))
    )
    action = (
        F.when(path == "canary", C.CANARY_ACTION)
        .when(path == "clean", "PASS")
        .when(path == "gate", "REVIEW")
        .when(path == "unsure", "LOG")
        .otherwise(score_to_action(F.col("__final")))
    )
    empty = F.create_map().cast("map<string,double>")
    evidence = [c for c in ("gate_evidence",) if c in rows.columns]
    return rows.select(
        "transaction_id",
        "account_id",
        F.col("ts"),
        F.bround(score, 4).alias("score"),
        action.alias("action"),
        F.when(path == "gate", F.col("gate_fired")).alias("gate_fired"),
        F.when(path == "canary", F.array(F.lit("canary"))).otherwise(F.col("tier1_flags")).alias("tier1_flags"),
        F.col("tier1_result"),
        F.when(path == "model", F.col("__raw")).when(path == "canary", C.CANARY_SCORE).alias("tier3_score_raw"),
        F.when(path == "model", F.col("adjustments")).otherwise(empty).alias("context_applied"),
        *[F.when(path == "gate", F.col(c)).alias(c) for c in evidence],
    )


def needs_gates(tiered: DataFrame) -> DataFrame:
    """Payments that go on to the gates."""
    return tiered.filter(F.col("tier1_result") != "FAST_CLEAN")


def needs_model(gated: DataFrame) -> DataFrame:
    """Payments that go on to the committee."""
    return gated.filter((F.col("tier1_result") == "SUSPICIOUS") & F.col("gate_fired").isNull())
