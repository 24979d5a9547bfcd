"""Feedback routing, evidence packages, report drafts, seals and erasure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.text import canonical_hash, fingerprint, narrative, pseudonymize, report_hash
from ledgerscope.functions.vectors import nan_to_null_map
from ledgerscope.operators.context import latest_per_key


def make_alerts(scores: DataFrame) -> DataFrame:
    """Open alerts of the scores that call for one; the id is a hash of the payment id."""
    digest = F.sha2(F.col("transaction_id").cast("string"), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return scores.filter(F.col("action").isin("REVIEW", "HIGH_RISK")).select(
        F.concat_ws("-", *parts).alias("alert_id"),
        "transaction_id",
        "account_id",
        "score",
        F.col("gate_fired").alias("gate"),
        "action",
        F.lit("OPEN").alias("status"),
        F.lit("PENDING").alias("trail_status"),
        F.col("scored_at").alias("created_at"),
    )


@dataclass
class FeedbackRoutes:
    """The tables one batch of verdicts is routed to."""

    curated: DataFrame
    registry: DataFrame
    candidates: DataFrame
    log: DataFrame
    audit: DataFrame


def route_feedback(
    feedback: DataFrame, alerts: DataFrame, scores: DataFrame, registry: DataFrame | None = None, key: str = ""
) -> FeedbackRoutes:
    """Verdicts to training rows, benign fingerprints, prototype candidates, log and audit.

    ``feedback``: ``alert_id, investigator_id, confirmed_fraud, fraud_type, notes,
    created_at``; ``scores`` has ``feature_vector`` (a map).  Unknown alerts are not
    routed; an alert without a stored score reaches the log and the audit only.
    """
    joined = (
        feedback.join(alerts.select("alert_id", "transaction_id"), "alert_id")
        .join(
            scores.select("transaction_id", F.col("feature_vector"), F.lit(True).alias("__scored")),
            "transaction_id",
            "left",
        )
        .withColumn("investigator_id_hash", pseudonymize(F.coalesce("investigator_id", F.lit("unknown")), key))
        .withColumn("feature_vector", nan_to_null_map(F.col("feature_vector")))
        .withColumn("label", F.when(F.col("confirmed_fraud"), 1).otherwise(0))
    )
    scored = joined.filter(F.col("__scored"))
    benign, fraud = scored.filter(~F.col("confirmed_fraud")), scored.filter("confirmed_fraud")
    curated = scored.select(
        "transaction_id",
        "alert_id",
        "label",
        F.when(F.col("confirmed_fraud"), "confirmed_fraud")
        .otherwise("investigator_false_positive")
        .alias("label_source"),
        "feature_vector",
        "investigator_id_hash",
        F.lit(False).alias("batch_exported"),
        "created_at",
    )
    entries = benign.select(
        fingerprint(F.col("feature_vector")).alias("fingerprint"),
        F.lit(0).alias("label"),
        F.col("transaction_id").alias("source_transaction_id"),
        F.col("investigator_id_hash").alias("registered_by"),
    )
    # The first payment that registers a fingerprint stays; later ones only set the label.
    new = entries.groupBy("fingerprint").agg(
        F.min(F.struct("source_transaction_id", "registered_by")).alias("__first")
    ).select(
        "fingerprint", F.lit(0).alias("label"), "__first.source_transaction_id", "__first.registered_by"
    )
    if registry is not None:
        hit = new.select("fingerprint", F.lit(True).alias("__hit"))
        kept = registry.join(hit, "fingerprint", "left").select(
            "fingerprint",
            F.when(F.col("__hit"), 0).otherwise(F.col("label")).alias("label"),
            "source_transaction_id",
            "registered_by",
        )
        new = kept.unionByName(new.join(registry.select("fingerprint"), "fingerprint", "left_anti"))
    candidates = fraud.select(
        "transaction_id",
        "alert_id",
        F.coalesce("fraud_type", F.lit("unknown")).alias("fraud_type"),
        "feature_vector",
        "investigator_id_hash",
        F.coalesce("notes", F.lit("")).alias("investigator_notes"),
        F.lit("PENDING_REVIEW").alias("status"),
        F.col("created_at").alias("submitted_at"),
    )
    log = joined.select("alert_id", "transaction_id", "label", "created_at")
    routed = scored.select(
        F.lit("FEEDBACK_ROUTING").alias("event_type"),
        "transaction_id",
        F.to_json(
            F.struct(
                "alert_id",
                F.when(F.col("confirmed_fraud"), "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE").alias("route"),
                "fraud_type",
            )
        ).alias("event_data"),
        F.col("created_at").alias("event_timestamp"),
    )
    received = joined.select(
        F.lit("FEEDBACK").alias("event_type"),
        "transaction_id",
        F.to_json(F.struct("alert_id", "confirmed_fraud", "fraud_type", F.col("__scored").isNotNull().alias("model_updated"))).alias(
            "event_data"
        ),
        F.col("created_at").alias("event_timestamp"),
    )
    return FeedbackRoutes(curated, new, candidates, log, routed.unionByName(received))


def alert_status(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with the status the newest verdict gives them."""
    newest = feedback.groupBy("alert_id").agg(F.max_by("confirmed_fraud", "created_at").alias("__v"))
    verdict = F.when(F.col("__v"), "CONFIRMED_FRAUD").when(~F.col("__v"), "FALSE_POSITIVE")
    return (
        alerts.join(newest, "alert_id", "left")
        .withColumn("status", F.coalesce(verdict, F.col("status")))
        .drop("__v")
    )


def trail_package(alerts: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Forward and backward trails of each alert as arrays with their counts.

    A seed keeps at most its ``k`` longest trails, which bounds the arrays.
    """

    def gathered(paths: DataFrame, name: str) -> DataFrame:
        entry = F.struct(
            F.col("rank"), F.col("hops"), F.col("nodes"), F.col("edge_ids"), F.col("amounts"), F.col("times")
        )
        return paths.groupBy(F.col("seed_id").alias("alert_id")).agg(
            F.count(F.lit(1)).alias(f"{name}_hops"),
            F.sort_array(F.collect_list(entry)).alias(f"{name}_paths"),
        )

    joined = (
        alerts.select("alert_id", "transaction_id")
        .join(gathered(forward, "forward"), "alert_id", "left")
        .join(gathered(backward, "backward"), "alert_id", "left")
    )
    return joined.fillna(0, ["forward_hops", "backward_hops"])


def report_draft(alerts: DataFrame, txn: DataFrame, contributions: DataFrame, trails: DataFrame | None = None, model_version: str = "v1.0") -> DataFrame:
    """Report of every alert: payment, risk, narrative, five leading features, trail state.

    ``contributions``: ``(transaction_id, top)`` with ``top`` an ordered array of
    ``struct(feature, contribution)``.
    """
    payment = txn.select("transaction_id", F.col("amount").alias("__amount"), F.col("channel").alias("__channel"))
    joined = alerts.join(payment, "transaction_id", "left").join(contributions, "transaction_id", "left")
    top = F.slice(F.coalesce("top", F.array().cast("array<struct<feature:string,contribution:double>>")), 1, 5)
    if trails is None:
        summary = F.struct(F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("forward_hops"), F.lit(0).cast("long").alias("backward_hops"))
    else:
        counts = trails.select("alert_id", F.col("forward_hops").alias("__f"), F.col("backward_hops").alias("__b"))
        joined = joined.join(counts, "alert_id", "left")
        summary = F.struct(
            F.when(F.col("__f").isNull(), "PENDING").otherwise("AVAILABLE").alias("status"),
            F.coalesce("__f", F.lit(0)).alias("forward_hops"),
            F.coalesce("__b", F.lit(0)).alias("backward_hops"),
        )
    return joined.filter(F.col("action").isin("REVIEW", "HIGH_RISK")).select(
        "alert_id",
        F.lit("STR").alias("report_type"),
        F.lit("FINnet_2.0").alias("standard"),
        F.lit(model_version).alias("model_version"),
        F.lit("DRAFT").alias("status"),
        F.struct(
            F.col("transaction_id").alias("id"),
            F.col("__amount").alias("amount_inr"),
            F.col("__channel").alias("channel"),
        ).alias("transaction"),
        F.struct(
            F.bround("score", 4).alias("fraud_score"),
            F.col("gate").alias("gate_fired"),
            top.alias("top_contributing_features"),
        ).alias("risk_assessment"),
        narrative(F.col("gate"), F.transform(top, lambda e: e["feature"]), F.col("score")).alias("narrative"),
        summary.alias("fund_trail_summary"),
    )


def report_payload(alerts: DataFrame, txn: DataFrame, drafts: DataFrame, as_of: Column, entity: str = "REPORTING_ENTITY") -> DataFrame:
    """Flat filing row of each alert and its fingerprint."""
    payment = txn.select("transaction_id", F.col("amount").alias("__amount"), F.col("account_id").alias("__account"))
    text = drafts.select("alert_id", "narrative")
    joined = alerts.drop("account_id").join(payment, "transaction_id").join(text, "alert_id", "left")
    kind = F.col("fraud_type") if "fraud_type" in alerts.columns else F.lit(None).cast("string")
    return joined.select(
        F.lit("STR").alias("report_type"),
        F.lit(entity).alias("reporting_entity_name"),
        F.lit("BANK").alias("reporting_entity_type"),
        F.lit("MAIN").alias("branch_code"),
        F.to_date(as_of).alias("report_date"),
        F.col("alert_id").alias("report_reference"),
        F.col("transaction_id").alias("transaction_reference"),
        F.lit("INR").alias("currency"),
        F.col("__amount").cast("double").alias("amount"),
        F.col("__account").alias("account_id"),
        F.coalesce(kind, F.lit("UNKNOWN")).alias("fraud_type"),
        F.coalesce("narrative", F.lit("Investigator review required")).alias("narrative"),
        report_hash(F.col("alert_id"), F.col("transaction_id"), F.col("__amount")).alias("payload_hash"),
    )


def evidence_package(
    alerts: DataFrame, scores: DataFrame, trails: DataFrame, drafts: DataFrame, breakdown: DataFrame | None = None
) -> DataFrame:
    """Everything known about an alert in one nested row."""
    stored = scores.select(
        "transaction_id",
        *[c for c in ("feature_vector", "shap_values") if c in scores.columns],
    )
    trail = trails.select("alert_id", F.struct(*[c for c in trails.columns if c not in ("alert_id", "transaction_id")]).alias("fund_trail"))
    draft = drafts.select("alert_id", F.struct(*[c for c in drafts.columns if c != "alert_id"]).alias("str_draft"))
    out = (
        alerts.join(stored, "transaction_id", "left").join(trail, "alert_id", "left").join(draft, "alert_id", "left")
    )
    if breakdown is not None:
        out = out.join(breakdown.withColumnRenamed("breakdown", "committee_breakdown"), "transaction_id", "left")
    return out.withColumnRenamed("gate", "gate_fired")


def seal(evidence: DataFrame, columns: list[str], sealed_at: Column, investigator: Column | None = None) -> DataFrame:
    """Digest of the canonical form of each package."""
    return evidence.select(
        "alert_id",
        canonical_hash(*columns).alias("evidence_hash"),
        sealed_at.alias("sealed_at"),
        (investigator if investigator is not None else F.lit(None).cast("string")).alias("investigator_id"),
    )


def verify_seal(evidence: DataFrame, columns: list[str], seals: DataFrame) -> DataFrame:
    """Whether each package still matches its newest seal; no seal reads as not intact."""
    newest = latest_per_key(seals, "alert_id", "sealed_at").select("alert_id", "evidence_hash")
    fresh = evidence.select("alert_id", canonical_hash(*columns).alias("__now"))
    return fresh.join(newest, "alert_id", "left").select(
        "alert_id", F.coalesce(F.col("__now") == F.col("evidence_hash"), F.lit(False)).alias("intact")
    )


def erase(accounts: DataFrame, txn: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New frames with the personal columns of the requesting accounts emptied.

    Columns a filing needs are protected and never touched.
    """
    asked = requests.select(F.col("account_id").alias("__asked")).distinct()

    def blanked(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        joined = df.join(asked, df[key] == asked["__asked"], "left")
        return joined.select(
            *[
                F.when(F.col("__asked").isNull(), F.col(c)).alias(c)
                if c in columns and c not in C.PROTECTED_COLUMNS
                else F.col(c)
                for c in df.columns
            ]
        )

    return (
        blanked(accounts, "id", C.ERASABLE_ACCOUNT_COLUMNS),
        blanked(txn, "account_id", C.ERASABLE_TXN_COLUMNS),
    )


def expired_features(features: DataFrame, as_of: Column, years: int = 5) -> DataFrame:
    """Feature rows past the retention period."""
    return features.filter(
        F.col("computed_at").cast("timestamp") < as_of - F.expr(f"INTERVAL {years} YEARS")
    )


def processing_ledger(
    df: DataFrame, operation: str, categories: list[str], basis: str, processed_at: Column, key: str = ""
) -> DataFrame:
    """One ledger row per account whose data was processed."""
    return df.select("account_id").distinct().select(
        pseudonymize(F.col("account_id"), key).alias("account_id_hash"),
        F.lit(operation).alias("operation"),
        F.lit(",".join(categories)).alias("categories"),
        F.lit(basis).alias("lawful_basis"),
        processed_at.alias("processed_at"),
    )
