"""Tier 1 rules, per-payment features and context-dependent score adjustment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions import rules as R


def tier1_flag_array() -> Column:
    """Suspicion flags in their fixed order."""
    conditions = [
        (F.col("payee_vpa_age_days") < 7, "new_vpa"),
        (R.is_night(F.col("ts")), "night"),
        (
            (F.col("velocity_1h") > 5)
            & ~R.occupation_in(F.col("kyc_occupation"), C.HIGH_FREQUENCY_OCCUPATIONS),
            "velocity_spike",
        ),
        (R.near_threshold_band(F.col("amount")), "threshold_proximity"),
        (F.col("payee_account_age_days") < 14, "new_payee_account"),
        (
            (F.col("avg_amount_30d") > 0) & (F.col("amount") > F.col("avg_amount_30d") * 5),
            "amount_spike",
        ),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in conditions]))


def tier1_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("tier1_flags", tier1_flag_array())


def tier1_classify(df: DataFrame) -> DataFrame:
    """SUSPICIOUS on any flag, FAST_CLEAN when all calm conditions hold, else UNCERTAIN."""
    calm = (
        (F.col("account_age_days") > 365)
        & (F.col("avg_amount_30d") > 0)
        & (F.col("amount") < F.col("avg_amount_30d") * 2)
        & F.col("payee_in_known_contacts")
        & ~R.is_night(F.col("ts"))
        & (F.col("velocity_24h") < 10)
    )
    flagged = df if "tier1_flags" in df.columns else tier1_flags(df)
    return flagged.withColumn(
        "tier1_result",
        F.when(F.size("tier1_flags") > 0, "SUSPICIOUS").when(calm, "FAST_CLEAN").otherwise("UNCERTAIN"),
    )


def archetype_labels(df: DataFrame) -> DataFrame:
    """Investigator labels; they never touch score or action."""
    frequent = R.occupation_in(F.col("kyc_occupation"), C.HIGH_FREQUENCY_OCCUPATIONS)
    amount, velocity = F.col("amount"), F.col("velocity_24h")
    labels = [
        (R.near_threshold_band(amount) & (velocity > 8) & ~frequent, "hawala"),
        (
            (amount >= 10_000)
            & (amount % 10_000 == 0)
            & (F.col("payee_account_age_days") < 7)
            & (velocity > 5),
            "crypto_on_ramp",
        ),
        ((F.col("account_age_days") > 365) & (velocity > 15) & ~frequent, "benami"),
    ]
    return df.withColumn(
        "archetypes", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in labels]))
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def txn_feature_columns() -> dict[str, Column]:
    amount, ts, channel = F.col("amount").cast("double"), F.col("ts"), F.col("channel")
    weekday = F.weekday(ts)
    columns = {
        "txn_amount": amount,
        "txn_amount_log": F.log1p(amount),
        "txn_amount_rounded": _flag(amount % 1000 == 0),
        **{f"channel_{c.lower()}": _flag(channel == c) for c in C.REQUEST_CHANNELS},
        "hour_of_day": F.hour(ts).cast("double"),
        "day_of_week": weekday.cast("double"),
        "is_weekend": _flag(weekday >= 5),
        "is_night": _flag(R.is_night(ts)),
        "is_festival_period": _flag(R.is_festival(ts)),
    }
    for limit in C.REPORTING_THRESHOLDS:
        columns[f"amount_vs_threshold_{limit}"] = amount / limit
    return columns


def txn_features(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in txn_feature_columns().items()])


def apply_context(df: DataFrame, score: str = "raw_score") -> DataFrame:
    """Multiply the raw score by the factors that apply, in their fixed order.

    Adds ``adjusted_score`` (at most 1) and ``adjustments``, a map from factor
    name to the value used.
    """
    ts, amount = F.col("ts"), F.col("amount")
    vpa_age, hour = F.col("payee_vpa_age_days"), F.hour(F.col("ts"))
    gifts = F.col("has_festival_gifting_history")
    senior = F.col("kyc_age") > 60
    small = (amount < 5_000) & gifts & (vpa_age < 30)
    medium = amount.between(5_000, 50_000) & gifts & (vpa_age > 7)
    factors = [
        ("festival_small_gift", R.is_festival(ts) & small, 0.70),
        ("festival_medium_gift", R.is_festival(ts) & ~F.coalesce(small, F.lit(False)) & medium, 0.90),
        (
            "gig_worker_velocity",
            (F.col("daily_txn_count") > 10)
            & (F.col("channel") == "UPI")
            & R.occupation_in(F.col("kyc_occupation"), C.GIG_OCCUPATIONS)
            & hour.between(11, 23),
            0.85,
        ),
        ("jan_dhan_cash_pattern", F.col("account_type") == "JAN_DHAN", 0.75),
        (
            "merchant_batch_settlement",
            R.occupation_in(F.col("kyc_occupation"), C.MERCHANT_OCCUPATIONS)
            & (amount % 100 == 0)
            & hour.between(18, 23),
            0.80,
        ),
        ("senior_night_amplification", senior & R.is_night(ts), 1.50),
        ("senior_new_vpa_amplification", senior & (vpa_age < 7), 1.30),
    ]
    product = F.col(score)
    applied = []
    for name, test, value in factors:
        holds = F.coalesce(test, F.lit(False))
        product = product * F.when(holds, value).otherwise(1.0)
        applied.append(F.when(holds, F.struct(F.lit(name).alias("key"), F.lit(value).alias("value"))))
    hours = F.col("graph_staleness_hours")
    stale = F.coalesce(hours > C.STALE_AFTER_HOURS, F.lit(False))
    excess = F.least(hours - C.STALE_AFTER_HOURS, F.lit(float(C.STALE_SPAN_HOURS)))
    keep = 1.0 - excess / C.STALE_SPAN_HOURS * C.STALE_MAX_REGRESSION
    applied.append(
        F.when(
            stale,
            F.struct(F.lit("graph_staleness_penalty").alias("key"), F.bround(keep, 3).alias("value")),
        )
    )
    out = df.withColumn("__product", product)
    regressed = F.when(stale, F.col("__product") * keep + 0.5 * (1.0 - keep)).otherwise(F.col("__product"))
    return (
        out.withColumn("adjusted_score", F.when(regressed.isNotNull(), F.least(regressed, F.lit(1.0))))
        .withColumn("adjustments", F.map_from_entries(F.array_compact(F.array(*applied))))
        .drop("__product")
    )


def canary_override(df: DataFrame, canaries: DataFrame) -> DataFrame:
    """Mark canary accounts and give them their fixed score and action."""
    known = canaries.select(F.col("account_id").alias("__canary")).distinct()
    joined = df.join(known, df["account_id"] == known["__canary"], "left")
    is_canary = F.col("__canary").isNotNull()
    return (
        joined.withColumn("is_canary", is_canary)
        .withColumn("score", F.when(is_canary, C.CANARY_SCORE).otherwise(F.col("score")))
        .withColumn("action", F.when(is_canary, C.CANARY_ACTION).otherwise(F.col("action")))
        .drop("__canary")
    )


def heuristic_score() -> Column:
    """Score used while no model is available; missing inputs add nothing."""
    parts = [
        F.when(F.col("payee_vpa_age_days") < 7, 0.25).otherwise(0.0),
        F.when(F.col("is_night") == 1.0, 0.15).otherwise(0.0),
        F.when(F.col("txn_count_last_1h") > 5, 0.20).otherwise(0.0),
        F.coalesce(F.col("pagerank_fraud_seeded") * 0.30, F.lit(0.0)),
        F.when(F.col("cycle_membership") == 1.0, 0.40).otherwise(0.0),
    ]
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0))


def session_missing_flag(columns: list[str] | None = None) -> Column:
    """More than one of the eight session features is null."""
    names = columns or C.SESSION_FEATURES
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in names]) > 1


def large_value_escalation(df: DataFrame) -> DataFrame:
    """High-risk rows of a million or more; ``hold_candidate`` marks any such amount."""
    return df.filter(R.large_value(F.col("amount"), F.col("action")))


def hold_candidates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("amount") >= C.LARGE_VALUE)


def pseudo_labels(df: DataFrame) -> DataFrame:
    """Weak labels of bank rows joined with their account profile."""
    logins = F.col("login_attempts")
    switch, geo = F.col("channel_switch"), F.col("geography_switch")
    rules = (
        (logins >= 3)
        | ((F.col("n_locations") >= 3) & (logins >= 2))
        | ((F.col("amount") > F.col("avg_amount") * 3) & (F.col("night_txn_ratio") > 0.5))
        | ((switch > 0.5) & (geo > 0))
    )
    return df.withColumn("label", F.when(rules, 1).otherwise(0))


def context_vector_columns() -> dict[str, Column]:
    """Five context inputs of the meta-learner, each at most 1."""
    codes = F.create_map(*[F.lit(x) for pair in C.ACCOUNT_TYPE_CODES.items() for x in pair])
    kind = F.upper(F.coalesce(F.col("account_type"), F.lit("SAVINGS")))
    return {
        "account_type_code": F.coalesce(F.try_element_at(codes, kind), F.lit(0.0)),
        "kyc_age_norm": F.least(F.coalesce(F.col("kyc_age").cast("double"), F.lit(0.0)) / C.KYC_AGE_CAP, F.lit(1.0)),
        "ctx_festival": _flag(R.is_festival(F.col("ts"))),
        "ctx_night": _flag(R.is_night(F.col("ts"))),
        "daily_count_norm": F.least(
            F.coalesce(F.col("daily_txn_count").cast("double"), F.lit(0.0)) / C.DAILY_COUNT_CAP, F.lit(1.0)
        ),
    }


def context_vector(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in context_vector_columns().items()])


def assemble_features(df: DataFrame, version: str = "V2", keys: list[str] | None = None) -> DataFrame:
    """Key columns, then the registry columns in order; a column nobody computed is null."""
    present = set(df.columns)
    return df.select(
        *(keys or []),
        *[
            (F.col(name) if name in present else F.lit(None)).cast("double").alias(name)
            for name in C.FEATURE_VERSIONS[version]
        ],
    )
