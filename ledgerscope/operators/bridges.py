"""Outside labelled sets mapped onto the feature registry, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import clamp, normalize
from ledgerscope.operators.profile import account_profile, channel_entropy

# ── Fixed values: code tables of the outside sets ───────────────────────────
EMPLOYMENT_COMPLETENESS = {
    "CA": 0.6, "CB": 0.65, "CC": 0.75, "CD": 0.85, "CE": 0.90, "CF": 0.80, "CG": 0.50,
}
EMPLOYMENT_DEFAULT = 0.7
HOUSING_STABILITY = {"BA": 0.9, "BB": 0.95, "BC": 0.6, "BD": 0.5, "BE": 0.4}
HOUSING_DEFAULT = 0.6
AUTHENTICATION_RISK = {
    "Biometric": 0.05, "Two-Factor Authentication": 0.1, "OTP": 0.3, "Password Only": 0.6,
}
AUTHENTICATION_DEFAULT = 0.3
OCCUPATION_COMPLETENESS = {"Doctor": 0.95, "Engineer": 0.92, "Student": 0.70, "Retired": 0.85}
OCCUPATION_DEFAULT = 0.8
CARD_CHANNELS = {
    "Mobile App": "channel_upi", "Web Banking": "channel_neft",
    "POS Terminal": "channel_imps", "ATM": "channel_imps",
}
BANK_CHANNELS = {"Online": "channel_upi", "ATM": "channel_imps", "Branch": "channel_neft"}


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def _or(name: str, default: float) -> Column:
    """The column as a double; null and zero both read as the default."""
    value = F.col(name).cast("double")
    return F.when(value.isNull() | (value == 0), float(default)).otherwise(value)


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _channels(kind: Column, table: dict[str, str]) -> dict[str, Column]:
    names = ["channel_upi", "channel_imps", "channel_rtgs", "channel_neft"]
    return {n: _flag(F.coalesce(kind.isin([k for k, v in table.items() if v == n]), F.lit(False))) for n in names}


def _amount_columns(amount: Column, rounding: int) -> dict[str, Column]:
    columns = {
        "txn_amount": amount,
        "txn_amount_log": F.log1p(amount),
        "txn_amount_rounded": _flag(amount % rounding == 0),
    }
    for limit in C.REPORTING_THRESHOLDS:
        columns[f"amount_vs_threshold_{limit}"] = amount / limit
    return columns


def _group_code(value: Column, groups: int) -> Column:
    """A stable small code standing in for a community."""
    return F.pmod(F.xxhash64(value), F.lit(groups)).cast("double")


def _assembled(df: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    lacking = set(C.BRIDGE_FEATURES) - set(features)
    if lacking:
        raise ValueError(f"bridge leaves out {sorted(lacking)}")
    return df.select(*keep, *[features[n].cast("double").alias(n) for n in C.BRIDGE_FEATURES])


def bridge_account_opening(df: DataFrame, keep: list[str]) -> DataFrame:
    """Account-opening applications: velocities, identity counts and credit risk as stand-ins."""
    rows = df
    steps: list[tuple[str, Column]] = []

    def let(name: str, value: Column) -> Column:
        steps.append((name, value))
        return F.col(name)

    v6, v24, v4w = (let(f"__{n}", F.coalesce(F.col(n).cast("double"), F.lit(0.0))) for n in ("velocity_6h", "velocity_24h", "velocity_4w"))
    zips, branches = let("__zip", _or("zip_count_4w", 1)), let("__branch", _or("bank_branch_count_8w", 1))
    dob = let("__dob", _or("date_of_birth_distinct_emails_4w", 0))
    device = let("__device", _or("device_distinct_emails_8w", 0))
    device_fraud = let("__dfraud", _or("device_fraud_count", 0))
    credit, limit = let("__credit", _or("credit_risk_score", 500)), let("__limit", _or("proposed_credit_limit", 1000))
    income, balcon = let("__income", _or("income", 0.5)), let("__balcon", _or("intended_balcon_amount", 0))
    foreign, free = let("__foreign", _or("foreign_request", 0)), let("__free", _or("email_is_free", 0))
    home, mobile = let("__home", _or("phone_home_valid", 1)), let("__mobile", _or("phone_mobile_valid", 1))
    cards = let("__cards", _or("has_other_cards", 0))
    safe = let("__safe", normalize(credit, -150, 400))
    rate = let("__rate", (v6 / 6.0) / F.greatest(v4w / 672.0, F.lit(0.01)))
    burst = let("__burst", clamp(rate / 50.0))
    speed = let("__speed", clamp(rate / 10.0, 0.0, 30.0))
    rank = let("__rank", clamp(device_fraud / F.greatest(device_fraud + 3, F.lit(1.0)) * 0.5 + (1 - safe) * 0.35 + free * 0.15))
    crowd = let("__crowd", clamp(normalize(zips, 1, 2000) * 0.3 + normalize(dob, 0, 20) * 0.4 + normalize(device, 0, 10) * 0.3))
    ratio = balcon / (income * 50_000 + 1)
    sink = let(
        "__sink",
        F.when((income > 0) & (balcon > 0), normalize(ratio, 0, 5))
        .when(balcon > 1000, normalize(balcon, 0, 10_000))
        .otherwise(clamp((1 - safe) * 0.4)),
    )
    novelty = let("__novelty", normalize(device, 0, 20))
    kyc = let(
        "__kyc",
        clamp(
            _lookup(F.col("employment_status"), EMPLOYMENT_COMPLETENESS, EMPLOYMENT_DEFAULT) * 0.4
            + _lookup(F.col("housing_status"), HOUSING_STABILITY, HOUSING_DEFAULT) * 0.3
            + mobile * 0.15
            + home * 0.1
            + (1.0 - free * 0.5) * 0.05
        ),
    )
    unsettled = F.greatest(F.floor(_or("prev_address_months_count", 12)), F.lit(-1)).isin(-1, 0, 1, 2)
    geo = let("__geo", clamp(foreign * 0.8 + F.when(unsettled, 0.2).otherwise(0.0)))
    bridge = let("__bridge", clamp(normalize(dob, 0, 10) * 0.4 + normalize(device, 0, 10) * 0.3 + burst * 0.3))
    dormant = let("__dormant", _flag((_or("session_length_in_minutes", 10) < 2.0) & (v6 >= 3)))
    age = F.greatest(_or("bank_months_count", 12), F.lit(0.0)) * 30
    fallback_age = F.greatest(_or("current_address_months_count", 12), F.lit(0.0)) * 30
    amount = let("__amount", limit * 10.0)
    partners = let("__partners", clamp(device + zips / 10.0, 0.0, 50.0))
    for name, value in steps:
        rows = rows.withColumn(name, value)
    features = {
        **_amount_columns(amount, 1000),
        "degree_centrality": normalize(v4w, 0, 100),
        "betweenness_centrality": clamp(bridge * 0.1),
        "clustering_coefficient": clamp(1.0 - novelty),
        "pagerank_fraud_seeded": rank,
        "community_id": _group_code(F.col("employment_status"), 200),
        "community_fraud_ratio": crowd,
        "shortest_path_to_fraud": F.when(device_fraud > 0, 0.0)
        .when(crowd > 0.6, 1.0)
        .when(rank > 0.5, 2.0)
        .otherwise(clamp(2.0 + safe * 4.0, 0.0, 6.0)),
        "cycle_membership": F.lit(0.0),
        "sink_score": sink,
        "bipartite_score": clamp(normalize(zips, 1, 2000) * 0.5 + normalize(branches, 1, 50) * 0.5),
        "fan_out_ratio": clamp(1.0 - sink),
        "temporal_acceleration": speed,
        "cash_mule_sink_score": clamp(sink * 0.7 + (1 - kyc) * 0.3),
        "bridge_node_probability": bridge,
        "dormancy_reactivation_flag": dormant,
        "dormancy_break": dormant,
        "account_age_days": F.when(age == 0, fallback_age).otherwise(age),
        "kyc_completeness_score": kyc,
        "txn_count_30d": v4w,
        "txn_count_90d": v4w * 3,
        "txn_count_all": v4w * 12,
        "avg_txn_amount_30d": amount,
        "distinct_counterparties_30d": partners,
        "distinct_payees_24h": partners,
        "channel_entropy": F.when(F.col("source") == "INTERNET", 1.5).otherwise(0.5),
        "night_txn_ratio": F.when(dormant == 0.0, 0.1).otherwise(0.6),
        "weekend_txn_ratio": F.lit(0.3),
        "return_ratio": clamp(sink),
        "amount_zscore": clamp(normalize(limit, 100, 10_000) * 5.0, 0.0, 10.0),
        "counterparty_novelty": novelty,
        "hour_deviation": F.lit(0.0),
        "channel_switch": clamp(cards * 0.5 + (1 - home) * 0.3),
        "amount_series_score": normalize(dob, 0, 5),
        "burst_score": burst,
        "velocity_ratio": speed,
        "geography_switch": geo,
        "channel_upi": F.lit(1.0),
        "channel_imps": F.lit(0.0),
        "channel_rtgs": F.lit(0.0),
        "channel_neft": F.lit(0.0),
        "hour_of_day": F.lit(12.0),
        "day_of_week": F.lit(1.0),
        "is_weekend": F.lit(0.0),
        "is_night": F.lit(0.0),
        "is_festival_period": _flag(_or("month", 6).isin(10, 11)),
        "payee_vpa_age_days": F.greatest(_or("days_since_request", 0), F.lit(1.0)),
        "txn_count_last_1h": v6 / 6.0,
        "txn_count_last_24h": v24,
        "txn_count_last_7d": v4w / 4.0,
        "txn_volume_last_1h": amount * (v6 / 6.0),
        "txn_volume_last_24h": amount * v24,
        "payee_in_alert_log": _flag(device_fraud > 0),
        "payee_shared_alert_count": device_fraud,
    }
    return _assembled(rows, features, keep)


def bridge_card_risk(df: DataFrame, keep: list[str]) -> DataFrame:
    """Risk-scored payments: device, address, speed and anomaly scores as stand-ins."""
    amount, hour = F.col("transaction_amount").cast("double"), F.col("transaction_time_hour")
    login, risk = F.col("login_attempts").cast("double"), F.col("device_risk_score") / 100.0
    anomaly, speed = F.col("anomaly_score"), F.col("transaction_velocity_score")
    daily, failed = F.col("daily_transaction_count").cast("double"), F.col("failed_transactions_last_30d")
    balance, session = F.col("avg_monthly_balance"), F.col("session_duration_minutes").cast("double")
    abroad, bad_ip = F.col("international_transaction_flag").cast("double"), F.col("suspicious_ip_flag").cast("double")
    auth = _lookup(F.coalesce("authentication_type", F.lit("OTP")), AUTHENTICATION_RISK, AUTHENTICATION_DEFAULT)
    rows = (
        df.withColumn("__geo", clamp(abroad * 0.6 + normalize(F.col("geo_distance_km"), 0, 15_000) * 0.4))
        .withColumn("__burst", clamp(speed / 100.0 * 0.6 + anomaly * 0.4))
        .withColumn("__sink", clamp(amount / (balance + 1.0)))
        .withColumn("__count", clamp(daily, 0.0, 120.0))
        .withColumn("__hourly", clamp(daily / 24.0, 0.0, 20.0))
        .withColumn("__payees", clamp(daily / 5.0, 0.0, 20.0))
        .withColumn("__ratio", clamp(speed / 10.0, 0.0, 30.0))
        .withColumn("__dormant", _flag((session < 2) & (speed > 70)))
        .withColumn("__night", _flag((hour >= 22) | (hour < 5)))
        .withColumn("__bridge", clamp(anomaly * 0.5 + bad_ip * 0.3 + F.col("__geo") * 0.2))
        .withColumn("__novelty", clamp(F.col("__geo") * 0.5 + normalize(login, 1, 12) * 0.5))
    )
    count = F.col("__count")
    features = {
        **_amount_columns(amount, 100),
        **_channels(F.coalesce("payment_channel", F.lit("Mobile App")), CARD_CHANNELS),
        "degree_centrality": normalize(daily, 1, 120),
        "betweenness_centrality": clamp(F.col("__bridge") * 0.1),
        "clustering_coefficient": clamp(1.0 - F.col("__novelty")),
        "pagerank_fraud_seeded": clamp(risk * 0.5 + bad_ip * 0.3 + anomaly * 0.2),
        "community_id": _group_code(F.col("payment_channel"), 100),
        "community_fraud_ratio": clamp(bad_ip * 0.6 + anomaly * 0.4),
        "shortest_path_to_fraud": F.greatest(5.0 - F.col("device_risk_score") / 25.0, F.lit(0.0)),
        "cycle_membership": F.lit(0.0),
        "sink_score": F.col("__sink"),
        "bipartite_score": clamp(normalize(daily, 1, 120) * 0.7 + anomaly * 0.3),
        "fan_out_ratio": clamp(1.0 - F.col("__sink")),
        "temporal_acceleration": F.col("__ratio"),
        "cash_mule_sink_score": clamp(F.col("__sink") * 0.6 + F.col("__burst") * 0.4),
        "bridge_node_probability": F.col("__bridge"),
        "dormancy_reactivation_flag": F.col("__dormant"),
        "dormancy_break": F.col("__dormant"),
        "account_age_days": F.col("account_age_days"),
        "kyc_completeness_score": clamp(F.coalesce(F.col("card_present_flag"), F.lit(1)) * 0.4 + (1 - auth) * 0.6),
        "txn_count_30d": count * 30,
        "txn_count_90d": count * 90,
        "txn_count_all": count * 365,
        "avg_txn_amount_30d": amount,
        "distinct_counterparties_30d": F.col("__payees"),
        "distinct_payees_24h": F.col("__payees"),
        "channel_entropy": 0.5 + abroad * 0.5,
        # The hour term spans an empty interval and always reads as 0.
        "night_txn_ratio": F.col("__night") * 0.5,
        "weekend_txn_ratio": F.lit(0.3),
        "return_ratio": clamp(1.0 - balance / (balance + amount + 1.0)),
        "amount_zscore": clamp(normalize(amount, 6, 25_000) * 5.0, 0.0, 10.0),
        "counterparty_novelty": F.col("__novelty"),
        "hour_deviation": F.abs(hour - 14.0) / 10.0,
        "channel_switch": clamp((login - 1) / 11.0 * 0.5 + auth * 0.5),
        "amount_series_score": clamp(failed / 25.0),
        "burst_score": F.col("__burst"),
        "velocity_ratio": F.col("__ratio"),
        "geography_switch": F.col("__geo"),
        "hour_of_day": hour,
        "day_of_week": F.lit(1.0),
        "is_weekend": F.lit(0.0),
        "is_night": F.col("__night"),
        "is_festival_period": F.lit(0.0),
        "payee_vpa_age_days": F.greatest(session, F.lit(1.0)),
        "txn_count_last_1h": F.col("__hourly"),
        "txn_count_last_24h": count,
        "txn_count_last_7d": count * 7,
        "txn_volume_last_1h": amount * F.col("__hourly"),
        "txn_volume_last_24h": amount * F.least(count, F.lit(10.0)),
        "payee_in_alert_log": bad_ip,
        "payee_shared_alert_count": failed,
    }
    return _assembled(rows, features, keep)


def with_bank_profile(rows: DataFrame) -> DataFrame:
    """Bank rows joined with the profile and channel entropy of their account."""
    profile = account_profile(rows).join(channel_entropy(rows), "account_id")
    return rows.join(profile, "account_id")


def bridge_bank_transactions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Bank rows: the account's own behaviour where it exists, login attempts for the rest.

    ``rows`` needs ``account_id, amount, direction, channel, location, device_id,
    merchant_id, balance, login_attempts, duration, occupation, ts``.
    """
    stats = rows.agg(F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std")).first()
    mean, std = float(stats["mean"] or 0.0), float(stats["std"] or 0.0)
    joined = with_bank_profile(rows)
    amount, login = F.col("amount").cast("double"), F.col("login_attempts").cast("double")
    hour, weekday = F.hour("ts"), F.weekday("ts")
    n, merchants = F.col("txn_count_all").cast("double"), F.col("n_merchants").cast("double")
    zscore = F.lit(0.0) if std < 1e-9 else F.abs((amount - mean) / std)
    burst = F.least(login / 5.0, F.lit(1.0))
    switch, geo, sink = F.col("channel_switch"), F.col("geography_switch"), F.col("sink_score")

    def most(value: Column, top: float) -> Column:
        return F.least(value, F.lit(top))

    features = {
        **_amount_columns(amount, 100),
        **_channels(F.coalesce("channel", F.lit("Online")), BANK_CHANNELS),
        "hour_of_day": hour,
        "day_of_week": weekday,
        "is_weekend": _flag(weekday >= 5),
        "is_night": _flag((hour >= 22) | (hour < 5)),
        "is_festival_period": F.lit(0.0),
        "payee_vpa_age_days": F.coalesce(F.col("duration").cast("double"), F.lit(30.0)),
        "txn_count_last_1h": login,
        "txn_count_last_24h": most(n, 10.0),
        "txn_count_last_7d": most(n, 30.0),
        "txn_volume_last_1h": amount * login,
        "txn_volume_last_24h": F.col("avg_amount") * most(n, 5.0),
        "distinct_payees_24h": most(merchants, 10.0),
        "payee_in_alert_log": F.lit(0.0),
        "payee_shared_alert_count": F.lit(0.0),
        "degree_centrality": most(n / 50.0, 1.0),
        "betweenness_centrality": most(merchants / 100.0, 0.1),
        "clustering_coefficient": F.greatest(1.0 - geo, F.lit(0.0)),
        "pagerank_fraud_seeded": most(burst * 0.8, 1.0),
        "community_id": _group_code(F.col("account_id"), 200),
        "community_fraud_ratio": most(switch * 0.9, 1.0),
        "shortest_path_to_fraud": F.greatest(5.0 - login, F.lit(0.0)),
        "cycle_membership": F.lit(0.0),
        "sink_score": sink,
        "bipartite_score": most(merchants / 10.0, 1.0),
        "fan_out_ratio": most(merchants / F.greatest(n, F.lit(1.0)), 1.0),
        "temporal_acceleration": login,
        "cash_mule_sink_score": sink * burst,
        "bridge_node_probability": most(geo * switch, 1.0),
        "dormancy_reactivation_flag": F.lit(0.0),
        "dormancy_break": F.lit(0.0),
        "account_age_days": F.greatest(n * 10, F.lit(1.0)),
        "kyc_completeness_score": _lookup(F.coalesce("occupation", F.lit("Engineer")), OCCUPATION_COMPLETENESS, OCCUPATION_DEFAULT),
        "txn_count_30d": most(n, 30.0),
        "txn_count_90d": most(n * 3, 90.0),
        "txn_count_all": n,
        "avg_txn_amount_30d": F.col("avg_amount"),
        "distinct_counterparties_30d": most(merchants, 20.0),
        "channel_entropy": F.col("channel_entropy"),
        "night_txn_ratio": F.col("night_txn_ratio"),
        "weekend_txn_ratio": F.col("weekend_txn_ratio"),
        "return_ratio": F.col("return_ratio"),
        "amount_zscore": zscore,
        "counterparty_novelty": F.col("counterparty_novelty"),
        "hour_deviation": F.abs(hour - 14.0) / 10.0,
        "channel_switch": switch,
        "amount_series_score": most(zscore / 5.0, 1.0),
        "burst_score": burst,
        "velocity_ratio": login,
        "geography_switch": geo,
    }
    return _assembled(joined, features, keep)
