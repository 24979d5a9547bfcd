"""Accounts, payments, scores and alerts derived from the star-schema tables.

The test tables hold no payments, so every query starts from these views.  Each
view exists twice: as a DataFrame and as the SQL text of the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.session import tune

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind = F.col("event_type")
    channel = (
        F.when(kind == "purchase", "UPI")
        .when(kind == "click", "IMPS")
        .when(kind == "view", "NEFT")
        .when(kind == "signup", "RTGS")
        .otherwise("ATM")
    )
    mcc = (
        F.when(k % 5 == 0, "5411")
        .when(k % 5 == 1, "5812")
        .when(k % 5 == 2, "5912")
        .when(k % 5 == 3, "7011")
        .otherwise("5999")
    )
    at_terminal = F.col("event_id") % 5 == 0
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        k.alias("payee_account_id"),
        F.round(F.col("value") * 1000, 2).alias("amount"),
        channel.alias("channel"),
        "ts",
        k.alias("payee_vpa"),
        ((F.col("user_id") + F.col("event_id") % 3) % 40).alias("device_id"),
        (F.col("event_id") % 7).alias("geo_state"),
        F.when(at_terminal, k % 10).alias("merchant_terminal_id"),
        F.when(at_terminal, mcc).alias("merchant_mcc"),
    )


TXN_SQL = """
SELECT event_id AS transaction_id, user_id AS account_id, k AS payee_account_id,
  round(value * 1000, 2) AS amount,
  CASE event_type WHEN 'purchase' THEN 'UPI' WHEN 'click' THEN 'IMPS' WHEN 'view' THEN 'NEFT'
    WHEN 'signup' THEN 'RTGS' ELSE 'ATM' END AS channel,
  ts, k AS payee_vpa, (user_id + event_id % 3) % 40 AS device_id, event_id % 7 AS geo_state,
  CASE WHEN event_id % 5 = 0 THEN k % 10 END AS merchant_terminal_id,
  CASE WHEN event_id % 5 = 0 THEN CASE k % 5 WHEN 0 THEN '5411' WHEN 1 THEN '5812'
    WHEN 2 THEN '5912' WHEN 3 THEN '7011' ELSE '5999' END END AS merchant_mcc
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def txnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with the creation time of the payee handle."""
    payments = txn(spark, sf_dir)
    created = payments.groupBy(F.col("payee_vpa").alias("vpa")).agg(F.min("ts").alias("first_ts"))
    created = created.select(
        "vpa",
        (F.col("first_ts") - F.make_dt_interval((F.col("vpa") % 20).cast("int"))).alias(
            "payee_vpa_created_at"
        ),
    )
    return payments.join(created, payments["payee_vpa"] == created["vpa"], "left").drop("vpa")


TXNV_SQL = """
SELECT t.*, v.first_ts - (t.payee_vpa % 20) * INTERVAL 1 DAY AS payee_vpa_created_at
FROM txn t LEFT JOIN (SELECT payee_vpa, min(ts) AS first_ts FROM txn GROUP BY payee_vpa) v
  ON t.payee_vpa = v.payee_vpa"""


def acct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    occupation = (
        F.when(c % 8 == 0, "merchant")
        .when(c % 8 == 1, "gig_worker")
        .when(c % 8 == 2, "salaried")
        .when(c % 8 == 3, "student")
        .when(c % 8 == 4, "employer")
        .when(c % 8 == 5, "vegetable_vendor")
        .when(c % 8 == 6, "Retired")
    )
    return table(spark, sf_dir, "customer").select(
        c.alias("id"),
        F.when(segment == "BUILDING", "SAVINGS")
        .when(segment == "AUTOMOBILE", "CURRENT")
        .when(segment == "MACHINERY", "SALARY")
        .when(segment == "HOUSEHOLD", "JAN_DHAN")
        .otherwise("INTERNAL")
        .alias("account_type"),
        occupation.alias("kyc_occupation"),
        (F.col("c_acctbal") * 10).alias("kyc_declared_income_monthly"),
        (c % 60 + 18).cast("int").alias("kyc_age"),
        F.col("c_nationkey").alias("kyc_home_state"),
        ((c % 101) / 100.0).alias("kyc_completeness_score"),
        (c * 37 % 2000).cast("int").alias("account_age_days"),
        (c % 11 == 0).alias("is_merchant"),
        F.col("c_name").alias("holder_name"),
    )


ACCT_SQL = """
SELECT c_custkey AS id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'SAVINGS' WHEN 'AUTOMOBILE' THEN 'CURRENT'
    WHEN 'MACHINERY' THEN 'SALARY' WHEN 'HOUSEHOLD' THEN 'JAN_DHAN' ELSE 'INTERNAL' END AS account_type,
  CASE c_custkey % 8 WHEN 0 THEN 'merchant' WHEN 1 THEN 'gig_worker' WHEN 2 THEN 'salaried'
    WHEN 3 THEN 'student' WHEN 4 THEN 'employer' WHEN 5 THEN 'vegetable_vendor'
    WHEN 6 THEN 'Retired' END AS kyc_occupation,
  c_acctbal * 10 AS kyc_declared_income_monthly,
  CAST(c_custkey % 60 + 18 AS INTEGER) AS kyc_age, c_nationkey AS kyc_home_state,
  (c_custkey % 101) / 100.0::DOUBLE AS kyc_completeness_score,
  CAST(c_custkey * 37 % 2000 AS INTEGER) AS account_age_days,
  c_custkey % 11 = 0 AS is_merchant, c_name AS holder_name
FROM customer"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of the 30 days before ``AS_OF``, self transfers dropped."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    payments = txn(spark, sf_dir)
    return payments.filter(
        (F.col("ts") > start) & (F.col("account_id") != F.col("payee_account_id"))
    ).select(
        F.col("account_id").alias("src"),
        F.col("payee_account_id").alias("dst"),
        "amount",
        "ts",
        "channel",
        "transaction_id",
    )


EDGES_SQL = """
SELECT account_id AS src, payee_account_id AS dst, amount, ts, channel, transaction_id FROM txn
WHERE ts > TIMESTAMP '2024-01-01 00:00:00' AND account_id <> payee_account_id"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored score per payment; score and gate follow from the payment id."""
    t = F.col("transaction_id")
    score = (t * 7919 % 1000) / 1000.0
    gate = F.when(t % 40 == 0, "bipartite_core").when(t % 40 == 7, "confirmed_cycle")
    action = (
        F.when(score >= 0.83, "HIGH_RISK").when(score >= 0.62, "REVIEW").when(score >= 0.38, "LOG")
    ).otherwise("PASS")
    return txn(spark, sf_dir).select(
        "transaction_id",
        "account_id",
        "amount",
        "channel",
        score.alias("score"),
        gate.alias("gate_fired"),
        action.alias("action"),
        (t * 31 % 600).cast("int").alias("processing_ms"),
        F.col("ts").alias("scored_at"),
    )


SCORES_SQL = """
SELECT transaction_id, account_id, amount, channel, score,
  CASE WHEN transaction_id % 40 = 0 THEN 'bipartite_core'
    WHEN transaction_id % 40 = 7 THEN 'confirmed_cycle' END AS gate_fired,
  CASE WHEN score >= 0.83 THEN 'HIGH_RISK' WHEN score >= 0.62 THEN 'REVIEW'
    WHEN score >= 0.38 THEN 'LOG' ELSE 'PASS' END AS action,
  CAST(transaction_id * 31 % 600 AS INTEGER) AS processing_ms, scored_at
FROM (SELECT *, (transaction_id * 7919 % 1000) / 1000.0::DOUBLE AS score, ts AS scored_at FROM txn)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the stored scores; a third of them carry an investigator's verdict."""
    t = F.col("transaction_id")
    return (
        scores(spark, sf_dir)
        .filter(F.col("action").isin("REVIEW", "HIGH_RISK"))
        .select(
            F.concat(F.lit("A"), t.cast("string")).alias("alert_id"),
            "transaction_id",
            "account_id",
            "score",
            F.col("gate_fired").alias("gate"),
            "action",
            F.when(t % 3 == 0, "CONFIRMED_FRAUD").otherwise("OPEN").alias("status"),
            (t % 3 == 0).alias("investigator_decision"),
            F.col("scored_at").alias("created_at"),
        )
    )


ALERTS_SQL = """
SELECT 'A' || transaction_id AS alert_id, transaction_id, account_id, score, gate_fired AS gate, action,
  CASE WHEN transaction_id % 3 = 0 THEN 'CONFIRMED_FRAUD' ELSE 'OPEN' END AS status,
  transaction_id % 3 = 0 AS investigator_decision, scored_at AS created_at
FROM scores WHERE action IN ('REVIEW', 'HIGH_RISK')"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a confirmed alert above 0.99 - the known-fraud seeds."""
    return (
        alerts(spark, sf_dir)
        .filter(F.col("investigator_decision") & (F.col("score") >= 0.99))
        .select("account_id")
        .distinct()
    )


SEEDS_SQL = """
SELECT DISTINCT account_id FROM alerts WHERE investigator_decision AND score >= 0.99"""

# Multipliers of the stored scorer outputs.
_SCORERS = {"a": 7919, "b": 6007, "c": 5003, "d": 4001, "f": 3001}


def shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored committee outputs: five scorers per payment, flat columns."""
    t = F.col("transaction_id")
    columns = []
    for i, (name, factor) in enumerate(_SCORERS.items()):
        score = (t * factor % 1009) / 1008.0
        columns += [
            score.alias(f"scorer_{name}_score"),
            (F.abs(score - 0.5) * 2.0).alias(f"scorer_{name}_confidence"),
            (t % (i + 4) == 0).alias(f"scorer_{name}_missing_flag"),
        ]
    live = (t * 7919 % 1000) / 1000.0
    action = (
        F.when(live >= 0.83, "HIGH_RISK").when(live >= 0.62, "REVIEW").when(live >= 0.38, "LOG")
    ).otherwise("PASS")
    final = (t * 7919 % 1000 * 0.8 + t * 613 % 200) / 1000.0
    return txn(spark, sf_dir).select(
        "transaction_id",
        "account_id",
        F.col("ts").alias("scored_at"),
        *columns,
        final.alias("final_committee_score"),
        live.alias("live_score"),
        action.alias("live_action"),
    )


SHADOW_SQL = (
    "SELECT transaction_id, account_id, ts AS scored_at, "
    + ", ".join(
        f"(transaction_id * {f} % 1009) / 1008.0::DOUBLE AS scorer_{n}_score, "
        f"abs((transaction_id * {f} % 1009) / 1008.0::DOUBLE - 0.5) * 2.0::DOUBLE AS scorer_{n}_confidence, "
        f"transaction_id % {i + 4} = 0 AS scorer_{n}_missing_flag"
        for i, (n, f) in enumerate(_SCORERS.items())
    )
    + """, (transaction_id * 7919 % 1000 * 0.8::DOUBLE + transaction_id * 613 % 200) / 1000.0::DOUBLE AS final_committee_score,
  live AS live_score,
  CASE WHEN live >= 0.83 THEN 'HIGH_RISK' WHEN live >= 0.62 THEN 'REVIEW'
    WHEN live >= 0.38 THEN 'LOG' ELSE 'PASS' END AS live_action
FROM (SELECT *, (transaction_id * 7919 % 1000) / 1000.0::DOUBLE AS live FROM txn)"""
)

_VIEWS: dict[str, tuple[Callable, str, list[str]]] = {
    "txn": (txn, TXN_SQL, []),
    "txnv": (txnv, TXNV_SQL, ["txn"]),
    "acct": (acct, ACCT_SQL, []),
    "edges": (edges, EDGES_SQL, ["txn"]),
    "scores": (scores, SCORES_SQL, ["txn"]),
    "alerts": (alerts, ALERTS_SQL, ["scores"]),
    "seeds": (seeds, SEEDS_SQL, ["alerts"]),
    "shadow": (shadow, SHADOW_SQL, ["txn"]),
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL text: the named views (and what they need) as CTEs, then ``body``.

    ``body`` is a SELECT, or ``name AS (...), ... SELECT ...`` when it starts
    with further CTEs (marked by a leading comma).
    """
    order: list[str] = []

    def need(name: str) -> None:
        for parent in _VIEWS[name][2]:
            need(parent)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    separator = "" if body.startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{separator}{body}"
