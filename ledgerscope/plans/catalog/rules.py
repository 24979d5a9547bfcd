"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from ledgerscope.functions import rules as R
from ledgerscope.functions import text as X
from ledgerscope.functions import vectors as L
from ledgerscope.operators import rules as O
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.context import payment_context
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()

# Point-in-time context of every payment, as in plans.context.payment_context.
CONTEXT_SQL = """, pit AS (
  SELECT t.*, count(*) OVER h1 AS velocity_1h, count(*) OVER d1 AS velocity_24h,
    coalesce(sum(amount) OVER h1, 0.0::DOUBLE) AS volume_1h,
    coalesce(avg(amount) OVER d30, 0.0::DOUBLE) AS avg_amount_30d, count(*) OVER d1 AS daily_txn_count
  FROM txnv t
  WINDOW h1 AS (PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING),
    d1 AS (PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING),
    d30 AS (PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 2591999999999 PRECEDING AND 1 PRECEDING)),
ctx AS (
  SELECT p.*, f.first_ts < p.ts AS payee_in_known_contacts,
    CASE WHEN a.id IS NULL THEN 'SAVINGS' ELSE a.account_type END AS account_type, a.kyc_occupation, a.kyc_age,
    coalesce(a.account_age_days, 0) AS account_age_days, b.account_age_days AS payee_account_age_days,
    coalesce(g.n > 3, FALSE) AS has_festival_gifting_history,
    CAST(greatest(floor((epoch_us(p.ts) - epoch_us(p.payee_vpa_created_at)) / 86400000000.0), 0) AS BIGINT) AS payee_vpa_age_days,
    hour(p.ts) >= 23 OR hour(p.ts) < 5 AS night,
    month(p.ts) = 10 OR (month(p.ts) = 11 AND day(p.ts) <= 15) AS festival
  FROM pit p
  JOIN (SELECT account_id, payee_account_id, min(ts) AS first_ts FROM txn GROUP BY ALL) f USING (account_id, payee_account_id)
  LEFT JOIN acct a ON p.account_id = a.id LEFT JOIN acct b ON p.payee_account_id = b.id
  LEFT JOIN (SELECT account_id, count(*) AS n FROM txn WHERE amount < 5000 AND month(ts) IN (10, 11)
    AND ts < TIMESTAMP '2023-01-31 00:00:00' GROUP BY account_id) g ON p.account_id = g.account_id),
tier1 AS (
  SELECT *, CASE WHEN flags <> '' THEN 'SUSPICIOUS'
      WHEN account_age_days > 365 AND avg_amount_30d > 0 AND amount < avg_amount_30d * 2
        AND payee_in_known_contacts AND NOT night AND velocity_24h < 10 THEN 'FAST_CLEAN'
      ELSE 'UNCERTAIN' END AS tier1_result
  FROM (SELECT *, concat_ws(',', CASE WHEN payee_vpa_age_days < 7 THEN 'new_vpa' END,
      CASE WHEN night THEN 'night' END,
      CASE WHEN velocity_1h > 5 AND NOT coalesce(lower(kyc_occupation) IN ('gig_worker','freelancer','delivery','merchant','retailer'), FALSE) THEN 'velocity_spike' END,
      CASE WHEN (amount >= 49000 AND amount < 50000) OR (amount >= 99000 AND amount < 100000)
        OR (amount >= 990000 AND amount < 1000000) THEN 'threshold_proximity' END,
      CASE WHEN payee_account_age_days < 14 THEN 'new_payee_account' END,
      CASE WHEN avg_amount_30d > 0 AND amount > avg_amount_30d * 5 THEN 'amount_spike' END) AS flags FROM ctx))"""


def context(spark, d):
    return payment_context(V.txnv(spark, d), V.acct(spark, d), as_of())


def tier1(spark, d):
    """The flagship query: point-in-time context, flags and class of every payment."""
    rows = O.tier1_classify(context(spark, d))
    return rows.select(
        "transaction_id",
        "account_id",
        "velocity_1h",
        "velocity_24h",
        F.round("avg_amount_30d", 6).alias("avg_amount_30d"),
        F.concat_ws(",", "tier1_flags").alias("flags"),
        "tier1_result",
    )


TIER1_SQL = with_views(
    "txnv acct",
    CONTEXT_SQL
    + """ SELECT transaction_id, account_id, velocity_1h, velocity_24h,
    round(avg_amount_30d, 6) AS avg_amount_30d, flags, tier1_result FROM tier1""",
)


@q(
    "p1_p2_threshold_bands",
    with_views(
        "txn",
        """SELECT transaction_id,
        (amount >= 49000 AND amount < 50000) OR (amount >= 99000 AND amount < 100000) OR (amount >= 990000 AND amount < 1000000) AS in_band,
        (amount >= 47500 AND amount < 50000) OR (amount >= 95000 AND amount < 100000) OR (amount >= 950000 AND amount < 1000000) AS near_limit
        FROM txn""",
    ),
)
def _(spark, d):
    amount = F.col("amount")
    return V.txn(spark, d).select(
        "transaction_id",
        R.near_threshold_band(amount).alias("in_band"),
        R.near_threshold_pct(amount).alias("near_limit"),
    )


@q(
    "p3_p4_calendar",
    """SELECT o_orderkey, hour(ts) >= 23 OR hour(ts) < 5 AS night_rule, hour(ts) >= 22 OR hour(ts) < 6 AS night_set,
      month(ts) = 10 OR (month(ts) = 11 AND day(ts) <= 15) AS festival
    FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS ts FROM orders)""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").withColumn(
        "ts",
        F.col("o_orderdate")
        + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int")),
    )
    return o.select(
        "o_orderkey",
        R.is_night(F.col("ts")).alias("night_rule"),
        R.is_night(F.col("ts"), 22, 6).alias("night_set"),
        R.is_festival(F.col("ts")).alias("festival"),
    )


@q("p5_p6_tier1", TIER1_SQL)
def _(spark, d):
    return tier1(spark, d)


@q(
    "p7_archetypes",
    with_views(
        "txnv acct",
        CONTEXT_SQL
        + """, v AS (SELECT *, velocity_24h * 4 AS vel, coalesce(lower(kyc_occupation) IN ('gig_worker','freelancer','delivery','merchant','retailer'), FALSE) AS freq FROM tier1)
        SELECT transaction_id, concat_ws(',',
          CASE WHEN ((amount >= 49000 AND amount < 50000) OR (amount >= 99000 AND amount < 100000) OR (amount >= 990000 AND amount < 1000000)) AND vel > 8 AND NOT freq THEN 'hawala' END,
          CASE WHEN amount >= 10000 AND amount % 10000 = 0 AND payee_account_age_days < 7 AND vel > 5 THEN 'crypto_on_ramp' END,
          CASE WHEN account_age_days > 365 AND vel > 15 AND NOT freq THEN 'benami' END) AS archetypes FROM v""",
    ),
)
def _(spark, d):
    # Velocities in the test tables are low; the multiple lets every label occur.
    rows = context(spark, d).withColumn("velocity_24h", F.col("velocity_24h") * 4)
    return O.archetype_labels(rows).select(
        "transaction_id", F.concat_ws(",", "archetypes").alias("archetypes")
    )


@q(
    "p8_txn_features",
    with_views(
        "txn",
        """SELECT transaction_id, amount AS txn_amount, round(ln(1 + amount), 6) AS txn_amount_log,
        CASE WHEN amount % 1000 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS txn_amount_rounded,
        CASE WHEN channel = 'UPI' THEN 1.0::DOUBLE ELSE 0.0 END AS channel_upi,
        CASE WHEN channel = 'IMPS' THEN 1.0::DOUBLE ELSE 0.0 END AS channel_imps,
        CASE WHEN channel = 'RTGS' THEN 1.0::DOUBLE ELSE 0.0 END AS channel_rtgs,
        CASE WHEN channel = 'NEFT' THEN 1.0::DOUBLE ELSE 0.0 END AS channel_neft,
        CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
        CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0 END AS is_weekend,
        CASE WHEN hour(ts) >= 23 OR hour(ts) < 5 THEN 1.0::DOUBLE ELSE 0.0 END AS is_night,
        CASE WHEN month(ts) = 10 OR (month(ts) = 11 AND day(ts) <= 15) THEN 1.0::DOUBLE ELSE 0.0 END AS is_festival_period,
        amount / 50000 AS amount_vs_threshold_50000, amount / 100000 AS amount_vs_threshold_100000,
        amount / 1000000 AS amount_vs_threshold_1000000 FROM txn""",
    ),
)
def _(spark, d):
    names = list(O.txn_feature_columns())
    return (
        O.txn_features(V.txn(spark, d))
        .select("transaction_id", *names)
        .withColumn("txn_amount_log", F.round("txn_amount_log", 6))
    )


@q(
    "p9_p10_vpa_age",
    with_views(
        "txnv",
        """SELECT transaction_id, CAST(greatest(floor((epoch_us(ts) - epoch_us(payee_vpa_created_at)) / 86400000000.0), 0) AS BIGINT) AS payee_vpa_age_days,
        CASE WHEN amount / 10000 < 2 AND floor((epoch_us(ts) - epoch_us(payee_vpa_created_at)) / 86400000000.0) < 7 THEN 1.0::DOUBLE ELSE 0.0 END AS micro_test_payment
        FROM txnv""",
    ),
)
def _(spark, d):
    age = R.vpa_age_days(F.col("ts"), F.col("payee_vpa_created_at"))
    return V.txnv(spark, d).select(
        "transaction_id",
        age.alias("payee_vpa_age_days"),
        R.micro_test_payment(F.col("amount") / 10_000, age).alias("micro_test_payment"),
    )


# Context adjustment over shifted dates so festival, staleness and age factors all occur.
_ADJUST_SQL = """, x AS (
  SELECT *, ts + INTERVAL 270 DAY AS ts2, (transaction_id * 7919 % 1000) / 1000.0::DOUBLE AS raw_score,
    account_id % 2 = 0 AS gifts, (transaction_id % 60)::DOUBLE AS stale, daily_txn_count * 4 AS daily FROM ctx),
 f AS (SELECT *, month(ts2) = 10 OR (month(ts2) = 11 AND day(ts2) <= 15) AS fest,
    hour(ts2) >= 23 OR hour(ts2) < 5 AS night2, hour(ts2) AS hr FROM x),
 g AS (SELECT *,
    CASE WHEN fest AND amount < 5000 AND gifts AND payee_vpa_age_days < 30 THEN 0.7::DOUBLE END AS f1,
    CASE WHEN fest AND amount BETWEEN 5000 AND 50000 AND gifts AND payee_vpa_age_days > 7 THEN 0.9::DOUBLE END AS f2,
    CASE WHEN daily > 10 AND channel = 'UPI' AND lower(kyc_occupation) IN ('gig_worker','freelancer','delivery') AND hr BETWEEN 11 AND 23 THEN 0.85::DOUBLE END AS f3,
    CASE WHEN account_type = 'JAN_DHAN' THEN 0.75::DOUBLE END AS f4,
    CASE WHEN lower(kyc_occupation) IN ('merchant','retailer','shopkeeper') AND amount % 100 = 0 AND hr BETWEEN 18 AND 23 THEN 0.8::DOUBLE END AS f5,
    CASE WHEN kyc_age > 60 AND night2 THEN 1.5::DOUBLE END AS f6,
    CASE WHEN kyc_age > 60 AND payee_vpa_age_days < 7 THEN 1.3::DOUBLE END AS f7,
    CASE WHEN stale > 26 THEN 1.0::DOUBLE - least(stale - 26, 72.0::DOUBLE) / 72 * 0.3::DOUBLE END AS keep FROM f),
 h AS (SELECT *, raw_score * coalesce(f1,1) * coalesce(f2,1) * coalesce(f3,1) * coalesce(f4,1) * coalesce(f5,1) * coalesce(f6,1) * coalesce(f7,1) AS p FROM g),
 adj AS (SELECT *, least(CASE WHEN keep IS NOT NULL THEN p * keep + 0.5 * (1 - keep) ELSE p END, 1.0::DOUBLE) AS adjusted_score FROM h)"""


def _adjusted(spark, d):
    day = F.expr("INTERVAL 270 DAYS")
    t = F.col("transaction_id")
    rows = context(spark, d).select(
        "*",
        ((t * 7919 % 1000) / 1000.0).alias("raw_score"),
        (t % 60).cast("double").alias("graph_staleness_hours"),
    )
    rows = rows.withColumn("ts", F.col("ts") + day)
    rows = rows.withColumn("has_festival_gifting_history", F.col("account_id") % 2 == 0)
    rows = rows.withColumn("daily_txn_count", F.col("daily_txn_count") * 4)
    return O.apply_context(rows)


@q(
    "p11_context_adjustment",
    with_views(
        "txnv acct",
        CONTEXT_SQL
        + _ADJUST_SQL
        + """ SELECT transaction_id, round(adjusted_score, 12) AS adjusted_score,
          concat_ws(',', CASE WHEN f1 IS NOT NULL THEN 'festival_small_gift' END, CASE WHEN f2 IS NOT NULL THEN 'festival_medium_gift' END,
          CASE WHEN f3 IS NOT NULL THEN 'gig_worker_velocity' END, CASE WHEN f4 IS NOT NULL THEN 'jan_dhan_cash_pattern' END,
          CASE WHEN f5 IS NOT NULL THEN 'merchant_batch_settlement' END, CASE WHEN f6 IS NOT NULL THEN 'senior_night_amplification' END,
          CASE WHEN f7 IS NOT NULL THEN 'senior_new_vpa_amplification' END, CASE WHEN keep IS NOT NULL THEN 'graph_staleness_penalty' END) AS applied
          FROM adj""",
    ),
)
def _(spark, d):
    return _adjusted(spark, d).select(
        "transaction_id",
        F.round("adjusted_score", 12).alias("adjusted_score"),
        F.concat_ws(",", F.map_keys("adjustments")).alias("applied"),
    )


@q(
    "p12_staleness",
    with_views(
        "txn",
        """SELECT account_id, round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE, 6) AS graph_staleness_hours
        FROM txn GROUP BY account_id""",
    ),
)
def _(spark, d):
    last = V.txn(spark, d).groupBy("account_id").agg(F.max("ts").alias("last_updated"))
    return last.select(
        "account_id",
        F.round(R.staleness_hours(as_of(), F.col("last_updated")), 6).alias("graph_staleness_hours"),
    )


@q(
    "p13_action",
    with_views(
        "txnv acct",
        CONTEXT_SQL
        + _ADJUST_SQL
        + """ SELECT transaction_id, CASE WHEN round(adjusted_score, 12) >= 0.83 THEN 'HIGH_RISK' WHEN round(adjusted_score, 12) >= 0.62 THEN 'REVIEW'
          WHEN round(adjusted_score, 12) >= 0.38 THEN 'LOG' ELSE 'PASS' END AS action FROM adj""",
    ),
)
def _(spark, d):
    return _adjusted(spark, d).select(
        "transaction_id", R.score_to_action(F.round("adjusted_score", 12)).alias("action")
    )


@q("p14_jitter")
def _(spark, d):
    return V.scores(spark, d).select(
        "transaction_id",
        "score",
        R.jitter(F.col("score"), F.col("transaction_id")).alias("jittered"),
    )


@q(
    "p15_canary",
    with_views(
        "scores acct",
        """SELECT s.transaction_id, c.id IS NOT NULL AS is_canary,
        CASE WHEN c.id IS NOT NULL THEN 0.5::DOUBLE ELSE s.score END AS score,
        CASE WHEN c.id IS NOT NULL THEN 'LOG' ELSE s.action END AS action
        FROM scores s LEFT JOIN (SELECT id FROM acct WHERE account_age_days < 100) c ON s.account_id = c.id""",
    ),
)
def _(spark, d):
    canaries = V.acct(spark, d).filter(F.col("account_age_days") < 100)
    canaries = canaries.select(F.col("id").alias("account_id"))
    return O.canary_override(V.scores(spark, d), canaries).select(
        "transaction_id", "is_canary", "score", "action"
    )


@q(
    "p16_heuristic_score",
    with_views(
        "txnv acct",
        CONTEXT_SQL
        + """ SELECT transaction_id, round(least(CASE WHEN payee_vpa_age_days < 7 THEN 0.25::DOUBLE ELSE 0 END
          + CASE WHEN night THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN velocity_24h > 5 THEN 0.2::DOUBLE ELSE 0 END
          + coalesce(CASE WHEN account_id % 5 <> 0 THEN account_id % 7 / 7.0::DOUBLE END * 0.3, 0)
          + CASE WHEN account_id % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS score FROM ctx""",
    ),
)
def _(spark, d):
    a = F.col("account_id")
    rows = context(spark, d).select(
        "transaction_id",
        "payee_vpa_age_days",
        F.when(R.is_night(F.col("ts")), 1.0).otherwise(0.0).alias("is_night"),
        F.col("velocity_24h").alias("txn_count_last_1h"),
        F.when(a % 5 != 0, a % 7 / 7.0).alias("pagerank_fraud_seeded"),
        F.when(a % 3 == 0, 1.0).otherwise(0.0).alias("cycle_membership"),
    )
    return rows.select("transaction_id", F.round(O.heuristic_score(), 6).alias("score"))


_SESSION_NULL = [2, 3, 5, 7, 11, 13, 17, 19]


@q(
    "p17_session_missing",
    with_views(
        "txn",
        "SELECT transaction_id, "
        + " + ".join(f"(transaction_id % {m} = 0)::INT" for m in _SESSION_NULL)
        + " > 1 AS missing_flag FROM txn",
    ),
)
def _(spark, d):
    from ledgerscope.constants import SESSION_FEATURES

    t = F.col("transaction_id")
    rows = V.txn(spark, d).select(
        "transaction_id",
        *[F.when(t % m != 0, 1.0).alias(n) for n, m in zip(SESSION_FEATURES, _SESSION_NULL)],
    )
    return rows.select("transaction_id", O.session_missing_flag().alias("missing_flag"))


@q(
    "p18_large_value",
    with_views(
        "scores",
        """SELECT transaction_id, amount * 10 AS amount, action = 'HIGH_RISK' AS escalate
        FROM scores WHERE amount * 10 >= 1000000""",
    ),
)
def _(spark, d):
    rows = V.scores(spark, d).withColumn("amount", F.col("amount") * 10)
    held = O.hold_candidates(rows).select("transaction_id", "amount")
    escalated = O.large_value_escalation(rows).select("transaction_id", F.lit(True).alias("escalate"))
    joined = held.join(escalated, "transaction_id", "left")
    return joined.withColumn("escalate", F.coalesce("escalate", F.lit(False)))


@q(
    "p24_context_vector",
    with_views(
        "txnv acct",
        CONTEXT_SQL
        + """ SELECT transaction_id,
          CASE upper(account_type) WHEN 'SAVINGS' THEN 0.0::DOUBLE WHEN 'CURRENT' THEN 0.33 WHEN 'SALARY' THEN 0.67 WHEN 'NRI' THEN 1.0 ELSE 0.0 END AS account_type_code,
          least(coalesce(kyc_age, 0) / 80.0::DOUBLE, 1.0) AS kyc_age_norm,
          CASE WHEN festival THEN 1.0::DOUBLE ELSE 0.0 END AS ctx_festival, CASE WHEN night THEN 1.0::DOUBLE ELSE 0.0 END AS ctx_night,
          least(daily_txn_count / 50.0::DOUBLE, 1.0) AS daily_count_norm FROM ctx""",
    ),
)
def _(spark, d):
    names = list(O.context_vector_columns())
    return O.context_vector(context(spark, d)).select("transaction_id", *names)


# ── Scalar functions ────────────────────────────────────────────────────────


@q(
    "f1_pseudonym_salted",
    with_views("txn", "SELECT DISTINCT account_id, substr(sha256('pepper' || account_id), 1, 12) AS pseudonym FROM txn"),
)
def _(spark, d):
    accounts = V.txn(spark, d).select("account_id").distinct()
    return accounts.withColumn("pseudonym", X.pseudonymize(F.col("account_id"), salt="pepper"))


@q("f1_pseudonym_keyed")
def _(spark, d):
    accounts = V.txn(spark, d).select("account_id").distinct()
    return accounts.withColumn("pseudonym", X.pseudonymize(F.col("account_id"), key="k" * 32))


# A map of twelve features with few distinct values, so fingerprints repeat.
_MAP_NAMES = [f"feature_{i:02d}" for i in range(12)]


def feature_map(account):
    pairs = []
    for i, name in enumerate(_MAP_NAMES):
        pairs += [F.lit(name), (account * (i + 3) % 17 - 8) / 4.0]
    return F.create_map(*pairs)


FINGERPRINT_SQL = """, fmap AS (
  SELECT account_id, name, v FROM (SELECT DISTINCT account_id FROM txn) a, (VALUES {rows}) n(name, i),
    LATERAL (SELECT (account_id * (i + 3) % 17 - 8) / 4.0::DOUBLE AS v)),
franked AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(v) DESC, name) AS rk FROM fmap),
fp AS (SELECT account_id, sha256(string_agg(name || ':' || regexp_replace(printf('%.2f', v), '0$', ''), '|' ORDER BY rk)) AS fingerprint
  FROM franked WHERE rk <= 10 GROUP BY account_id)""".format(
    rows=", ".join(f"('{n}', {i})" for i, n in enumerate(_MAP_NAMES))
)


@q("f2_fingerprint", with_views("txn", FINGERPRINT_SQL + " SELECT account_id, fingerprint FROM fp"))
def _(spark, d):
    accounts = V.txn(spark, d).select("account_id").distinct()
    return accounts.select(
        "account_id", X.fingerprint(feature_map(F.col("account_id"))).alias("fingerprint")
    )


@q(
    "o4_top_features",
    with_views(
        "txn",
        FINGERPRINT_SQL
        + " SELECT account_id, string_agg(name, ',' ORDER BY rk) AS top_names FROM franked WHERE rk <= 10 GROUP BY account_id",
    ),
)
def _(spark, d):
    accounts = V.txn(spark, d).select("account_id").distinct()
    top = L.top_features(feature_map(F.col("account_id")))
    return accounts.select(
        "account_id", F.concat_ws(",", F.transform(top, lambda e: e["key"])).alias("top_names")
    )


@q(
    "f3_canonical_hash",
    with_views(
        "alerts",
        """SELECT alert_id, sha256('{"action":"' || action || '","alert_id":"' || alert_id || '","gate":' ||
          coalesce('"' || gate || '"', 'null') || ',"transaction_id":' || transaction_id || '}') AS digest FROM alerts""",
    ),
)
def _(spark, d):
    return V.alerts(spark, d).select(
        "alert_id", X.canonical_hash("transaction_id", "alert_id", "action", "gate").alias("digest")
    )


@q(
    "f4_report_hash",
    with_views(
        "alerts",
        "SELECT a.alert_id, sha256(a.alert_id || '|' || a.transaction_id || '|' || printf('%.2f', s.amount)) AS digest FROM alerts a JOIN scores s USING (transaction_id)",
    ),
)
def _(spark, d):
    a = V.alerts(spark, d).select("alert_id", "transaction_id")
    joined = a.join(V.scores(spark, d).select("transaction_id", "amount"), "transaction_id")
    return joined.select(
        "alert_id",
        X.report_hash(F.col("alert_id"), F.col("transaction_id"), F.col("amount")).alias("digest"),
    )


@q(
    "f5_clamp_normalize",
    with_views(
        "txn",
        """SELECT transaction_id, least(greatest(amount / 50000 - 1, 0.0::DOUBLE), 1.0::DOUBLE) AS clamped,
        least(greatest((amount - 1000) / 99000, 0.0::DOUBLE), 1.0::DOUBLE) AS normalized FROM txn""",
    ),
)
def _(spark, d):
    amount = F.col("amount")
    return V.txn(spark, d).select(
        "transaction_id",
        R.clamp(amount / 50_000 - 1).alias("clamped"),
        R.normalize(amount, 1_000, 100_000).alias("normalized"),
    )


@q(
    "f6_f7_vector_distance",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine,
      round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 5) AS squared_l2
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, d):
    e = V.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(nxt, "vec_id").select(
        "vec_id",
        F.round(L.cosine(a, b), 5).alias("cosine"),
        F.round(L.squared_l2(a, b), 5).alias("squared_l2"),
    )


@q(
    "f8_leading_digit",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
      CAST(regexp_extract(CAST(CAST(l_extendedprice / 1000000 AS DECIMAL(38,10)) AS VARCHAR), '[1-9]') AS INTEGER) AS digit FROM lineitem""",
)
def _(spark, d):
    return V.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        R.leading_digit(F.col("l_extendedprice") / 1_000_000).alias("digit"),
    )


@q(
    "f9_nan_to_null",
    with_views(
        "txn",
        """SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 OR transaction_id % 5 = 0 THEN NULL ELSE amount END AS value FROM txn""",
    ),
)
def _(spark, d):
    t = F.col("transaction_id")
    value = (
        F.when(t % 3 == 0, F.lit(float("nan")))
        .when(t % 5 == 0, F.lit(float("inf")))
        .otherwise(F.col("amount"))
    )
    return V.txn(spark, d).select("transaction_id", L.nan_to_null(value).alias("value"))


@q(
    "f10_clean_text",
    "SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f\\x{80}-\\x{9f}]', '', 'g'), 1, 500) AS cleaned FROM documents".replace(
        "\\x{80}", "\\x{9b}"
    ),
)
def _(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", X.clean_text(F.col("text")).alias("cleaned")
    )


@q(
    "f11_confidence",
    with_views("scores", "SELECT transaction_id, round(abs(score - 0.5) * 2, 6) AS confidence FROM scores"),
)
def _(spark, d):
    return V.scores(spark, d).select(
        "transaction_id", F.round(R.signal_confidence(F.col("score")), 6).alias("confidence")
    )


@q(
    "f12_narrative",
    with_views(
        "alerts",
        """SELECT alert_id, 'System fraud score: ' || printf('%.2f', score * 100) || '%.' ||
        CASE gate WHEN 'bipartite_core' THEN ' Account sits at the center of a many-to-one aggregation network consistent with mule coordination.'
          WHEN 'confirmed_cycle' THEN ' A confirmed circular fund transfer cycle was detected.' ELSE '' END ||
        ' Top contributing factors: sink_score, burst_score, night.' || ' Recommend STR filing under PMLA Section 12 within 7 days.' AS narrative
        FROM alerts""",
    ),
)
def _(spark, d):
    names = F.array(F.lit("sink_score"), F.lit("burst_score"), F.lit("night"), F.lit("amount"))
    return V.alerts(spark, d).select(
        "alert_id", X.narrative(F.col("gate"), names, F.col("score")).alias("narrative")
    )
