"""Committee, prototypes, curves, thresholds, bridges and training jobs."""

from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.vectors import top_contributions
from ledgerscope.operators import bridges as B
from ledgerscope.operators import committee as M
from ledgerscope.operators import explain as X
from ledgerscope.operators import models as L
from ledgerscope.operators import rules as O
from ledgerscope.operators.profile import set_features
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.catalog.profile import BANK_SQL, bank_rows, r
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()
_S = [s.lower() for s in C.SCORER_IDS]


# ── Committee ───────────────────────────────────────────────────────────────

_W = {s: C.SCORER_WEIGHTS[s.upper()] for s in _S}
_O = {s: C.SPECIALIST_THRESHOLDS[s.upper()] for s in _S}
COMMITTEE_SQL = (
    ", cw AS (SELECT *, "
    + " + ".join(f"CASE WHEN scorer_{s}_missing_flag THEN 0.0::DOUBLE ELSE {_W[s]} END" for s in _S)
    + " AS w, "
    + " + ".join(f"CASE WHEN scorer_{s}_missing_flag THEN 0.0::DOUBLE ELSE {_W[s]} * scorer_{s}_score END" for s in _S)
    + " AS ws, "
    + " OR ".join(f"(NOT scorer_{s}_missing_flag AND scorer_{s}_score >= {_O[s]})" for s in _S)
    + """ AS ovr FROM shadow), com AS (SELECT *, CASE WHEN w > 0 THEN ws / w ELSE 0.5 END AS fallback_score FROM cw)"""
)


@q(
    "m10_committee",
    with_views(
        "shadow",
        COMMITTEE_SQL
        + """ SELECT transaction_id, round(fallback_score, 9) AS fallback_score, ovr AS specialist_override,
        round(CASE WHEN ovr THEN 1.0 ELSE fallback_score END, 9) AS final_committee_score FROM com""",
    ),
)
def _(spark, d):
    rows = M.aggregate_committee(M.normalise_outputs(V.shadow(spark, d)).drop("final_committee_score"))
    rows = rows.select("transaction_id", "fallback_score", "specialist_override", "final_committee_score")
    return r(rows, "fallback_score", "final_committee_score", places=9)


@q(
    "m17_breakdown",
    with_views(
        "shadow",
        """SELECT transaction_id, round(scorer_a_score, 4) AS a_score, round(scorer_c_confidence, 4) AS c_confidence, scorer_d_missing_flag AS d_missing,
        round(final_committee_score, 4) AS final_score FROM shadow""",
    ),
)
def _(spark, d):
    rows = V.shadow(spark, d).withColumn("specialist_override", F.lit(False))
    b = M.committee_breakdown(rows)
    return b.select(
        "transaction_id",
        F.col("breakdown.scorers.A.score").alias("a_score"),
        F.col("breakdown.scorers.C.confidence").alias("c_confidence"),
        F.col("breakdown.scorers.D.missing").alias("d_missing"),
        F.col("breakdown.final_score").alias("final_score"),
    )


@q(
    "m18_proxy_labels",
    with_views("shadow", "SELECT transaction_id, CAST(CASE WHEN live_action IN ('REVIEW', 'HIGH_RISK') THEN 1 ELSE 0 END AS INTEGER) AS label FROM shadow"),
)
def _(spark, d):
    return M.proxy_labels(V.shadow(spark, d)).select("transaction_id", "label")


# ── Curves and thresholds ───────────────────────────────────────────────────

CURVE_SQL = """, pl AS (SELECT transaction_id, final_committee_score AS score, CASE WHEN live_action IN ('REVIEW', 'HIGH_RISK') THEN 1 ELSE 0 END AS label FROM shadow),
  pg AS (SELECT score AS threshold, sum(label) AS tp, count(*) AS n FROM pl GROUP BY score),
  pc AS MATERIALIZED (SELECT threshold, CAST(tp AS BIGINT) AS here, sum(tp) OVER w / sum(n) OVER w ::DOUBLE AS precision, sum(tp) OVER w / (SELECT sum(label) FROM pl)::DOUBLE AS recall,
    (SELECT sum(label) FROM pl) AS positives FROM pg WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


def labelled_scores(spark, d):
    return M.proxy_labels(V.shadow(spark, d)).select(
        "transaction_id", F.col("final_committee_score").alias("score"), "label"
    )


@q(
    "m14_pr_curve",
    with_views("shadow", CURVE_SQL + " SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pc"),
)
def _(spark, d):
    curve = M.pr_curve(labelled_scores(spark, d)).select("threshold", "precision", "recall")
    return r(curve, "precision", "recall", places=9)


@q(
    "m14_average_precision",
    with_views("shadow", CURVE_SQL + " SELECT round(sum(here / positives::DOUBLE * precision), 8) AS average_precision FROM pc"),
)
def _(spark, d):
    return r(M.average_precision(labelled_scores(spark, d)), "average_precision", places=8)


@q(
    "m12_thresholds_train",
    with_views(
        "shadow",
        CURVE_SQL
        + """, a AS (SELECT *, coalesce(round(max(CASE WHEN recall >= 0.95 THEN threshold END) OVER w, 4), 0.38::DOUBLE) AS lg FROM pc WINDOW w AS (ORDER BY threshold ROWS UNBOUNDED PRECEDING)),
        b AS (SELECT *, coalesce(round(max(CASE WHEN recall >= 0.8 AND precision >= 0.6 AND threshold > lg THEN threshold END) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING), 4), 0.62::DOUBLE) AS rv FROM a),
        st AS (SELECT min(threshold) AS t FROM b WHERE precision >= 0.9 AND threshold > rv)
        SELECT lg AS log, rv AS review, coalesce(round((SELECT t FROM st), 4), 0.83::DOUBLE) AS high_risk FROM b
        WHERE threshold = coalesce((SELECT t FROM st), (SELECT max(threshold) FROM b))""",
    ),
)
def _(spark, d):
    return M.thresholds_train(labelled_scores(spark, d))


@q(
    "m13_thresholds_committee",
    with_views(
        "shadow",
        CURVE_SQL
        + """, f AS (SELECT *, round(2 * precision * recall / (precision + recall), 12) AS f1 FROM pc WHERE precision + recall > 0),
        p AS (SELECT round((SELECT max(threshold) FROM pc WHERE recall >= 0.95), 4) AS lt, round((SELECT min(threshold) FROM f WHERE f1 = (SELECT max(f1) FROM f)), 4) AS rt,
          round((SELECT min(threshold) FROM pc WHERE precision >= 0.9), 4) AS ht)
        SELECT lt AS log_threshold, rt AS review_threshold, ht AS high_risk_threshold, abs(lt - 0.38::DOUBLE) > 0.05 AS log_moved FROM p""",
    ),
)
def _(spark, d):
    return M.thresholds_committee(labelled_scores(spark, d))


@q(
    "m15_conformal_interval",
    with_views(
        "shadow",
        CURVE_SQL
        + """, rs AS (SELECT abs(label - score) AS v, row_number() OVER (ORDER BY abs(label - score)) AS rk, count(*) OVER () AS n FROM pl),
        rad AS (SELECT max(v) AS q FROM rs WHERE rk = least(CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT), n))
        SELECT transaction_id, round(greatest(score - q, 0.0::DOUBLE), 9) AS mapie_lower, round(least(score + q, 1.0::DOUBLE), 9) AS mapie_upper FROM pl, rad""",
    ),
)
def _(spark, d):
    rows = labelled_scores(spark, d)
    out = M.conformal_interval(rows, M.conformal_radius(rows))
    return r(out.select("transaction_id", "mapie_lower", "mapie_upper"), "mapie_lower", "mapie_upper", places=9)


# Payments with an even id calibrate, those with an odd one are judged.
@q(
    "m15_class_conditional",
    with_views(
        "shadow",
        CURVE_SQL
        + """, cal AS (SELECT label, abs(label - score) AS v, row_number() OVER (PARTITION BY label ORDER BY abs(label - score)) AS rk, count(*) OVER (PARTITION BY label) AS n FROM pl WHERE transaction_id % 2 = 0),
        rad AS (SELECT label, max(v) FILTER (WHERE rk = CAST(ceil(round((n + 1) * 0.9::DOUBLE, 9)) AS BIGINT)) AS q FROM cal GROUP BY label)
        SELECT transaction_id, coalesce(abs(score - 0) <= (SELECT q FROM rad WHERE label = 0), TRUE) AS may_be_clean, coalesce(abs(score - 1) <= (SELECT q FROM rad WHERE label = 1), TRUE) AS may_be_fraud
        FROM pl WHERE transaction_id % 2 = 1""",
    ),
)
def _(spark, d):
    rows = labelled_scores(spark, d)
    radii = M.conformal_class_radii(rows.filter("transaction_id % 2 = 0"))
    judged = M.conformal_sets(rows.filter("transaction_id % 2 = 1"), radii)
    return judged.select("transaction_id", "may_be_clean", "may_be_fraud")


# ── Prototypes and remarks ──────────────────────────────────────────────────


def _vectors(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vault(spark, d):
    """The newest 512 vectors (the vault's size); labels under 3 count as fraud."""
    protos = _vectors(spark, d).select(
        F.col("id").alias("proto_id"),
        "vector",
        F.when(F.col("label") < 3, 1).otherwise(0).alias("label"),
        F.col("id").alias("inserted_at"),
    )
    return M.curate_prototypes(protos, protos.limit(0).withColumn("status", F.lit("")), 64)


_VAULT_SQL = """WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x, CAST(label < 3 AS INTEGER) AS label FROM embeddings),
  pr AS MATERIALIZED (SELECT * FROM v ORDER BY id DESC LIMIT 512),
  ds AS (SELECT v.id, pr.id AS proto_id, pr.label, list_sum(list_transform(list_zip(v.x, pr.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v, pr),
  nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, proto_id) AS rk FROM ds)"""


@q(
    "j11_nearest_prototypes",
    _VAULT_SQL + " SELECT id, proto_id, round(dist, 5) AS distance, label FROM nn WHERE rk <= 5",
)
def _(spark, d):
    return r(M.nearest_prototypes(_vectors(spark, d), _vault(spark, d)), "distance", places=5)


@q(
    "m6_prototype_scorer",
    _VAULT_SQL
    + """ SELECT id, round(sum(label / (1 + dist)) / sum(1 / (1 + dist)), 6) AS scorer_c_score, round(1 / (1 + avg(dist)), 6) AS scorer_c_confidence, FALSE AS scorer_c_missing_flag
    FROM nn WHERE rk <= 5 GROUP BY id""",
)
def _(spark, d):
    rows = M.scorer_c(_vectors(spark, d), _vault(spark, d), 64)
    return r(rows, "scorer_c_score", "scorer_c_confidence", places=6)


@q(
    "m9_centroids",
    """WITH p AS (SELECT label AS cluster, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    m AS (SELECT cluster, pos, avg(x) AS m FROM p GROUP BY ALL), l AS (SELECT cluster, sqrt(sum(m * m)) AS len FROM m GROUP BY cluster)
    SELECT m.cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m / len, 6) AS x FROM m JOIN l USING (cluster)""",
)
def _(spark, d):
    c = M.centroids(_vectors(spark, d).withColumnRenamed("label", "cluster"))
    return r(c.select("cluster", F.posexplode("centroid").alias("pos", "x")), "x", places=6)


@q(
    "m19_curate_prototypes",
    """WITH m AS (SELECT vec_id, vec_id AS ins FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE label >= 5 AND label <> 9)
    SELECT vec_id AS proto_id, ins AS inserted_at FROM m ORDER BY ins DESC LIMIT 300""",
)
def _(spark, d):
    v = _vectors(spark, d).select(
        F.col("id").alias("proto_id"), "vector", "label", F.col("id").alias("inserted_at")
    )
    stored = v.filter(F.col("label") < 5)
    waiting = v.filter(F.col("label") >= 5).withColumn(
        "status", F.when(F.col("label") == 9, "REJECTED").otherwise("PENDING_REVIEW")
    )
    waiting = waiting.withColumn("label", F.lit(1))
    return M.curate_prototypes(stored, waiting, 64, cap=300).select("proto_id", "inserted_at")


@q("m8_remark_scorer")
def _(spark, d):
    turns = V.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("remark"), "role"
    )
    vectors = L.text_vectors(turns, "remark", 64)
    clusters = M.centroids(vectors.withColumnRenamed("role", "cluster").select("cluster", "vector"))
    return M.scorer_f(vectors.select("id", "remark", "vector"), clusters)


# ── Bridges ─────────────────────────────────────────────────────────────────

_OPEN = """, op AS (SELECT c_custkey AS k, (c_custkey * 7 % 40)::DOUBLE AS v6, (c_custkey * 11 % 90)::DOUBLE AS v24, (c_custkey * 13 % 300)::DOUBLE AS v4, (c_custkey * 17 % 2500)::DOUBLE AS zp,
  (c_custkey * 3 % 60)::DOUBLE AS br, (c_custkey * 5 % 25)::DOUBLE AS dob, (c_custkey * 19 % 14)::DOUBLE AS dev, (CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 5 ELSE 0 END)::DOUBLE AS df,
  (c_custkey * 23 % 540 - 150)::DOUBLE AS cr, (c_custkey * 29 % 9900 + 50)::DOUBLE AS lim, (c_custkey % 10 / 10.0)::DOUBLE AS inc, (c_custkey * 31 % 20000 - 5000)::DOUBLE AS bal, c_custkey % 6 = 0 AS fr, c_custkey % 2 = 0 AS free,
  (c_custkey % 30)::DOUBLE AS sess, c_custkey % 14 - 1 AS prev, (c_custkey % 13)::DOUBLE AS bm FROM customer)"""


def openings(spark, d):
    """Applications derived from the customers."""
    k = F.col("c_custkey")
    mod = lambda m, n: (k * m % n).cast("double")
    return V.table(spark, d, "customer").select(
        k,
        mod(7, 40).alias("velocity_6h"),
        mod(11, 90).alias("velocity_24h"),
        mod(13, 300).alias("velocity_4w"),
        mod(17, 2500).alias("zip_count_4w"),
        mod(3, 60).alias("bank_branch_count_8w"),
        mod(5, 25).alias("date_of_birth_distinct_emails_4w"),
        mod(19, 14).alias("device_distinct_emails_8w"),
        F.when(k % 9 == 0, k % 5).otherwise(0).alias("device_fraud_count"),
        (mod(23, 540) - 150).alias("credit_risk_score"),
        (mod(29, 9900) + 50).alias("proposed_credit_limit"),
        (k % 10 / 10.0).alias("income"),
        (mod(31, 20000) - 5000).alias("intended_balcon_amount"),
        (k % 6 == 0).cast("int").alias("foreign_request"),
        (k % 2 == 0).cast("int").alias("email_is_free"),
        (k % 3 != 0).cast("int").alias("phone_home_valid"),
        F.lit(1).alias("phone_mobile_valid"),
        (k % 4 == 0).cast("int").alias("has_other_cards"),
        mod(1, 30).alias("session_length_in_minutes"),
        (k % 14 - 1).alias("prev_address_months_count"),
        (k % 13).alias("bank_months_count"),
        F.lit(6).alias("current_address_months_count"),
        F.lit("CD").alias("employment_status"),
        F.lit("BC").alias("housing_status"),
        F.when(k % 5 == 0, "TELEAPP").otherwise("INTERNET").alias("source"),
        (k % 12 + 1).alias("month"),
        (k % 8).alias("days_since_request"),
    )


@q(
    "p21_account_opening",
    "WITH x AS (SELECT 1)"
    + _OPEN
    + """, f AS (SELECT *, CASE WHEN zp = 0 THEN 1 ELSE zp END AS z, CASE WHEN br = 0 THEN 1 ELSE br END AS b, CASE WHEN cr = 0 THEN 500 ELSE cr END AS c, CASE WHEN inc = 0 THEN 0.5 ELSE inc END AS i,
      CASE WHEN sess = 0 THEN 10 ELSE sess END AS s, CASE WHEN prev = 0 THEN 12 ELSE prev END AS pv, CASE WHEN bm = 0 THEN 12 ELSE bm END AS bmo FROM op),
    g AS (SELECT *, least(greatest((c + 150) / 550, 0.0::DOUBLE), 1.0::DOUBLE) AS safe, (v6 / 6) / greatest(v4 / 672, 0.01::DOUBLE) AS rate FROM f),
    h AS (SELECT *, least(rate / 50, 1.0::DOUBLE) AS burst, least(df / greatest(df + 3, 1.0::DOUBLE) * 0.5 + (1 - safe) * 0.35 + CASE WHEN free THEN 0.15 ELSE 0 END, 1.0::DOUBLE) AS rnk,
      least(least(greatest((z - 1) / 1999, 0.0::DOUBLE), 1.0::DOUBLE) * 0.3 + least(dob / 20, 1.0::DOUBLE) * 0.4 + least(dev / 10, 1.0::DOUBLE) * 0.3, 1.0::DOUBLE) AS crowd,
      CASE WHEN bal > 0 THEN least(bal / (i * 50000 + 1) / 5, 1.0::DOUBLE) ELSE (1 - safe) * 0.4 END AS sink,
      0.85::DOUBLE * 0.4 + 0.6::DOUBLE * 0.3 + 0.15 + 0.1 + (1 - CASE WHEN free THEN 0.5 ELSE 0 END) * 0.05 AS kyc FROM g)
    SELECT k AS c_custkey, round(burst, 6) AS burst_score, round(rnk, 6) AS pagerank_fraud_seeded, round(crowd, 6) AS community_fraud_ratio, round(sink, 6) AS sink_score, round(kyc, 6) AS kyc_completeness_score,
      round(CASE WHEN df > 0 THEN 0.0 WHEN crowd > 0.6 THEN 1.0 WHEN rnk > 0.5 THEN 2.0 ELSE 2 + safe * 4 END, 6) AS shortest_path_to_fraud,
      round(least(CASE WHEN fr THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN pv IN (-1, 0, 1, 2) THEN 0.2::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS geography_switch,
      round(least(least(dob / 10, 1.0::DOUBLE) * 0.4 + least(dev / 10, 1.0::DOUBLE) * 0.3 + burst * 0.3, 1.0::DOUBLE), 6) AS bridge_node_probability,
      CASE WHEN s < 2 AND v6 >= 3 THEN 1.0::DOUBLE ELSE 0.0 END AS dormancy_break, bmo * 30 AS account_age_days, round(least(rate / 10, 30.0::DOUBLE), 6) AS velocity_ratio,
      round(least(sink * 0.7 + (1 - kyc) * 0.3, 1.0::DOUBLE), 6) AS cash_mule_sink_score, lim * 10 AS txn_amount, least(dev + z / 10, 50.0::DOUBLE) AS distinct_counterparties_30d FROM h""",
)
def _(spark, d):
    rows = B.bridge_account_opening(openings(spark, d), ["c_custkey"])
    rounded = [
        "burst_score", "pagerank_fraud_seeded", "community_fraud_ratio", "sink_score", "kyc_completeness_score",
        "shortest_path_to_fraud", "geography_switch", "bridge_node_probability", "velocity_ratio", "cash_mule_sink_score",
    ]
    return r(rows, *rounded, places=6).select(
        "c_custkey", *rounded, "dormancy_break", "account_age_days", "txn_amount", "distinct_counterparties_30d"
    )


def card_rows(spark, d):
    """Risk-scored payments derived from the orders."""
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k,
        (F.col("o_totalprice") / 20).alias("transaction_amount"),
        (k % 24).alias("transaction_time_hour"),
        (k * 7 % 3000).alias("account_age_days"),
        (k % 12 + 1).alias("login_attempts"),
        (k * 11 % 101).cast("double").alias("device_risk_score"),
        (k * 13 % 15000).cast("double").alias("geo_distance_km"),
        (k * 17 % 101).cast("double").alias("transaction_velocity_score"),
        (k * 19 % 100 / 100.0).alias("anomaly_score"),
        (k % 26).alias("failed_transactions_last_30d"),
        (k * 3 % 130 + 1).alias("daily_transaction_count"),
        (F.col("o_totalprice") / 10).alias("avg_monthly_balance"),
        (k % 40).alias("session_duration_minutes"),
        (k % 5 == 0).cast("int").alias("international_transaction_flag"),
        (k % 7 == 0).cast("int").alias("suspicious_ip_flag"),
        (k % 2).cast("int").alias("card_present_flag"),
        F.when(k % 4 == 0, "Mobile App").when(k % 4 == 1, "ATM").when(k % 4 == 2, "POS Terminal").otherwise("Web Banking").alias("payment_channel"),
        F.when(k % 3 == 0, "Biometric").when(k % 3 == 1, "Password Only").otherwise("OTP").alias("authentication_type"),
    )


@q(
    "p22_card_risk",
    """WITH k AS (SELECT o_orderkey, o_totalprice / 20 AS amt, o_orderkey % 24 AS hr, o_orderkey % 12 + 1 AS lg, (o_orderkey * 11 % 101)::DOUBLE AS rk, (o_orderkey * 13 % 15000)::DOUBLE AS km, (o_orderkey * 17 % 101)::DOUBLE AS sp,
      (o_orderkey * 19 % 100 / 100.0)::DOUBLE AS an, (o_orderkey * 3 % 130 + 1)::DOUBLE AS dc, o_totalprice / 10 AS bal, o_orderkey % 40 AS ss, (o_orderkey % 5 = 0)::INT AS ab, (o_orderkey % 7 = 0)::INT AS ip,
      CASE o_orderkey % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.6 ELSE 0.3 END AS au, o_orderkey FROM orders),
    g AS (SELECT *, least(ab * 0.6::DOUBLE + least(km / 15000, 1.0::DOUBLE) * 0.4, 1.0::DOUBLE) AS geo, least(sp / 100 * 0.6 + an * 0.4, 1.0::DOUBLE) AS burst, least(amt / (bal + 1), 1.0::DOUBLE) AS sink FROM k)
    SELECT o_orderkey, round(geo, 6) AS geography_switch, round(burst, 6) AS burst_score, round(sink, 6) AS sink_score, round(least(rk / 100 * 0.5 + ip * 0.3::DOUBLE + an * 0.2, 1.0::DOUBLE), 6) AS pagerank_fraud_seeded,
      round(greatest(5 - rk / 25, 0.0::DOUBLE), 6) AS shortest_path_to_fraud, round(least(greatest((lg - 1) / 11.0::DOUBLE * 0.5 + au * 0.5, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS channel_switch,
      CASE WHEN ss < 2 AND sp > 70 THEN 1.0::DOUBLE ELSE 0.0 END AS dormancy_break, CASE WHEN hr >= 22 OR hr < 5 THEN 0.5::DOUBLE ELSE 0.0 END AS night_txn_ratio,
      CASE WHEN o_orderkey % 4 IN (1, 2) THEN 1.0::DOUBLE ELSE 0.0 END AS channel_imps, least(dc, 120.0::DOUBLE) * 7 AS txn_count_last_7d, round(amt * least(dc / 24, 20.0::DOUBLE), 9) AS txn_volume_last_1h,
      round((o_orderkey % 2) * 0.4::DOUBLE + (1 - au) * 0.6, 6) AS kyc_completeness_score FROM g""",
)
def _(spark, d):
    rows = B.bridge_card_risk(card_rows(spark, d), ["o_orderkey"])
    rounded = [
        "geography_switch", "burst_score", "sink_score", "pagerank_fraud_seeded", "shortest_path_to_fraud",
        "channel_switch", "kyc_completeness_score",
    ]
    rows = r(rows, "txn_volume_last_1h", places=9)
    return r(rows, *rounded, places=6).select(
        "o_orderkey", *rounded, "txn_volume_last_1h", "dormancy_break", "night_txn_ratio", "channel_imps", "txn_count_last_7d"
    )


def bank_input(spark, d):
    t = F.col("transaction_id")
    return bank_rows(spark, d).select(
        "*",
        (t % 200).cast("double").alias("duration"),
        F.when(t % 3 == 0, "Doctor").when(t % 3 == 1, "Student").otherwise("Retired").alias("occupation"),
    ).withColumn(
        "channel",
        F.when(F.col("channel") == "ATM", "ATM").when(F.col("channel") == "UPI", "Online").otherwise("Branch"),
    )


@q(
    "p20_pseudo_labels",
    with_views(
        "txn",
        BANK_SQL
        + """ SELECT b.transaction_id, CAST(CASE WHEN b.login_attempts >= 3 OR (p.n_locations >= 3 AND b.login_attempts >= 2) OR (b.amount > p.avg_amount * 3 AND p.night_txn_ratio > 0.5)
          OR (p.channel_switch > 0.5 AND p.geography_switch > 0) THEN 1 ELSE 0 END AS INTEGER) AS label FROM bank b JOIN prof p USING (account_id)""",
    ),
)
def _(spark, d):
    return O.pseudo_labels(B.with_bank_profile(bank_input(spark, d))).select("transaction_id", "label")


@q(
    "p23_bank_transactions",
    with_views(
        "txn",
        BANK_SQL
        + """, g AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM bank)
        SELECT b.transaction_id, round(abs((b.amount - g.m) / g.s), 6) AS amount_zscore, round(p.sink_score * least(b.login_attempts / 5.0::DOUBLE, 1.0::DOUBLE), 6) AS cash_mule_sink_score,
          least(p.n_merchants / 10.0::DOUBLE, 1.0::DOUBLE) AS bipartite_score, CASE WHEN b.channel = 'UPI' THEN 1.0::DOUBLE ELSE 0.0 END AS channel_upi, CASE b.transaction_id % 3 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.7 ELSE 0.85 END AS kyc_completeness_score,
          greatest(p.txn_count_all * 10.0::DOUBLE, 1.0::DOUBLE) AS account_age_days, round(p.return_ratio, 6) AS return_ratio, round(abs(hour(b.ts) - 14.0::DOUBLE) / 10, 6) AS hour_deviation,
          CASE WHEN b.amount % 100 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS txn_amount_rounded, greatest(5.0::DOUBLE - b.login_attempts, 0.0::DOUBLE) AS shortest_path_to_fraud
        FROM bank b JOIN prof p USING (account_id), g""",
    ),
)
def _(spark, d):
    rows = B.bridge_bank_transactions(bank_input(spark, d), ["transaction_id"])
    rounded = ["amount_zscore", "cash_mule_sink_score", "return_ratio", "hour_deviation"]
    return r(rows, *rounded, places=6).select(
        "transaction_id", *rounded, "bipartite_score", "channel_upi", "kyc_completeness_score",
        "account_age_days", "txn_amount_rounded", "shortest_path_to_fraud",
    )


@q("p25_assembled_features")
def _(spark, d):
    rows = B.bridge_bank_transactions(bank_input(spark, d), ["transaction_id"])
    return O.assemble_features(rows, "V2", ["transaction_id"])


# ── Training jobs (rows only: model internals have no SQL form) ─────────────

_BRIDGED = ["burst_score", "pagerank_fraud_seeded", "sink_score", "geography_switch", "channel_switch", "amount_zscore"]


def _training(spark, d):
    rows = B.bridge_card_risk(card_rows(spark, d), ["o_orderkey"])
    risk = F.col("pagerank_fraud_seeded") + F.col("burst_score") * 0.5
    noise = F.pmod(F.xxhash64("o_orderkey"), F.lit(100)) / 250.0
    return rows.select("o_orderkey", *_BRIDGED).withColumn("label", F.when(risk + noise > 0.95, 1).otherwise(0))


@q("m1_split")
def _(spark, d):
    parts = L.split(_training(spark, d).select("o_orderkey", "label"), [0.6, 0.2, 0.2], "o_orderkey", stratify="label")
    out = None
    for name, part in zip(("train", "validation", "test"), parts):
        tagged = part.withColumn("part", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


def boosted(spark, d):
    rows = _training(spark, d)
    return rows, L.train_calibrated(rows, _BRIDGED, "o_orderkey", depth=4, rounds=10)


@q("m2_m4_boosted_scorer")
def _(spark, d):
    rows, model = boosted(spark, d)
    scored = L.scorer_a(rows, model)
    return scored.select("o_orderkey", "scorer_a_score", "scorer_a_confidence", "scorer_a_missing_flag")


@q("m5_embedding_scorer")
def _(spark, d):
    e = V.table(spark, d, "embeddings")
    emb = e.select(
        F.col("vec_id").alias("account_id"), F.slice("embedding", 1, 32).alias("embedding"), F.lit(False).alias("missing_flag"),
        F.when(F.col("label") < 3, 1).otherwise(0).alias("label"),
    )
    structural = e.select(
        F.col("vec_id").alias("account_id"),
        *[F.col("embedding")[32 + i].cast("double").alias(n) for i, n in enumerate(C.STRUCTURAL_FEATURES)],
    )
    rows = L.scorer_b_inputs(emb, structural).join(emb.select("account_id", "label"), "account_id")
    model = L.train_scorer_b(rows, rounds=30)
    return L.scorer_b(rows, model).select("account_id", "scorer_b_score", "scorer_b_confidence", "scorer_b_missing_flag")


@q("m7_set_scorer")
def _(spark, d):
    features = set_features(V.txnv(spark, d), as_of())
    labelled = features.withColumn(
        "label", F.when(F.coalesce("count_of_high_amount_txns", F.lit(0.0)) + F.coalesce("count_of_night_txns", F.lit(0.0)) > 0.55, 1).otherwise(0)
    )
    model = L.train_scorer_d(labelled, "account_id", trees=20, depth=5)
    return L.scorer_d(labelled, model).select("account_id", "scorer_d_score", "scorer_d_confidence", "scorer_d_missing_flag")


def _meta_rows(spark, d):
    accounts = V.acct(spark, d).select(F.col("id").alias("account_id"), "account_type", "kyc_age")
    rows = V.shadow(spark, d).join(accounts, "account_id", "left")
    rows = rows.withColumn("ts", F.col("scored_at")).withColumn("daily_txn_count", F.col("transaction_id") % 20)
    return M.proxy_labels(rows)


@q("m11_meta_learner")
def _(spark, d):
    _model, record = L.train_meta(_meta_rows(spark, d), "transaction_id", min_rows=100, rounds=8)
    return record


@q("m16_contributions")
def _(spark, d):
    rows = _training(spark, d)
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=_BRIDGED, outputCol="features"),
            LogisticRegression(labelCol="label", regParam=0.01),
        ]
    ).fit(rows)
    return M.top_n_contributions(L.linear_contributions(rows, model, _BRIDGED, "o_orderkey"), "o_orderkey", 3)


def explained(spark, d):
    """The boosted model's own contributions for every payment."""
    rows, model = boosted(spark, d)
    return X.tree_contributions(rows, model.base, _BRIDGED, "o_orderkey")


# Every row's contributions, and whether they add up to the model's own probability.
@q("m16_tree_contributions")
def _(spark, d):
    rows, model = boosted(spark, d)
    told = X.tree_contributions(rows, model.base, _BRIDGED, "o_orderkey")
    total = F.col("expected") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    scored = L.predict(model.base, rows, _BRIDGED, "p").select("o_orderkey", "p")
    return told.join(scored, "o_orderkey").select(
        "o_orderkey",
        "log_odds",
        top_contributions(F.col("contributions"), 3).alias("top"),
        (F.abs(1 / (1 + F.exp(-total)) - F.col("p")) < 1e-9).alias("adds_up"),
    )


@q(
    "o3_top_contributions",
    with_views(
        "shadow",
        """, c AS (SELECT transaction_id, u.* FROM shadow, LATERAL (VALUES ('a', scorer_a_score - 0.5), ('b', scorer_b_score - 0.5), ('c', scorer_c_score - 0.5), ('d', scorer_d_score - 0.5), ('f', scorer_f_score - 0.5)) u(feature, x)),
        k AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(x) DESC, feature) AS rn FROM c)
        SELECT transaction_id, string_agg(feature, ',' ORDER BY rn) AS top FROM k WHERE rn <= 3 GROUP BY transaction_id""",
    ),
)
def _(spark, d):
    parts = F.array(
        *[F.struct(F.lit(s).alias("feature"), (F.col(f"scorer_{s}_score") - 0.5).alias("contribution")) for s in _S]
    )
    top = top_contributions(parts, 3)
    return V.shadow(spark, d).select(
        "transaction_id", F.concat_ws(",", F.transform(top, lambda e: e["feature"])).alias("top")
    )
