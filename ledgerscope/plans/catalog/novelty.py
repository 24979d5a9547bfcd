"""Novelty discovery, drift and review of the queue."""

from pyspark.sql import functions as F

from ledgerscope.operators import context as X
from ledgerscope.operators import novelty as N
from ledgerscope.operators import profile as P
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.catalog.profile import BANK_SQL, bank_rows, r
from ledgerscope.plans.catalog.rules import FINGERPRINT_SQL, feature_map
from ledgerscope.sources import views as V
from ledgerscope.sources.views import with_views

QUERIES = q = Registry()

_COLUMNS = ["night_txn_ratio", "weekend_txn_ratio", "return_ratio", "counterparty_novelty", "sink_score", "avg_amount"]


def account_rows(spark, d):
    return P.account_profile(bank_rows(spark, d)).select("account_id", *_COLUMNS)


@q("n1_pass_stream", with_views("scores", "SELECT transaction_id, score FROM scores WHERE score < 0.38"))
def _(spark, d):
    return N.pass_stream(V.scores(spark, d)).select("transaction_id", "score")


@q("n2_isolation_forest")
def _(spark, d):
    scaled = N.standardise(account_rows(spark, d), _COLUMNS)
    return N.train_isolation_forest(scaled, _COLUMNS, "account_id", trees=50)


@q("n3_isolation_scores")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("row_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = N.standardise(rows, columns)
    forest = N.train_isolation_forest(scaled, columns, "row_id", trees=50)
    return N.score_isolation(scaled, columns, forest, threshold=-0.05).select("row_id", "anomaly_score", "is_novel")


_ECDF_SQL = (
    BANK_SQL
    + ", lf AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT account_id, '{c}' AS feature, round({c}, 6) AS value FROM prof" for c in _COLUMNS)
    + """), ec AS (SELECT feature, value, count(*) AS n FROM lf GROUP BY ALL),
    ed AS (SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value) / sum(n) OVER (PARTITION BY feature)::DOUBLE AS left_tail,
      sum(n) OVER (PARTITION BY feature ORDER BY value DESC) / sum(n) OVER (PARTITION BY feature)::DOUBLE AS right_tail FROM ec)"""
)


def _rounded_rows(spark, d):
    return r(account_rows(spark, d), *_COLUMNS, places=6)


@q(
    "w8_ecdf",
    with_views("txn", _ECDF_SQL + " SELECT feature, value, round(left_tail, 9) AS left_tail, round(right_tail, 9) AS right_tail FROM ed"),
)
def _(spark, d):
    return r(N.ecdf(_rounded_rows(spark, d), "account_id", _COLUMNS), "left_tail", "right_tail", places=9)


@q(
    "n4_ecod",
    with_views(
        "txn",
        _ECDF_SQL
        + """, ms AS (SELECT feature, avg(value) AS m FROM lf GROUP BY feature), sk AS (SELECT feature, sum((value - m) ** 3) AS s FROM lf JOIN ms USING (feature) GROUP BY feature),
        es AS (SELECT lf.account_id, greatest(sum(-ln(left_tail)), sum(-ln(right_tail)), sum(-ln(CASE WHEN sk.s < 0 THEN left_tail ELSE right_tail END))) AS sc
          FROM lf JOIN ed ON lf.feature = ed.feature AND lf.value = ed.value JOIN sk ON lf.feature = sk.feature GROUP BY lf.account_id)
        SELECT account_id, round(sc, 6) AS ecod_score, sc > (SELECT quantile_cont(sc, 0.97) FROM es) AS is_outlier FROM es""",
    ),
)
def _(spark, d):
    return r(N.ecod(_rounded_rows(spark, d), "account_id", _COLUMNS), "ecod_score", places=6)


@q("n5_boosted_outlier")
def _(spark, d):
    rows = account_rows(spark, d).withColumn(
        "label", F.when(F.col("sink_score") + F.col("night_txn_ratio") > 1.2, 1).otherwise(0)
    )
    return N.boosted_outlier(rows, "account_id", _COLUMNS, trees=30, rounds=5)


DISCOVERY_SQL = (
    FINGERPRINT_SQL
    + """, nv AS (SELECT s.transaction_id, s.account_id, s.score, s.action, s.gate_fired, s.scored_at AS ts, -0.2 - s.score / 10 AS anomaly_score, fp.fingerprint
    FROM scores s JOIN fp USING (account_id) WHERE s.score < 0.38),
  ng AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts, transaction_id)) < 604800000000 THEN 0 ELSE 1 END AS nw FROM nv),
  nr AS (SELECT *, sum(nw) OVER (PARTITION BY fingerprint ORDER BY ts, transaction_id) AS run FROM ng),
  nc AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, run ORDER BY ts, transaction_id) AS occ FROM nr),
  reg AS (SELECT fingerprint FROM fp WHERE account_id % 17 = 4),
  queue AS (SELECT * FROM nc WHERE fingerprint NOT IN (SELECT fingerprint FROM reg))"""
)


def novel_rows(spark, d):
    return V.scores(spark, d).select(
        "transaction_id",
        "account_id",
        "score",
        "action",
        "gate_fired",
        F.col("scored_at").alias("ts"),
        (-0.2 - F.col("score") / 10).alias("anomaly_score"),
        feature_map(F.col("account_id")).alias("features"),
    )


def benign_registry(spark, d):
    from ledgerscope.functions.text import fingerprint

    accounts = V.txn(spark, d).select("account_id").distinct().filter(F.col("account_id") % 17 == 4)
    return accounts.select(fingerprint(feature_map(F.col("account_id"))).alias("fingerprint"), F.lit(0).alias("label"))


@q(
    "n6_route_discovery",
    with_views(
        "scores",
        DISCOVERY_SQL
        + """ SELECT transaction_id, account_id, round(anomaly_score, 6) AS anomaly_score, fingerprint AS novelty_fingerprint, substr(fingerprint, 1, 16) AS fingerprint_prefix,
        occ AS fingerprint_occurrences, occ >= 10 AS requires_escalation FROM queue""",
    ),
)
def _(spark, d):
    rows = N.route_discovery(novel_rows(spark, d), benign_registry(spark, d))
    return r(rows, "anomaly_score", places=6).select(
        "transaction_id", "account_id", "anomaly_score", "novelty_fingerprint", "fingerprint_prefix",
        "fingerprint_occurrences", "requires_escalation",
    )


@q(
    "j13_drop_reviewed_benign",
    with_views("scores", DISCOVERY_SQL + " SELECT transaction_id, fingerprint FROM nv WHERE fingerprint NOT IN (SELECT fingerprint FROM reg)"),
)
def _(spark, d):
    from ledgerscope.functions.text import fingerprint

    rows = N.pass_stream(novel_rows(spark, d)).select("transaction_id", fingerprint(F.col("features")).alias("fingerprint"))
    return X.drop_reviewed_benign(rows, benign_registry(spark, d)).select("transaction_id", "fingerprint")


@q(
    "n7_escalations",
    with_views(
        "scores",
        DISCOVERY_SQL
        + """ SELECT transaction_id AS sample_transaction_id, substr(fingerprint, 1, 16) AS novelty_fingerprint, occ AS occurrences_in_7d, round(score, 4) AS fraud_score_at_detection, TRUE AS evaded_detection
        FROM queue WHERE occ >= 10""",
    ),
)
def _(spark, d):
    queue = N.route_discovery(novel_rows(spark, d), benign_registry(spark, d))
    return N.escalation_events(queue).select(
        "sample_transaction_id", "novelty_fingerprint", "occurrences_in_7d", "fraud_score_at_detection", "evaded_detection"
    )


@q(
    "n7_confirmed",
    with_views(
        "alerts",
        """SELECT alert_id, transaction_id, 'mule' AS fraud_type, CASE WHEN account_id % 3 = 0 THEN 0.0::DOUBLE ELSE account_id % 10 / 10.0::DOUBLE END AS density_override,
        CASE WHEN account_id % 3 = 0 THEN 0.0::DOUBLE ELSE account_id % 7 / 7.0::DOUBLE END AS sink_score FROM alerts WHERE investigator_decision""",
    ),
)
def _(spark, d):
    a = F.col("account_id")
    feedback = V.alerts(spark, d).select(
        "alert_id", "transaction_id", "account_id", F.lit("mule").alias("fraud_type"), F.col("investigator_decision").alias("confirmed_fraud")
    )
    known = V.txn(spark, d).select("account_id").distinct().filter(a % 3 != 0)
    features = known.select(
        "account_id",
        F.lit(0.1).alias("pagerank_fraud_seeded"),
        F.lit(0.2).alias("community_fraud_ratio"),
        F.lit(1.0).alias("cycle_membership"),
        (a % 7 / 7.0).alias("sink_score"),
        (a % 10 / 10.0).alias("bipartite_score"),
    )
    return N.confirmed_events(feedback, features).select(
        "alert_id", "transaction_id", "fraud_type", "density_override", "sink_score"
    )


@q(
    "n8_psi_baseline",
    """WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'l_discount', CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END FROM lineitem)
    SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
      round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM l GROUP BY feature""",
)
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
    )
    base = N.psi_baseline(rows, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount"])
    return r(base, "mean", "std", "p10", "p25", "p50", "p75", "p90", places=6)


_HIST_SQL = """, bs AS (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)),
  hh AS (SELECT bin, count(b1) AS nb, count(b2) AS nr FROM bs LEFT JOIN (SELECT least(CAST(floor(score * 10) AS INTEGER), 9) AS b1, CAST(NULL AS INTEGER) AS b2 FROM scores
    UNION ALL SELECT NULL, least(CAST(floor(score * score * 10) AS INTEGER), 9) FROM scores WHERE scored_at > TIMESTAMP '2024-01-24 00:00:00') ON bin = coalesce(b1, b2) GROUP BY bin),
  hs AS (SELECT bin, nb, nr, nb / (SELECT sum(nb) FROM hh)::DOUBLE AS e, nr / (SELECT sum(nr) FROM hh)::DOUBLE AS a FROM hh)"""


def _recent(spark, d):
    rows = V.scores(spark, d).filter(F.col("scored_at") > F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
    return rows.withColumn("score", F.col("score") * F.col("score"))


@q("n8_score_histogram", with_views("scores", _HIST_SQL + " SELECT bin, nb AS n, round(e, 9) AS share FROM hs"))
def _(spark, d):
    return r(N.score_histogram(V.scores(spark, d)), "share", places=9)


@q(
    "n9_psi",
    with_views(
        "scores",
        _HIST_SQL
        + """ SELECT CAST(sum(nr) AS BIGINT) AS rows, round(sum((a - e) * ln(greatest(a, 1e-9) / greatest(e, 1e-9))), 8) AS psi,
        sum((a - e) * ln(greatest(a, 1e-9) / greatest(e, 1e-9))) > 0.2 AS alert FROM hs""",
    ),
)
def _(spark, d):
    value = N.psi(N.score_histogram(V.scores(spark, d)), N.score_histogram(_recent(spark, d)))
    return r(value, "psi", places=8)


@q(
    "n10_review_update",
    with_views(
        "scores",
        """, qq AS (SELECT transaction_id FROM scores WHERE score < 0.38), rv AS (SELECT transaction_id, CASE transaction_id % 4 WHEN 0 THEN 'REVIEWED_NORMAL' WHEN 1 THEN 'REVIEWED_NEW_FRAUD' WHEN 2 THEN 'CLOSED' ELSE 'PENDING_REVIEW' END AS status
          FROM scores WHERE score < 0.5)
        SELECT qq.transaction_id, CASE WHEN rv.status IN ('REVIEWED_NORMAL','REVIEWED_NEW_FRAUD') THEN rv.status ELSE 'PENDING_REVIEW' END AS status, 'queue' AS part FROM qq JOIN rv USING (transaction_id)
        UNION ALL SELECT transaction_id, CASE WHEN status NOT IN ('REVIEWED_NORMAL','REVIEWED_NEW_FRAUD') THEN 'status not allowed' ELSE 'not found' END, 'rejected' FROM rv
        WHERE status NOT IN ('REVIEWED_NORMAL','REVIEWED_NEW_FRAUD') OR transaction_id NOT IN (SELECT transaction_id FROM qq)""",
    ),
)
def _(spark, d):
    t = F.col("transaction_id")
    queue = N.pass_stream(V.scores(spark, d)).select("transaction_id", F.lit("PENDING_REVIEW").alias("status"))
    status = (
        F.when(t % 4 == 0, "REVIEWED_NORMAL")
        .when(t % 4 == 1, "REVIEWED_NEW_FRAUD")
        .when(t % 4 == 2, "CLOSED")
        .otherwise("PENDING_REVIEW")
    )
    reviews = V.scores(spark, d).filter(F.col("score") < 0.5).select(
        "transaction_id", status.alias("status"), F.lit("checked").alias("developer_notes"), F.col("scored_at").alias("reviewed_at")
    )
    updated, rejected = N.review_update(queue, reviews)
    kept = updated.select("transaction_id", "status", F.lit("queue").alias("part"))
    return kept.unionByName(rejected.select("transaction_id", F.col("reason").alias("status"), F.lit("rejected").alias("part")))


