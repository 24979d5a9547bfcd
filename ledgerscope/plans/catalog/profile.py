"""Aggregations."""

from pyspark.sql import functions as F

from ledgerscope.operators import profile as P
from ledgerscope.plans.catalog import Registry
from ledgerscope.sources import tables
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()
_T = "TIMESTAMP '2024-01-31 00:00:00'"


def r(df, *columns, places=4):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


@q(
    "a1_velocity",
    with_views(
        "txn",
        f"""SELECT account_id, CAST(count(*) FILTER (WHERE ts > {_T} - INTERVAL 1 HOUR) AS DOUBLE) AS txn_count_last_1h,
        CAST(count(*) FILTER (WHERE ts > {_T} - INTERVAL 24 HOUR) AS DOUBLE) AS txn_count_last_24h,
        CAST(count(*) FILTER (WHERE ts > {_T} - INTERVAL 7 DAY) AS DOUBLE) AS txn_count_last_7d,
        round(coalesce(sum(amount) FILTER (WHERE ts > {_T} - INTERVAL 1 HOUR), 0), 4) AS txn_volume_last_1h,
        round(coalesce(sum(amount) FILTER (WHERE ts > {_T} - INTERVAL 24 HOUR), 0), 4) AS txn_volume_last_24h,
        CAST(count(DISTINCT payee_account_id) FILTER (WHERE ts > {_T} - INTERVAL 24 HOUR) AS DOUBLE) AS distinct_payees_24h
        FROM txn GROUP BY account_id""",
    ),
)
def _(spark, d):
    return r(P.velocity(V.txn(spark, d), as_of()), "txn_volume_last_1h", "txn_volume_last_24h")


@q(
    "a2_account_means",
    with_views(
        "txn",
        f"""SELECT account_id, round(coalesce(avg(amount) FILTER (WHERE ts > {_T} - INTERVAL 30 DAY), 0), 4) AS avg_amount_30d,
        count(*) FILTER (WHERE ts > {_T} - INTERVAL 24 HOUR) AS daily_txn_count FROM txn GROUP BY account_id""",
    ),
)
def _(spark, d):
    return r(P.account_means(V.txn(spark, d), as_of()), "avg_amount_30d")


@q(
    "a3_festival_history",
    """SELECT o_custkey AS account_id, count(*) FILTER (WHERE o_totalprice / 20 < 5000 AND month(o_orderdate) IN (10, 11)
      AND o_orderdate < TIMESTAMP '2000-08-02 00:00:00') > 3 AS has_festival_gifting_history FROM orders GROUP BY o_custkey""",
)
def _(spark, d):
    o = V.table(spark, d, "orders").select(
        F.col("o_custkey").alias("account_id"),
        (F.col("o_totalprice") / 20).alias("amount"),
        F.col("o_orderdate").alias("ts"),
    )
    return P.festival_history(o, F.lit("2001-08-02 00:00:00").cast("timestamp"))


_FLOW_SQL = ", ".join(
    f"round(coalesce(sum(amount) FILTER (WHERE dir = '{s}' AND ts >= {_T} - INTERVAL {h} HOUR), 0), 4) AS {s}flow_{n}"
    for n, h in P.WINDOWS.items()
    for s in ("in", "out")
)
SIDES_SQL = """, sides AS (SELECT src AS account_id, 'out' AS dir, dst AS other, amount, ts, channel, transaction_id FROM edges
  UNION ALL SELECT dst, 'in', src, amount, ts, channel, transaction_id FROM edges)"""


@q(
    "a4_window_flows",
    with_views("edges", SIDES_SQL + f" SELECT account_id, {_FLOW_SQL} FROM sides WHERE ts >= {_T} - INTERVAL 168 HOUR GROUP BY account_id"),
)
def _(spark, d):
    flows = P.window_flows(V.edges(spark, d), as_of())
    return r(flows, *[c for c in flows.columns if c != "account_id"])


@q(
    "a5_days_since",
    with_views(
        "edges",
        f"""SELECT account_id, round(rec, 6) AS days_since_last_receive, round(snd, 6) AS days_since_last_send FROM
        (SELECT dst AS account_id, (epoch_us({_T}) - epoch_us(max(ts))) / 86400000000.0::DOUBLE AS rec FROM edges GROUP BY dst)
        FULL JOIN (SELECT src AS account_id, (epoch_us({_T}) - epoch_us(max(ts))) / 86400000000.0::DOUBLE AS snd FROM edges GROUP BY src) USING (account_id)""",
    ),
)
def _(spark, d):
    e = V.edges(spark, d)
    both = P.days_since(e, as_of(), "receive").join(P.days_since(e, as_of(), "send"), "account_id", "full")
    return r(both, "days_since_last_receive", "days_since_last_send", places=6)


DEGREES_SQL = """, deg0 AS (SELECT account_id, count(DISTINCT other) FILTER (WHERE dir = 'in') AS in_degree,
    count(DISTINCT other) FILTER (WHERE dir = 'out') AS out_degree FROM sides GROUP BY account_id),
  deg AS (SELECT *, (in_degree + out_degree) / ((SELECT count(*) FROM deg0) - 1)::DOUBLE AS degree_centrality,
    out_degree / greatest(in_degree, 1)::DOUBLE AS fan_out_ratio FROM deg0)"""


@q(
    "a6_degrees",
    with_views(
        "edges",
        SIDES_SQL
        + DEGREES_SQL
        + " SELECT account_id, in_degree, out_degree, round(degree_centrality, 6) AS degree_centrality, round(fan_out_ratio, 6) AS fan_out_ratio FROM deg",
    ),
)
def _(spark, d):
    return r(P.degrees(V.edges(spark, d)), "degree_centrality", "fan_out_ratio", places=6)


@q(
    "a7_a8_sink_bipartite",
    with_views(
        "edges",
        SIDES_SQL
        + DEGREES_SQL
        + """ SELECT account_id, round(in_degree / (in_degree + out_degree)::DOUBLE, 6) AS sink_score,
        round(in_degree / (in_degree + out_degree)::DOUBLE * CASE WHEN degree_centrality < 0.01 THEN 1.0 ELSE 0.5 END, 6) AS cash_mule_sink_score,
        round(CASE WHEN in_degree > 3 AND out_degree <= 2 THEN least(in_degree / greatest(out_degree * 3, 1)::DOUBLE, 1.0::DOUBLE) ELSE 0.0 END, 6) AS bipartite_score FROM deg""",
    ),
)
def _(spark, d):
    rows = P.bipartite_scores(P.sink_scores(P.degrees(V.edges(spark, d))))
    names = ["sink_score", "cash_mule_sink_score", "bipartite_score"]
    return r(rows.select("account_id", *names), *names, places=6)


@q(
    "a9_community_stats",
    with_views(
        "acct seeds",
        """SELECT a.id % 12 AS community_id, count(*) AS community_size, round(count(s.account_id) / count(*)::DOUBLE, 6) AS community_fraud_ratio
        FROM acct a LEFT JOIN seeds s ON a.id = s.account_id GROUP BY a.id % 12""",
    ),
)
def _(spark, d):
    membership = V.acct(spark, d).select(
        F.col("id").alias("account_id"), (F.col("id") % 12).alias("community_id")
    )
    return r(P.community_stats(membership, V.seeds(spark, d)), "community_fraud_ratio", places=6)


def bank_rows(spark, d):
    """Payments as bank rows: direction, place, device, merchant, balance, logins."""
    t = F.col("transaction_id")
    return V.txn(spark, d).select(
        "transaction_id",
        "account_id",
        "amount",
        "channel",
        F.when(t % 3 == 0, "in").otherwise("out").alias("direction"),
        F.when(F.col("account_id") % 4 == 0, F.lit(0)).otherwise(F.col("geo_state")).alias("location"),
        "device_id",
        F.col("payee_account_id").alias("merchant_id"),
        (F.col("amount") * 3 + 1000).alias("balance"),
        F.when(t % 211 == 0, 4).when(t % 17 == 0, 2).otherwise(1).alias("login_attempts"),
        "ts",
    )


BANK_SQL = """, bank AS (SELECT transaction_id, account_id, amount, channel, CASE WHEN transaction_id % 3 = 0 THEN 'in' ELSE 'out' END AS direction,
  CASE WHEN account_id % 4 = 0 THEN 0 ELSE geo_state END AS location, device_id, payee_account_id AS merchant_id, amount * 3 + 1000 AS balance,
  CASE WHEN transaction_id % 211 = 0 THEN 4 WHEN transaction_id % 17 = 0 THEN 2 ELSE 1 END AS login_attempts, ts FROM txn),
prof0 AS (SELECT account_id, count(*) AS txn_count_all, avg(amount) AS avg_amount, stddev_samp(amount) AS std_amount,
  coalesce(sum(amount) FILTER (WHERE direction = 'out'), 0) AS total_out, coalesce(sum(amount) FILTER (WHERE direction = 'in'), 0) AS total_in,
  count(DISTINCT location) AS n_locations, count(DISTINCT device_id) AS n_devices, count(DISTINCT merchant_id) AS n_merchants,
  count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 5) / count(*)::DOUBLE AS night_txn_ratio,
  count(*) FILTER (WHERE isodow(ts) >= 6) / count(*)::DOUBLE AS weekend_txn_ratio, min(balance) AS min_balance,
  max(login_attempts) AS max_login_attempts FROM bank GROUP BY account_id),
prof AS (SELECT *, total_in / (total_out + total_in + 1e-6) AS return_ratio, CAST(least(greatest(n_locations - 1, 0), 1) AS DOUBLE) AS geography_switch,
  n_merchants / txn_count_all::DOUBLE AS counterparty_novelty, least(greatest(1 - min_balance / (total_in + 1), 0.0::DOUBLE), 1.0::DOUBLE) AS sink_score,
  least(greatest((max_login_attempts - 1) / 4.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS channel_switch FROM prof0)"""
_PROFILE_ROUNDED = [
    "avg_amount", "std_amount", "total_out", "total_in", "night_txn_ratio", "weekend_txn_ratio",
    "min_balance", "return_ratio", "counterparty_novelty", "sink_score",
]


@q(
    "a10_account_profile",
    with_views(
        "txn",
        BANK_SQL
        + " SELECT account_id, txn_count_all, n_locations, n_devices, n_merchants, CAST(max_login_attempts AS INTEGER) AS max_login_attempts, geography_switch, channel_switch, "
        + ", ".join(f"round({c}, 4) AS {c}" for c in _PROFILE_ROUNDED)
        + " FROM prof",
    ),
)
def _(spark, d):
    return r(P.account_profile(bank_rows(spark, d)), *_PROFILE_ROUNDED)


@q(
    "a11_channel_entropy",
    with_views(
        "txn",
        """, c AS (SELECT account_id, channel, count(*) AS n FROM txn GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY account_id)::DOUBLE AS s FROM c)
        SELECT account_id, round(-sum(s * log2(s + 1e-9)), 6) AS channel_entropy FROM p GROUP BY account_id""",
    ),
)
def _(spark, d):
    return r(P.channel_entropy(V.txn(spark, d)), "channel_entropy", places=6)


@q(
    "a12_account_activity",
    with_views(
        "txn",
        f""", x AS (SELECT * REPLACE (CASE WHEN account_id % 10 = 3 AND ts < TIMESTAMP '2024-01-28 00:00:00' THEN ts - INTERVAL 100 DAY ELSE ts END AS ts) FROM txn),
        g AS (SELECT account_id, count(*) FILTER (WHERE ts > {_T} - INTERVAL 30 DAY) AS txn_count_30d, count(*) FILTER (WHERE ts > {_T} - INTERVAL 90 DAY) AS txn_count_90d,
          count(*) AS txn_count_all, coalesce(avg(amount) FILTER (WHERE ts > {_T} - INTERVAL 30 DAY), 0) AS avg_txn_amount_30d,
          count(DISTINCT payee_account_id) FILTER (WHERE ts > {_T} - INTERVAL 30 DAY) AS distinct_counterparties_30d,
          avg(amount) AS m, coalesce(stddev_samp(amount), 0) AS s, arg_max(amount, ts) AS la, arg_max(hour(ts), ts) AS lh FROM x GROUP BY account_id)
        SELECT account_id, txn_count_30d, txn_count_90d, txn_count_all, round(avg_txn_amount_30d, 4) AS avg_txn_amount_30d, distinct_counterparties_30d,
          round(CASE WHEN s < 1e-9 THEN 0 ELSE abs(la - m) / s END, 6) AS amount_zscore, round(abs(lh - 14.0::DOUBLE) / 10, 6) AS hour_deviation,
          CASE WHEN txn_count_30d > 0 AND txn_count_90d = txn_count_30d AND txn_count_all > txn_count_90d THEN 1.0::DOUBLE ELSE 0.0 END AS dormancy_break FROM g""",
    ),
)
def _(spark, d):
    early = F.col("ts") < F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    moved = V.txn(spark, d).withColumn(
        "ts",
        F.when((F.col("account_id") % 10 == 3) & early, F.col("ts") - F.expr("INTERVAL 100 DAYS")).otherwise(
            F.col("ts")
        ),
    )
    rows = r(P.account_activity(moved, as_of()), "avg_txn_amount_30d")
    return r(rows, "amount_zscore", "hour_deviation", places=6)


@q(
    "a13_burst_ratio",
    with_views(
        "txn",
        f""", g AS (SELECT account_id, (count(*) FILTER (WHERE ts > {_T} - INTERVAL 6 HOUR) / 6.0::DOUBLE) /
          greatest(count(*) FILTER (WHERE ts > {_T} - INTERVAL 28 DAY) / 672.0::DOUBLE, 0.01::DOUBLE) AS rate FROM txn GROUP BY account_id)
        SELECT account_id, round(least(rate / 50, 1.0::DOUBLE), 6) AS burst_score, round(least(rate / 10, 30.0::DOUBLE), 6) AS velocity_ratio,
          round(least(rate / 10, 30.0::DOUBLE), 6) AS temporal_acceleration FROM g""",
    ),
)
def _(spark, d):
    rows = P.burst_and_velocity_ratio(V.txn(spark, d), as_of())
    return r(rows, "burst_score", "velocity_ratio", "temporal_acceleration", places=6)


SET_FEATURES_SQL = f""", sf0 AS (SELECT *, hour(ts) < 6 OR hour(ts) >= 22 AS night, amount > 100000 AS high,
    (epoch_us(ts) - epoch_us(payee_vpa_created_at)) / 86400000000.0::DOUBLE < 7 AS nv FROM txnv WHERE ts > {_T} - INTERVAL 90 DAY),
  sf1 AS (SELECT account_id, count(*) AS n, count(*) FILTER (WHERE night) AS a, count(*) FILTER (WHERE nv) AS b, count(*) FILTER (WHERE high) AS c,
    count(DISTINCT channel) AS e, count(*) FILTER (WHERE amount < 1) AS f, count(*) FILTER (WHERE CAST(round(amount) AS BIGINT) % 1000 = 0 AND amount > 10000) AS g,
    count(DISTINCT CASE WHEN night THEN 'night' WHEN high THEN 'high' WHEN nv THEN 'new_vpa' END) AS h FROM sf0 GROUP BY account_id),
  setf AS (SELECT account_id, round(CASE WHEN n >= 5 THEN a / n::DOUBLE END, 6) AS count_of_night_txns, round(CASE WHEN n >= 5 THEN b / n::DOUBLE END, 6) AS count_of_new_vpa_txns,
    round(CASE WHEN n >= 5 THEN c / n::DOUBLE END, 6) AS count_of_high_amount_txns, round(CASE WHEN n >= 5 THEN (least(e, 5) - 1) / 4.0::DOUBLE END, 6) AS count_of_channel_switches,
    CASE WHEN n >= 5 THEN (f > 0)::INT::DOUBLE END AS has_any_micro_test_payment, CASE WHEN n >= 5 THEN (g > 0)::INT::DOUBLE END AS has_any_round_amount_burst,
    round(CASE WHEN n >= 5 THEN least(h, 3) / 3.0::DOUBLE END, 6) AS distinct_fraud_proximate_action_types FROM sf1)"""


@q("a14_set_features", with_views("txnv", SET_FEATURES_SQL + " SELECT * FROM setf"))
def _(spark, d):
    rows = P.set_features(V.txnv(spark, d), as_of())
    return r(rows, *[c for c in rows.columns if c.startswith(("count", "distinct"))], places=6)


def _benford_sql(source: str, key: str, order: str, limit: int) -> str:
    digit = "CAST(regexp_extract(CAST(CAST(amount AS DECIMAL(38,10)) AS VARCHAR), '[1-9]') AS INTEGER)"
    gaps = " + ".join(
        f"abs(count(*) FILTER (WHERE dg = {i}) / count(dg)::DOUBLE - log10(1 + 1 / {i}.0::DOUBLE))" for i in range(1, 10)
    )
    return f""", b0 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} WHERE amount > 0),
    b1 AS (SELECT *, {digit} AS dg FROM b0 WHERE rn <= {limit})
    SELECT {key} AS account_id, round(CASE WHEN count(*) >= 20 AND count(dg) > 0 THEN least(({gaps}) / 2, 1.0::DOUBLE) END, 6) AS benford_deviation FROM b1 GROUP BY {key}"""


@q("a15_benford", with_views("txn", _benford_sql("txn", "account_id", "ts DESC, transaction_id", 200)))
def _(spark, d):
    return r(P.benford_deviation(V.txn(spark, d), as_of()), "benford_deviation", places=6)


# Order lines as receipts of suppliers: many rows per key, so the 200-row limit binds.
@q(
    "a15_benford_receipts",
    "WITH rc AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS transaction_id, l_extendedprice AS amount, TIMESTAMP '2024-01-30 00:00:00' AS ts FROM lineitem)"
    + _benford_sql("rc", "l_suppkey", "transaction_id, amount", 200),
)
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("account_id"),
        F.struct(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_extendedprice")).alias("transaction_id"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("ts"),
    )
    return r(P.benford_deviation(rows, as_of()), "benford_deviation", places=6)


@q(
    "a16_fan_in_zscore",
    with_views(
        "txn",
        f""", dl AS (SELECT payee_account_id, date_trunc('day', ts) AS day, count(DISTINCT account_id) AS c FROM txn WHERE ts > {_T} - INTERVAL 90 DAY GROUP BY ALL),
        s AS (SELECT payee_account_id, avg(c) AS m, stddev_samp(c) AS sd FROM dl GROUP BY ALL),
        t AS (SELECT payee_account_id, count(DISTINCT account_id) AS c FROM txn WHERE ts > {_T} - INTERVAL 24 HOUR GROUP BY ALL)
        SELECT s.payee_account_id AS account_id, CASE WHEN sd > 0 THEN round((coalesce(t.c, 0) - m) / sd, 3) END AS fan_in_sender_zscore
        FROM s LEFT JOIN t USING (payee_account_id)""",
    ),
)
def _(spark, d):
    return P.fan_in_zscore(V.txn(spark, d), as_of())


_QUEUE_SQL = """, nq AS (SELECT transaction_id, -score AS anomaly_score, scored_at AS created_at, transaction_id % 20 = 0 AS requires_escalation,
  CASE transaction_id % 4 WHEN 0 THEN 'REVIEWED_NEW_FRAUD' WHEN 1 THEN 'REVIEWED_NORMAL' ELSE 'PENDING_REVIEW' END AS status FROM scores WHERE action = 'PASS')"""


def _queue(spark, d):
    t = F.col("transaction_id")
    return (
        V.scores(spark, d)
        .filter(F.col("action") == "PASS")
        .select(
            t,
            (-F.col("score")).alias("anomaly_score"),
            F.col("scored_at").alias("created_at"),
            (t % 20 == 0).alias("requires_escalation"),
            F.when(t % 4 == 0, "REVIEWED_NEW_FRAUD")
            .when(t % 4 == 1, "REVIEWED_NORMAL")
            .otherwise("PENDING_REVIEW")
            .alias("status"),
        )
    )


@q(
    "a17_novelty_stats",
    with_views(
        "scores",
        _QUEUE_SQL
        + f""" SELECT count(*) FILTER (WHERE status = 'PENDING_REVIEW') AS pending, count(*) FILTER (WHERE requires_escalation) AS escalated,
        count(*) FILTER (WHERE status = 'REVIEWED_NEW_FRAUD') AS confirmed_new_patterns, count(*) FILTER (WHERE created_at > {_T} - INTERVAL 24 HOUR) AS last_24h,
        round(avg(anomaly_score), 4) AS avg_anomaly_score, count(*) AS total FROM nq""",
    ),
)
def _(spark, d):
    return P.novelty_stats(_queue(spark, d), as_of())


@q("a18_queue_counts", with_views("scores", _QUEUE_SQL + " SELECT status, count(*) AS n FROM nq GROUP BY status"))
def _(spark, d):
    return P.queue_counts(_queue(spark, d))


@q(
    "a19_action_counts",
    with_views(
        "scores",
        "SELECT action, coalesce(gate_fired, 'none') AS gate_fired, CAST(CASE "
        + " ".join(f"WHEN processing_ms <= {b} THEN {b}" for b in [5, 10, 20, 30, 50, 75, 90, 100, 150, 200, 500])
        + " END AS DOUBLE) AS latency_ms_le, count(*) AS n FROM scores GROUP BY ALL",
    ),
)
def _(spark, d):
    counts = P.action_counts(V.scores(spark, d))
    return counts.withColumn("latency_ms_le", F.col("latency_ms_le").cast("double"))


@q(
    "a20_class_weights",
    """SELECT count(*) FILTER (WHERE toxic = 1) AS positives, count(*) FILTER (WHERE toxic <> 1) AS negatives,
      greatest(CAST(floor(count(*) FILTER (WHERE toxic <> 1) / count(*) FILTER (WHERE toxic = 1)::DOUBLE) AS BIGINT), 1) AS positive_weight FROM labels""",
)
def _(spark, d):
    return P.class_weights(V.table(spark, d, "labels"), "toxic")


@q(
    "a21_archetype_breakdown",
    with_views("scores", "SELECT channel AS archetype, round(avg(score), 6) AS mean_score, count(*) AS n FROM scores GROUP BY channel"),
)
def _(spark, d):
    rows = V.scores(spark, d).withColumnRenamed("channel", "archetype")
    return r(P.archetype_breakdown(rows), "mean_score", places=6)


@q(
    "a22_graph_stats",
    with_views(
        "acct edges txnv",
        """SELECT (SELECT count(*) FROM acct) AS accounts, (SELECT count(*) FROM edges) AS sent,
        (SELECT count(*) FROM (SELECT DISTINCT account_id, device_id FROM txnv)) AS uses,
        (SELECT count(*) FROM (SELECT DISTINCT account_id, payee_vpa, payee_vpa_created_at FROM txnv)) AS vpas""",
    ),
)
def _(spark, d):
    t = V.txnv(spark, d)
    return P.graph_stats(
        tables.vertices(V.acct(spark, d)),
        V.edges(spark, d),
        tables.device_edges(t),
        tables.vpa_edges(t, as_of()),
    )


RETENTION_SQL = """, ret AS (SELECT account_id, coalesce(sum(amount) FILTER (WHERE dir = 'in'), 0) AS inflow_last_30d,
    coalesce(sum(amount) FILTER (WHERE dir = 'out'), 0) AS outflow_last_30d FROM sides WHERE ts > TIMESTAMP '2024-01-01 00:00:00' GROUP BY account_id),
  retention AS (SELECT *, CASE WHEN inflow_last_30d > 0 THEN greatest(1 - outflow_last_30d / inflow_last_30d, 0.0::DOUBLE) ELSE 0.0 END AS retention_ratio FROM ret)"""


@q(
    "a23_inflow_retention",
    with_views(
        "edges",
        SIDES_SQL
        + RETENTION_SQL
        + """ SELECT account_id, round(inflow_last_30d, 4) AS inflow_last_30d, round(outflow_last_30d, 4) AS outflow_last_30d,
          round(retention_ratio, 6) AS retention_ratio FROM retention""",
    ),
)
def _(spark, d):
    rows = r(P.inflow_retention(V.edges(spark, d), as_of()), "inflow_last_30d", "outflow_last_30d")
    return r(rows, "retention_ratio", places=6)
