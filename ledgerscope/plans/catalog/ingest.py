"""Sources, sinks and set operations."""

from pyspark.sql import functions as F

from ledgerscope.plans.catalog import Registry
from ledgerscope.sources import sinks, tables
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()


@q(
    "s1_accounts",
    with_views("acct", "SELECT * FROM acct"),
)
def _(spark, d):
    return V.acct(spark, d)


@q(
    "s2_validate",
    with_views(
        "txn",
        """, r AS (SELECT transaction_id,
          CASE WHEN amount > 0 AND amount < 400000 THEN NULL END AS unused,
          concat_ws(',', CASE WHEN channel NOT IN ('UPI','IMPS','RTGS','NEFT') THEN 'channel' END,
            CASE WHEN ts > TIMESTAMP '2024-01-30 00:05:00' THEN 'timestamp' END) AS reasons FROM txn)
        SELECT reasons, count(*) AS n FROM r GROUP BY reasons""",
    ),
)
def _(spark, d):
    cut = F.lit("2024-01-30 00:00:00").cast("timestamp")
    valid, rejected = tables.validate_transactions(V.txn(spark, d), cut)
    ok = valid.select(F.lit("").alias("reasons"))
    bad = rejected.select(F.concat_ws(",", "reasons").alias("reasons"))
    return ok.unionByName(bad).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@q(
    "s3_upsert",
    with_views(
        "txn",
        """, e AS (SELECT * FROM txn WHERE ts < TIMESTAMP '2024-01-20 00:00:00'),
        n AS (SELECT * REPLACE (amount + 1 AS amount) FROM txn WHERE ts >= TIMESTAMP '2024-01-15 00:00:00')
        SELECT transaction_id, account_id, amount FROM e UNION ALL
        SELECT transaction_id, account_id, amount FROM n
        WHERE transaction_id NOT IN (SELECT transaction_id FROM e)""",
    ),
)
def _(spark, d):
    t = V.txn(spark, d)
    old = t.filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    new = t.filter(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    new = new.withColumn("amount", F.col("amount") + 1)
    return tables.upsert_transactions(new, old).select("transaction_id", "account_id", "amount")


@q(
    "s3_missing_accounts",
    with_views(
        "txn acct",
        """, s AS (SELECT account_id AS id FROM txn UNION SELECT payee_account_id FROM txn)
        SELECT id, 'SAVINGS' AS account_type, 0.5::DOUBLE AS kyc_completeness_score,
          CAST(0 AS INTEGER) AS account_age_days FROM s
        WHERE id NOT IN (SELECT id FROM acct WHERE account_age_days > 300)""",
    ),
)
def _(spark, d):
    known = V.acct(spark, d).filter(F.col("account_age_days") > 300)
    return tables.missing_accounts(V.txn(spark, d), known)


@q(
    "s4_edges",
    with_views(
        "txn",
        """SELECT account_id AS src, payee_account_id AS dst, amount, ts, channel, transaction_id
        FROM txn WHERE ts > TIMESTAMP '2024-01-24 00:00:00'""",
    ),
)
def _(spark, d):
    return tables.edges(V.txn(spark, d), as_of(), days=7)


@q(
    "s5_vertices",
    with_views(
        "acct",
        """SELECT id, account_type, kyc_occupation, kyc_age, account_age_days,
          kyc_completeness_score, is_merchant FROM acct""",
    ),
)
def _(spark, d):
    return tables.vertices(V.acct(spark, d))


@q(
    "s6_device_edges",
    with_views(
        "txn",
        """SELECT account_id, device_id, min(ts) AS first_seen, max(ts) AS last_seen
        FROM txn GROUP BY account_id, device_id""",
    ),
)
def _(spark, d):
    return tables.device_edges(V.txn(spark, d))


@q(
    "s7_vpa_edges",
    with_views(
        "txnv",
        """SELECT DISTINCT account_id, payee_vpa, payee_vpa_created_at,
          CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(payee_vpa_created_at)) / 86400000000.0) AS BIGINT) AS age_days
        FROM txnv""",
    ),
)
def _(spark, d):
    return tables.vpa_edges(V.txnv(spark, d), as_of())


@q(
    "s10_merge_labelled",
    """WITH a AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, quality AS label FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(CASE WHEN label < 3 THEN 1 ELSE 0 END AS INTEGER) AS label FROM embeddings)
    SELECT label, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY label""",
)
def _(spark, d):
    base, other = _labelled(spark, d)
    merged, _report = tables.merge_labelled_sets(
        base, {"vectors": other, "narrow": other.drop("x")}
    )
    return merged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total")
    )


def _labelled(spark, d):
    base = (
        V.table(spark, d, "documents")
        .join(V.table(spark, d, "labels"), "doc_id")
        .select("doc_id", F.col("n_chars").cast("double").alias("x"), F.col("quality").alias("label"))
    )
    other = V.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.when(F.col("label") < 3, 1).otherwise(0).alias("label"),
    )
    return base, other


@q(
    "s10_merge_report",
    """SELECT 'vectors' AS set_name, TRUE AS appended, count(*) AS row_count,
      CAST(sum(CASE WHEN label < 3 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM embeddings
    UNION ALL SELECT 'narrow', FALSE, count(*), CAST(sum(CASE WHEN label < 3 THEN 1 ELSE 0 END) AS BIGINT) FROM embeddings""",
)
def _(spark, d):
    base, other = _labelled(spark, d)
    _merged, report = tables.merge_labelled_sets(
        base, {"vectors": other, "narrow": other.drop("x")}
    )
    return report


_FEATURES_SQL = """, f AS (SELECT account_id, count(*) AS txn_count, max(amount) AS top_amount,
  max(ts) AS computed_at FROM txn GROUP BY account_id)"""


def _features(spark, d):
    return V.txn(spark, d).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.max("amount").alias("top_amount"),
        F.max("ts").alias("computed_at"),
    )


@q(
    "s11_fresh_features",
    with_views(
        "txn",
        _FEATURES_SQL + " SELECT * FROM f WHERE computed_at > TIMESTAMP '2024-01-29 22:00:00'",
    ),
)
def _(spark, d):
    return sinks.fresh_features(_features(spark, d), as_of(), hours=26)


@q(
    "s12_patch_features",
    with_views(
        "txn",
        _FEATURES_SQL
        + """, p AS (SELECT account_id, max(amount) AS top_amount FROM txn
             WHERE ts > TIMESTAMP '2024-01-30 12:00:00' GROUP BY account_id)
        SELECT f.account_id, f.txn_count, coalesce(p.top_amount, f.top_amount) AS top_amount, f.computed_at
        FROM f LEFT JOIN p USING (account_id)""",
    ),
)
def _(spark, d):
    recent = V.txn(spark, d).filter(
        F.col("ts") > F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    )
    patch = recent.groupBy("account_id").agg(F.max("amount").alias("top_amount"))
    return sinks.patch_features(_features(spark, d), patch, ["top_amount"])


@q(
    "s13_score_audit",
    with_views(
        "scores",
        """SELECT transaction_id, 'SCORE' AS event_type, 'v1.0' AS model_version,
          '{"score":' || CAST(score AS VARCHAR) || ',"action":"' || action || '"}' AS event_data,
          scored_at AS event_timestamp FROM scores""",
    ),
)
def _(spark, d):
    rows = V.scores(spark, d).withColumn("event_timestamp", F.col("scored_at"))
    return sinks.audit_rows(rows, "SCORE", "v1.0", ["score", "action"])


@q(
    "u1_recently_active",
    with_views(
        "edges",
        """SELECT src AS account_id FROM edges WHERE ts > TIMESTAMP '2024-01-30 21:00:00'
        UNION SELECT dst FROM edges WHERE ts > TIMESTAMP '2024-01-30 21:00:00'""",
    ),
)
def _(spark, d):
    from ledgerscope.operators.queues import recently_active

    return recently_active(V.edges(spark, d), as_of(), minutes=180)


@q(
    "u2_touched_accounts",
    with_views("edges", "SELECT src AS account_id FROM edges UNION SELECT dst FROM edges"),
)
def _(spark, d):
    from ledgerscope.operators.queues import touched_accounts

    return touched_accounts(V.edges(spark, d))
