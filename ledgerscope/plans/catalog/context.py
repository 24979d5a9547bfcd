"""Joins, windows, and per-key orderings."""

from pyspark.sql import functions as F

from ledgerscope.operators import context as X
from ledgerscope.operators import queues
from ledgerscope.plans.catalog import Registry
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()


# Every RTGS payment restates where its account is at home, for five days.
@q(
    "j1_account_as_of",
    with_views(
        "txn",
        """, v AS (SELECT account_id, ts AS valid_from, max(geo_state) AS home_state, max(device_id) AS home_device FROM txn WHERE channel = 'RTGS' GROUP BY ALL),
        m AS (SELECT t.transaction_id, t.ts, v.valid_from, v.home_state, v.home_device FROM txn t ASOF LEFT JOIN v ON t.account_id = v.account_id AND t.ts >= v.valid_from)
        SELECT transaction_id, CASE WHEN ts < valid_from + INTERVAL 5 DAY THEN home_state END AS home_state, CASE WHEN ts < valid_from + INTERVAL 5 DAY THEN home_device END AS home_device FROM m""",
    ),
)
def _(spark, d):
    t = V.txn(spark, d)
    versions = t.filter("channel = 'RTGS'").groupBy(F.col("account_id").alias("id"), F.col("ts").alias("valid_from")).agg(
        F.max("geo_state").alias("home_state"), F.max("device_id").alias("home_device")
    )
    versions = versions.withColumn("valid_until", F.col("valid_from") + F.expr("INTERVAL 5 DAYS"))
    return X.with_account_versions(t, versions, ["home_state", "home_device"], valid_until="valid_until").select(
        "transaction_id", "home_state", "home_device"
    )


@q(
    "j1_j2_account_context",
    with_views(
        "txn acct",
        """SELECT t.transaction_id, CASE WHEN a.id IS NULL THEN 'SAVINGS' ELSE a.account_type END AS account_type, a.kyc_occupation, CAST(a.kyc_age AS DOUBLE) AS kyc_age,
        coalesce(a.account_age_days, 0) AS account_age_days, b.account_age_days AS payee_account_age_days
        FROM txn t LEFT JOIN (SELECT * FROM acct WHERE account_age_days > 300) a ON t.account_id = a.id
        LEFT JOIN acct b ON t.payee_account_id = b.id""",
    ),
)
def _(spark, d):
    accounts = V.acct(spark, d)
    rows = X.with_account_context(V.txn(spark, d), accounts.filter("account_age_days > 300"))
    return X.with_payee_age(rows, accounts).select(
        "transaction_id",
        "account_type",
        "kyc_occupation",
        F.col("kyc_age").cast("double").alias("kyc_age"),
        "account_age_days",
        "payee_account_age_days",
    )


@q(
    "j3_known_contact",
    with_views(
        "txn",
        """SELECT transaction_id, EXISTS (SELECT 1 FROM txn o WHERE o.account_id = t.account_id
          AND o.payee_account_id = t.payee_account_id AND o.ts < t.ts) AS payee_in_known_contacts FROM txn t""",
    ),
)
def _(spark, d):
    return X.with_known_contact(V.txn(spark, d)).select("transaction_id", "payee_in_known_contacts")


@q(
    "j4_payee_alerts",
    with_views(
        "txn alerts",
        """, n AS (SELECT account_id, count(*) AS c FROM alerts GROUP BY account_id)
        SELECT t.transaction_id, coalesce(n.c, 0)::DOUBLE AS payee_shared_alert_count,
          CASE WHEN n.c > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS payee_in_alert_log
        FROM txn t LEFT JOIN n ON t.payee_account_id = n.account_id""",
    ),
)
def _(spark, d):
    t = V.txn(spark, d)
    return X.with_payee_alert_history(t, V.alerts(spark, d), t).select(
        "transaction_id", "payee_shared_alert_count", "payee_in_alert_log"
    )


@q(
    "j5_fraud_accounts",
    with_views(
        "alerts",
        """SELECT DISTINCT account_id, 'action' AS rule FROM alerts
        UNION ALL SELECT DISTINCT account_id, 'decision' FROM alerts WHERE investigator_decision""",
    ),
)
def _(spark, d):
    a, t = V.alerts(spark, d), V.txn(spark, d)
    by_action = X.fraud_accounts(a, t, "action").withColumn("rule", F.lit("action"))
    return by_action.unionByName(X.fraud_accounts(a, t, "decision").withColumn("rule", F.lit("decision")))


# Clean accounts are drawn by Spark's own hash, so the SQL checks the count and the exclusion.
@q(
    "j6_clean_accounts",
    with_views(
        "acct seeds",
        """SELECT least((SELECT count(*) FROM seeds), (SELECT count(*) FROM acct WHERE id NOT IN (SELECT account_id FROM seeds))) AS drawn,
        CAST(0 AS BIGINT) AS overlapping""",
    ),
)
def _(spark, d):
    fraud = V.seeds(spark, d)
    drawn = X.clean_accounts(V.acct(spark, d), fraud, fraud.count())
    marked = drawn.join(fraud.withColumn("hit", F.lit(1)), "account_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("drawn"), F.count("hit").alias("overlapping"))


@q(
    "j7_legit_accounts",
    with_views(
        "txn alerts",
        """, f AS (SELECT account_id, max(ts) AS computed_at, count(*) AS n FROM txn GROUP BY account_id)
        SELECT * FROM f WHERE computed_at > TIMESTAMP '2024-01-29 00:00:00'
          AND account_id NOT IN (SELECT account_id FROM alerts WHERE status = 'CONFIRMED_FRAUD' AND score >= 0.99)""",
    ),
)
def _(spark, d):
    features = V.txn(spark, d).groupBy("account_id").agg(
        F.max("ts").alias("computed_at"), F.count(F.lit(1)).alias("n")
    )
    strong = V.alerts(spark, d).filter(F.col("score") >= 0.99)
    return X.legit_training_accounts(features, strong, as_of())


@q(
    "j8_latest_committee",
    with_views(
        "alerts shadow",
        """, s AS (SELECT * FROM shadow UNION ALL SELECT * REPLACE (scored_at + INTERVAL 1 HOUR AS scored_at, final_committee_score / 2 AS final_committee_score) FROM shadow WHERE transaction_id % 2 = 0)
        SELECT alert_id, scored_at, final_committee_score FROM (
          SELECT a.alert_id, s.scored_at, s.final_committee_score, row_number() OVER (PARTITION BY a.alert_id ORDER BY s.scored_at DESC) AS rn
          FROM alerts a JOIN s USING (transaction_id)) WHERE rn = 1""",
    ),
)
def _(spark, d):
    s = V.shadow(spark, d)
    later = (
        s.filter(F.col("transaction_id") % 2 == 0)
        .withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 1 HOUR"))
        .withColumn("final_committee_score", F.col("final_committee_score") / 2)
    )
    both = s.unionByName(later).drop("account_id")
    return X.latest_committee(V.alerts(spark, d), both).select(
        "alert_id", "scored_at", "final_committee_score"
    )


@q(
    "j9_sanctions",
    with_views(
        "txn acct",
        """, l AS (SELECT 'MHA_INDIA' AS list_name, 3 AS p, CAST(id AS VARCHAR) AS entry FROM acct WHERE account_age_days % 7 = 0
          UNION ALL SELECT 'UN', 2, upper(holder_name) FROM acct WHERE account_age_days % 5 = 0
          UNION ALL SELECT 'OFAC', 1, CAST(id AS VARCHAR) FROM acct WHERE account_age_days % 11 = 0),
        h AS (SELECT t.transaction_id, CAST(t.account_id AS VARCHAR) AS aid, upper(a.holder_name) AS nm FROM txn t JOIN acct a ON t.account_id = a.id),
        m AS (SELECT h.transaction_id, l.p, 'account_id' AS matched, l.list_name FROM h JOIN l ON h.aid = l.entry
          UNION ALL SELECT h.transaction_id, l.p, 'name', l.list_name FROM h JOIN l ON h.nm = l.entry)
        SELECT transaction_id, list_name, matched FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY p, matched) AS rn FROM m) WHERE rn = 1""",
    ),
)
def _(spark, d):
    accounts = V.acct(spark, d)
    age = F.col("account_age_days")
    ident = F.col("id").cast("string")

    def entries(name, test, value):
        return accounts.filter(test).select(F.lit(name).alias("list_name"), value.alias("entry"))

    lists = (
        entries("MHA_INDIA", age % 7 == 0, ident)
        .unionByName(entries("UN", age % 5 == 0, F.upper("holder_name")))
        .unionByName(entries("OFAC", age % 11 == 0, ident))
    )
    named = V.txn(spark, d).join(
        accounts.select(F.col("id").alias("account_id"), "holder_name"), "account_id"
    )
    return X.sanctions_match(named, lists)


@q(
    "j12_kyc_related",
    with_views(
        "txn",
        """, p AS (SELECT DISTINCT account_id AS a, payee_account_id AS b FROM txn),
        r AS (SELECT DISTINCT least(user_id, (user_id * 7 + 3) % 100) AS lo, greatest(user_id, (user_id * 7 + 3) % 100) AS hi FROM events)
        SELECT p.a, p.b FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.lo = least(p.a, p.b) AND r.hi = greatest(p.a, p.b))""",
    ),
)
def _(spark, d):
    t = V.txn(spark, d)
    pairs = t.select(F.col("account_id").alias("a"), F.col("payee_account_id").alias("b")).distinct()
    relations = t.select(
        F.col("account_id").alias("a"), ((F.col("account_id") * 7 + 3) % 100).alias("b")
    )
    return X.kyc_related(pairs, relations)


@q(
    "j14_prefer_embedding",
    """WITH p AS (SELECT vec_id AS account_id, CASE WHEN vec_id % 5 = 0 THEN embedding[1:10] ELSE embedding[1:32] END AS v FROM embeddings WHERE vec_id % 3 <> 0),
    f AS (SELECT vec_id AS account_id, embedding[33:64] AS v FROM embeddings WHERE vec_id % 2 = 0),
    j AS (SELECT coalesce(p.account_id, f.account_id) AS account_id, coalesce(p.v, f.v) AS v, p.v IS NOT NULL AS prim FROM p FULL JOIN f ON p.account_id = f.account_id)
    SELECT account_id, CASE WHEN len(v) = 32 THEN CAST(v[1] AS DOUBLE) END AS head, CASE WHEN prim THEN 'primary' ELSE 'fallback' END AS embedding_source,
      len(v) <> 32 AS missing_flag FROM j""",
)
def _(spark, d):
    e = V.table(spark, d, "embeddings")
    i, v = F.col("vec_id"), F.col("embedding")
    short = F.when(i % 5 == 0, F.slice(v, 1, 10)).otherwise(F.slice(v, 1, 32))
    primary = e.filter(i % 3 != 0).select(i.alias("account_id"), short.alias("embedding"))
    fallback = e.filter(i % 2 == 0).select(i.alias("account_id"), F.slice(v, 33, 32).alias("embedding"))
    return X.prefer_embedding(primary, fallback, 32).select(
        "account_id",
        F.col("embedding")[0].cast("double").alias("head"),
        "embedding_source",
        "missing_flag",
    )


@q(
    "j15_labelled_scores",
    with_views(
        "shadow",
        """, c AS (SELECT doc_id AS transaction_id, quality AS label FROM labels)
        SELECT s.transaction_id, s.final_committee_score, c.label FROM shadow s JOIN c USING (transaction_id)""",
    ),
)
def _(spark, d):
    labels = V.table(spark, d, "labels")
    older = labels.select(
        F.col("doc_id").alias("transaction_id"), F.col("toxic").alias("label"), F.lit(1).alias("created_at")
    )
    newer = labels.select(
        F.col("doc_id").alias("transaction_id"), F.col("quality").alias("label"), F.lit(2).alias("created_at")
    )
    return X.scores_with_labels(V.shadow(spark, d), older.unionByName(newer)).select(
        "transaction_id", "final_committee_score", "label"
    )


# ── Windows ─────────────────────────────────────────────────────────────────

_H1 = "(PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND {end})"
_D1 = "(PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND {end})"
_D30 = "(PARTITION BY account_id ORDER BY epoch_us(ts) RANGE BETWEEN 2591999999999 PRECEDING AND {end})"


@q(
    "w1_sliding_velocity",
    with_views(
        "txn",
        f"""SELECT transaction_id, count(*) OVER {_H1.format(end="1 PRECEDING")} AS velocity_1h,
        count(*) OVER {_D1.format(end="1 PRECEDING")} AS velocity_24h FROM txn""",
    ),
)
def _(spark, d):
    return X.sliding_velocity(V.txn(spark, d)).select("transaction_id", "velocity_1h", "velocity_24h")


@q(
    "w2_sliding_volume",
    with_views(
        "txn",
        f"""SELECT transaction_id, round(coalesce(sum(amount) OVER {_H1.format(end="1 PRECEDING")}, 0.0::DOUBLE), 4) AS volume_1h FROM txn""",
    ),
)
def _(spark, d):
    return X.sliding_volume(V.txn(spark, d)).select(
        "transaction_id", F.round("volume_1h", 4).alias("volume_1h")
    )


@q(
    "w3_burst_window",
    with_views(
        "edges",
        """, l AS (SELECT dst, ts, lag(ts, 2) OVER (PARTITION BY dst ORDER BY ts) AS st FROM edges),
        h AS (SELECT dst, st, ts FROM l WHERE epoch_us(ts) - epoch_us(st) <= 7200000000)
        SELECT dst, st AS burst_start, round((epoch_us(ts) - epoch_us(st)) / 1000000.0::DOUBLE, 6) AS burst_seconds
        FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY st, ts) AS rn FROM h) WHERE rn = 1""",
    ),
)
def _(spark, d):
    bursts = X.burst_window(V.edges(spark, d), "dst", 3, 7_200)
    return bursts.withColumn("burst_seconds", F.round("burst_seconds", 6))


@q(
    "w4_latest_n",
    with_views(
        "txn",
        """SELECT account_id, transaction_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id) AS rn FROM txn) WHERE rn <= 20""",
    ),
)
def _(spark, d):
    return X.latest_n(V.txn(spark, d), "account_id", 20).select("account_id", "transaction_id")


@q(
    "w5_latest_per_key",
    with_views(
        "txn",
        """SELECT payee_account_id, transaction_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY payee_account_id ORDER BY ts DESC) AS rn FROM txn) WHERE rn = 1""",
    ),
)
def _(spark, d):
    return X.latest_per_key(V.txn(spark, d), "payee_account_id", "ts").select(
        "payee_account_id", "transaction_id", "amount"
    )


@q(
    "w6_fingerprint_runs",
    with_views(
        "txn",
        """, n AS (SELECT transaction_id, 'fp' || (account_id * 13 + payee_account_id) % 997 AS fingerprint, ts FROM txn),
        g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY fingerprint ORDER BY ts, transaction_id)) < 86400000000 THEN 0 ELSE 1 END AS nw FROM n),
        r AS (SELECT *, sum(nw) OVER (PARTITION BY fingerprint ORDER BY ts, transaction_id) AS run FROM g)
        SELECT transaction_id, fingerprint, row_number() OVER (PARTITION BY fingerprint, run ORDER BY ts, transaction_id) AS occurrences FROM r""",
    ),
)
def _(spark, d):
    code = (F.col("account_id") * 13 + F.col("payee_account_id")) % 997
    novel = V.txn(spark, d).select(
        "transaction_id", F.concat(F.lit("fp"), code.cast("string")).alias("fingerprint"), "ts"
    )
    return X.fingerprint_occurrences(novel, gap_days=1).select(
        "transaction_id", "fingerprint", "occurrences"
    )


@q(
    "w7_running_context",
    with_views(
        "txn",
        f"""SELECT transaction_id, round(coalesce(avg(amount) OVER {_D30.format(end="1 PRECEDING")}, 0.0::DOUBLE), 4) AS avg_amount_30d,
        count(*) OVER {_D1.format(end="1 PRECEDING")} AS daily_txn_count FROM txn""",
    ),
)
def _(spark, d):
    return X.running_context(V.txn(spark, d)).select(
        "transaction_id", F.round("avg_amount_30d", 4).alias("avg_amount_30d"), "daily_txn_count"
    )


@q(
    "w7_running_context_inclusive",
    with_views(
        "txn",
        f"""SELECT transaction_id, round(coalesce(avg(amount) OVER {_D30.format(end="CURRENT ROW")}, 0.0::DOUBLE), 4) AS avg_amount_30d,
        count(*) OVER {_D1.format(end="CURRENT ROW")} AS daily_txn_count FROM txn""",
    ),
)
def _(spark, d):
    return X.running_context(V.txn(spark, d), include_current=True).select(
        "transaction_id", F.round("avg_amount_30d", 4).alias("avg_amount_30d"), "daily_txn_count"
    )


# ── Ordered pages ───────────────────────────────────────────────────────────


@q(
    "o1_novelty_queue",
    with_views(
        "scores",
        """SELECT transaction_id, score % 0.1 > 0.08 AS requires_escalation, scored_at AS created_at FROM scores WHERE action = 'PASS'
        ORDER BY requires_escalation DESC, created_at DESC, transaction_id LIMIT 50""",
    ),
)
def _(spark, d):
    rows = V.scores(spark, d).filter(F.col("action") == "PASS")
    queue = rows.select(
        "transaction_id",
        (F.col("score") % 0.1 > 0.08).alias("requires_escalation"),
        F.col("scored_at").alias("created_at"),
        F.lit("PENDING_REVIEW").alias("status"),
    )
    return queues.novelty_queue(queue).drop("status")


@q(
    "o2_candidate_page",
    with_views(
        "alerts",
        """SELECT alert_id, transaction_id, created_at AS submitted_at, (SELECT count(*) FROM alerts WHERE status = 'CONFIRMED_FRAUD') AS total,
        40 < (SELECT count(*) FROM alerts WHERE status = 'CONFIRMED_FRAUD') AS has_more
        FROM alerts WHERE status = 'CONFIRMED_FRAUD' ORDER BY created_at, transaction_id LIMIT 20 OFFSET 20""",
    ),
)
def _(spark, d):
    candidates = V.alerts(spark, d).select(
        "alert_id", "transaction_id", "status", F.col("created_at").alias("submitted_at")
    )
    return queues.candidate_page(candidates, "CONFIRMED_FRAUD", page=2, per_page=20).drop("status")


@q(
    "o6_recent_shadow",
    with_views(
        "shadow",
        "SELECT transaction_id, final_committee_score FROM shadow ORDER BY scored_at DESC, transaction_id LIMIT 100",
    ),
)
def _(spark, d):
    return queues.recent_shadow(V.shadow(spark, d), 100).select("transaction_id", "final_committee_score")
