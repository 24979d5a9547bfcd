"""Joins that give a payment its context, and per-key sliding measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.scale import as_of_join, micros, top_per_key, trailing_stats

HOUR, DAY = 3_600, 86_400


def with_account_context(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sender attributes; an unknown sender is a savings account of age 0."""
    sender = accounts.select(
        F.col("id").alias("__id"), "account_type", "kyc_occupation", "kyc_age", "account_age_days"
    )
    joined = txn.join(sender, txn["account_id"] == sender["__id"], "left")
    return (
        joined.withColumn(
            "account_type", F.when(F.col("__id").isNull(), "SAVINGS").otherwise(F.col("account_type"))
        )
        .withColumn("account_age_days", F.coalesce("account_age_days", F.lit(0)))
        .drop("__id")
    )


def with_account_versions(
    txn: DataFrame, versions: DataFrame, take: list[str], key: str = "account_id", valid_until: str | None = None
) -> DataFrame:
    """Account attributes as they were when each payment was made.

    ``versions``: ``(id, valid_from, ...)``, one row per change of an account.
    """
    named = versions.withColumnRenamed("id", key)
    return as_of_join(txn, named, key, "ts", "valid_from", take, valid_until)


def with_payee_age(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    payee = accounts.select(
        F.col("id").alias("__id"), F.col("account_age_days").alias("payee_account_age_days")
    )
    return txn.join(payee, txn["payee_account_id"] == payee["__id"], "left").drop("__id")


def with_known_contact(
    txn: DataFrame, include_current: bool = False, history: DataFrame | None = None
) -> DataFrame:
    """Whether the sender had paid this payee before, by ``history`` (default: ``txn``).

    One minimum per pair, joined back: the pair list is combined map-side, and a
    hot pair is one row on the small side of the join.
    """
    first = (txn if history is None else history).filter(F.col("payee_account_id").isNotNull()).groupBy(
        F.col("account_id").alias("__a"), F.col("payee_account_id").alias("__p")
    ).agg(F.min("ts").alias("__first"))
    joined = txn.join(
        first,
        (txn["account_id"] == first["__a"]) & (txn["payee_account_id"] == first["__p"]),
        "left",
    )
    earlier = F.col("__first") <= F.col("ts") if include_current else F.col("__first") < F.col("ts")
    return joined.withColumn(
        "payee_in_known_contacts", F.coalesce(earlier, F.lit(False))
    ).drop("__a", "__p", "__first")


def with_payee_alert_history(txn: DataFrame, alerts: DataFrame, history: DataFrame) -> DataFrame:
    """Number of alerts on payments the payee sent."""
    senders = history.select("transaction_id", F.col("account_id").alias("__payee"))
    counted = (
        alerts.select("transaction_id")
        .join(senders, "transaction_id")
        .groupBy("__payee")
        .agg(F.count(F.lit(1)).alias("__alerts"))
    )
    joined = txn.join(counted, txn["payee_account_id"] == counted["__payee"], "left")
    count = F.coalesce(F.col("__alerts"), F.lit(0)).cast("double")
    return (
        joined.withColumn("payee_shared_alert_count", count)
        .withColumn("payee_in_alert_log", F.when(count > 0, 1.0).otherwise(0.0))
        .drop("__payee", "__alerts")
    )


def fraud_accounts(alerts: DataFrame, txn: DataFrame, rule: str = "action") -> DataFrame:
    """Senders of alerted payments, by action taken or by the investigator's decision."""
    if rule == "action":
        chosen = alerts.filter(F.col("action").isin("HIGH_RISK", "REVIEW"))
    elif rule == "decision":
        chosen = alerts.filter(F.col("investigator_decision"))
    else:
        raise ValueError("rule must be 'action' or 'decision'")
    return (
        txn.join(chosen.select("transaction_id"), "transaction_id", "left_semi")
        .select("account_id")
        .distinct()
    )


def clean_accounts(accounts: DataFrame, fraud: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` accounts outside the fraud set, drawn by a seeded hash of the id."""
    rest = accounts.select(F.col("id").alias("account_id")).join(fraud, "account_id", "left_anti")
    hashed = rest.withColumn("__h", F.xxhash64("account_id", F.lit(seed))).withColumn("__b", F.shiftright("__h", 48))
    # The order of the hash by its highest bits: at most 2^16 counts, then one bucket is ranked.
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    taken = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter(F.col("__before") < n)
    placed = hashed.join(F.broadcast(taken), "__b")
    whole = placed.filter(F.col("__before") + F.col("__n") <= n)
    nth = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "account_id"))
    last = placed.filter(F.col("__before") + F.col("__n") > n).withColumn("__nth", nth).filter(F.col("__before") + F.col("__nth") <= n)
    return whole.select("account_id").unionByName(last.select("account_id"))


def legit_training_accounts(
    features: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 48
) -> DataFrame:
    """Accounts with fresh features and no confirmed fraud."""
    confirmed = alerts.filter(F.col("status") == "CONFIRMED_FRAUD").select("account_id")
    fresh = features.filter(
        F.col("computed_at").cast("timestamp") > as_of - F.expr(f"INTERVAL {hours} HOURS")
    )
    return fresh.join(confirmed, "account_id", "left_anti")


def latest_committee(alerts: DataFrame, shadow: DataFrame) -> DataFrame:
    """Newest committee row per alert."""
    joined = alerts.join(shadow, "transaction_id")
    return latest_per_key(joined, "alert_id", "scored_at")


def sanctions_match(txn: DataFrame, lists: DataFrame) -> DataFrame:
    """Senders on a list: by id or by upper-cased name, the highest-priority list first.

    ``lists`` has ``(list_name, entry)``.  Within one list an id match comes first.
    """
    priority = F.create_map(*[F.lit(x) for pair in C.SANCTIONS_PRIORITY.items() for x in pair])
    entries = lists.select("list_name", F.col("entry").alias("__entry")).distinct()
    ids = (
        txn.select("transaction_id", F.col("account_id").cast("string").alias("__entry"))
        .join(entries, "__entry")
        .withColumn("matched", F.lit("account_id"))
    )
    names = (
        txn.select("transaction_id", F.upper("holder_name").alias("__entry"))
        .join(entries, "__entry")
        .withColumn("matched", F.lit("name"))
    )
    return (
        ids.unionByName(names)
        .groupBy("transaction_id")
        .agg(
            F.min(
                F.struct(F.try_element_at(priority, F.col("list_name")), "matched", "list_name")
            ).alias("__best")
        )
        .select("transaction_id", "__best.list_name", "__best.matched")
    )


def kyc_related(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (a, b) with a declared relation in either direction."""
    canonical = relations.select(
        F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")
    ).distinct()
    return pairs.join(
        canonical,
        (F.least(pairs["a"], pairs["b"]) == canonical["__lo"])
        & (F.greatest(pairs["a"], pairs["b"]) == canonical["__hi"]),
        "left_semi",
    )


def drop_reviewed_benign(novel: DataFrame, registry: DataFrame) -> DataFrame:
    benign = registry.filter(F.col("label") == 0).select("fingerprint")
    return novel.join(benign, "fingerprint", "left_anti")


def prefer_embedding(primary: DataFrame, fallback: DataFrame, dim: int) -> DataFrame:
    """The primary vector where it exists, else the fallback; a wrong length is missing.

    A primary vector of the wrong length does not fall back.
    """
    p = primary.select("account_id", F.col("embedding").alias("__p"))
    f = fallback.select("account_id", F.col("embedding").alias("__f"))
    joined = p.join(f, "account_id", "full")
    chosen = F.coalesce("__p", "__f")
    fits = F.coalesce(F.size(chosen) == dim, F.lit(False))
    return joined.select(
        "account_id",
        F.when(fits, chosen).alias("embedding"),
        F.when(F.col("__p").isNotNull(), "primary").otherwise("fallback").alias("embedding_source"),
        (~fits).alias("missing_flag"),
    )


def scores_with_labels(shadow: DataFrame, curated: DataFrame) -> DataFrame:
    """Committee rows joined with the newest curated label of their payment."""
    newest = curated.groupBy("transaction_id").agg(F.max_by("label", "created_at").alias("label"))
    return shadow.join(newest, "transaction_id")


# ── Sliding measures ────────────────────────────────────────────────────────


def sliding_velocity(txn: DataFrame, include_current: bool = False) -> DataFrame:
    """Earlier payments of the account in the last hour and the last day."""
    return trailing_stats(
        txn,
        "account_id",
        "ts",
        {"velocity_1h": (HOUR, "count", None), "velocity_24h": (DAY, "count", None)},
        include_current,
    )


def sliding_volume(txn: DataFrame, include_current: bool = False) -> DataFrame:
    return trailing_stats(
        txn, "account_id", "ts", {"volume_1h": (HOUR, "sum", "amount")}, include_current
    )


def running_context(txn: DataFrame, include_current: bool = False) -> DataFrame:
    """Mean of the last 30 days and count of the last day, as known at each payment."""
    return trailing_stats(
        txn,
        "account_id",
        "ts",
        {
            "avg_amount_30d": (30 * DAY, "avg", "amount"),
            "daily_txn_count": (DAY, "count", None),
        },
        include_current,
    )


def point_in_time(txn: DataFrame, include_current: bool = False) -> DataFrame:
    """Velocity, volume and running context in one pass: one shuffle by account."""
    return trailing_stats(
        txn,
        "account_id",
        "ts",
        {
            "velocity_1h": (HOUR, "count", None),
            "velocity_24h": (DAY, "count", None),
            "volume_1h": (HOUR, "sum", "amount"),
            "avg_amount_30d": (30 * DAY, "avg", "amount"),
            "daily_txn_count": (DAY, "count", None),
        },
        include_current,
    )


def burst_window(
    edges: DataFrame, key: str = "graph_id", n: int = 3, seconds: int = 1_800
) -> DataFrame:
    """Keys with ``n`` transfers inside ``seconds``, and where the first such run starts.

    Time is cut into overlapping double windows, so a busy key is spread over many
    tasks: any run that fits the span lies wholly inside one of them.
    """
    span = seconds * 1_000_000
    at = edges.select(key, micros("ts").alias("__us"))
    slot = F.floor(F.col("__us") / span)
    windows = at.withColumn("__w", F.explode(F.array(slot, slot - 1)))
    order = Window.partitionBy(key, "__w").orderBy("__us")
    runs = windows.withColumn("__start", F.lag("__us", n - 1).over(order))
    hits = runs.filter(F.col("__us") - F.col("__start") <= span)
    first = hits.groupBy(key).agg(F.min(F.struct("__start", "__us")).alias("__first"))
    return first.select(
        key,
        F.timestamp_micros("__first.__start").cast("timestamp_ntz").alias("burst_start"),
        ((F.col("__first.__us") - F.col("__first.__start")) / 1_000_000.0).alias("burst_seconds"),
    )


def latest_n(txn: DataFrame, key: str, n: int, ts: str = "ts", row_id: str = "transaction_id") -> DataFrame:
    return top_per_key(txn, [key], [F.desc(ts), F.asc(row_id)], n)


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest row per key; ties by the remaining columns in name order."""
    ties = [F.asc(c) for c, kind in sorted(df.dtypes) if c not in (key, ts) and "map<" not in kind]
    return top_per_key(df, [key], [F.desc(ts), *ties], 1)


def fingerprint_occurrences(
    novel: DataFrame, gap_days: int = C.FINGERPRINT_GAP_DAYS, bucket_seconds: int = 60
) -> DataFrame:
    """Running count of a fingerprint within a run whose gaps stay under ``gap_days``.

    A counter whose expiry is renewed on each hit is a session.  Minutes are
    summarised first; session ids and prefix counts are found on the summaries, and
    only rows of one fingerprint and one minute share a window.
    """
    gap = gap_days * 86_400 * 1_000_000
    base = novel.withColumn("__us", micros("ts")).withColumn(
        "__b", F.floor(F.col("__us") / (bucket_seconds * 1_000_000))
    )
    minutes = base.groupBy("fingerprint", "__b").agg(
        F.min("__us").alias("__lo"), F.max("__us").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    order = Window.partitionBy("fingerprint").orderBy("__b")
    # The gap to the last hit of the minute before decides whether a new run starts.
    started = F.coalesce((F.col("__lo") - F.lag("__hi").over(order) >= gap), F.lit(True))
    runs = minutes.withColumn("__new", started.cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(order))
    within = (
        Window.partitionBy("fingerprint", "__run")
        .orderBy("__b")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.select(
        F.col("fingerprint").alias("__fp"),
        F.col("__b").alias("__rb"),
        F.col("__run").alias("run_id"),
        F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("fingerprint", "__b").orderBy("__us", "transaction_id")
    ranked = base.withColumn("__rn", F.row_number().over(inside))
    joined = ranked.join(
        runs, (ranked["fingerprint"] == runs["__fp"]) & (ranked["__b"] == runs["__rb"])
    )
    return joined.withColumn(
        "occurrences", (F.col("__before") + F.col("__rn")).cast("long")
    ).drop("__us", "__b", "__fp", "__rb", "__before", "__rn")
