"""Aggregates per account: velocity, flows, behaviour, digit law, queue statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import clamp, is_night, leading_digit
from ledgerscope.operators.context import latest_n

WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}


def _since(as_of: Column, text: str, ts: str = "ts") -> Column:
    """Strictly after ``as_of - text`` and not after ``as_of``."""
    at = F.col(ts).cast("timestamp")
    return (at > as_of - F.expr(f"INTERVAL {text}")) & (at <= as_of)


def _count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _sum_if(test: Column, value: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0.0))


def _recent(txn: DataFrame, as_of: Column, text: str, ts: str = "ts") -> DataFrame:
    """Rows of the window only; bounds of the column's own type reach the scan."""
    kind = txn.schema[ts].dataType
    start, end = (as_of - F.expr(f"INTERVAL {text}")).cast(kind), as_of.cast(kind)
    return txn.filter((F.col(ts) > start) & (F.col(ts) <= end))


def _all_accounts(txn: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` for every sender; zero where the window has none of its rows."""
    every = txn.select(F.col("account_id").alias("__every")).distinct()
    joined = every.join(found, every["__every"].eqNullSafe(found["account_id"]), "left")
    return joined.select(
        F.col("__every").alias("account_id"),
        *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in found.dtypes if c != "account_id"],
    )


def velocity(txn: DataFrame, as_of: Column) -> DataFrame:
    """Counts, volumes and distinct payees of each sender in the windows before ``as_of``."""
    hour, day, week = (_since(as_of, w) for w in ("1 HOUR", "24 HOURS", "7 DAYS"))
    found = _recent(txn, as_of, "7 DAYS").groupBy("account_id").agg(
        _count_if(hour).cast("double").alias("txn_count_last_1h"),
        _count_if(day).cast("double").alias("txn_count_last_24h"),
        _count_if(week).cast("double").alias("txn_count_last_7d"),
        _sum_if(hour).alias("txn_volume_last_1h"),
        _sum_if(day).alias("txn_volume_last_24h"),
        F.countDistinct(F.when(day, F.col("payee_account_id"))).cast("double").alias("distinct_payees_24h"),
    )
    return _all_accounts(txn, found)


def account_means(txn: DataFrame, as_of: Column) -> DataFrame:
    found = _recent(txn, as_of, "30 DAYS").groupBy("account_id").agg(
        F.coalesce(F.avg(F.when(_since(as_of, "30 DAYS"), F.col("amount"))), F.lit(0.0)).alias(
            "avg_amount_30d"
        ),
        _count_if(_since(as_of, "24 HOURS")).alias("daily_txn_count"),
    )
    return _all_accounts(txn, found)


def festival_history(txn: DataFrame, as_of: Column) -> DataFrame:
    """More than three small payments in an October or November at least a year ago."""
    at = F.col("ts").cast("timestamp")
    gift = (
        (F.col("amount") < 5_000)
        & F.month("ts").isin(10, 11)
        & (at < as_of - F.expr("INTERVAL 1 YEAR"))
    )
    return txn.groupBy("account_id").agg(
        (_count_if(gift) > 3).alias("has_festival_gifting_history")
    )


def sides(edges: DataFrame) -> DataFrame:
    """Each transfer twice: once for its sender, once for its receiver."""
    both = F.explode(
        F.array(
            F.struct(F.col("src").alias("account_id"), F.lit("out").alias("direction"), F.col("dst").alias("other")),
            F.struct(F.col("dst").alias("account_id"), F.lit("in").alias("direction"), F.col("src").alias("other")),
        )
    )
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(both.alias("__s"), *rest).select("__s.*", *rest)


def window_flows(edges: DataFrame, as_of: Column) -> DataFrame:
    """Money in and out of each account over 1 h, 6 h, 24 h and 7 d, one grouping."""
    at = F.col("ts").cast("timestamp")
    aggregates = []
    for name, hours in WINDOWS.items():
        recent = (at >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (at <= as_of)
        for side in ("in", "out"):
            aggregates.append(
                _sum_if(recent & (F.col("direction") == side)).alias(f"{side}flow_{name}")
            )
    week = at >= as_of - F.expr("INTERVAL 168 HOURS")
    return sides(edges).filter(week).groupBy("account_id").agg(*aggregates)


def days_since(edges: DataFrame, as_of: Column, side: str = "receive") -> DataFrame:
    key = {"receive": "dst", "send": "src"}[side]
    last = edges.groupBy(F.col(key).alias("account_id")).agg(F.max("ts").alias("last"))
    micros = F.unix_micros(as_of) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.select("account_id", (micros / 86_400_000_000.0).alias(f"days_since_last_{side}"))


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours in and out, centrality and fan-out ratio.

    The distinct counts run over (account, neighbour) pairs, so a hub is counted
    by many tasks before its total is formed.
    """
    pairs = sides(edges).select("account_id", "direction", "other").distinct()
    counted = pairs.groupBy("account_id").agg(
        _count_if(F.col("direction") == "in").alias("in_degree"),
        _count_if(F.col("direction") == "out").alias("out_degree"),
    )
    n = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = F.col("in_degree") + F.col("out_degree")
    return counted.select(
        "*",
        F.when(n > 1, total / (n - 1)).otherwise(1.0).alias("degree_centrality"),
        (F.col("out_degree") / F.greatest(F.col("in_degree"), F.lit(1))).alias("fan_out_ratio"),
    )


def sink_scores(degree_rows: DataFrame) -> DataFrame:
    total = F.col("in_degree") + F.col("out_degree")
    sink = F.when(total > 0, F.col("in_degree") / total).otherwise(0.0)
    halved = F.when(F.col("degree_centrality") < 0.01, 1.0).otherwise(0.5)
    return degree_rows.withColumn("sink_score", sink).withColumn(
        "cash_mule_sink_score", F.col("sink_score") * halved
    )


def bipartite_scores(degree_rows: DataFrame) -> DataFrame:
    collector = (F.col("in_degree") > 3) & (F.col("out_degree") <= 2)
    ratio = F.col("in_degree") / F.greatest(F.col("out_degree") * 3, F.lit(1))
    return degree_rows.withColumn(
        "bipartite_score", F.when(collector, F.least(ratio, F.lit(1.0))).otherwise(0.0)
    )


def community_stats(membership: DataFrame, seeds: DataFrame) -> DataFrame:
    """Size and share of known fraud of each community."""
    marked = membership.join(
        seeds.select(F.col("account_id").alias("__seed")).distinct(),
        membership["account_id"] == F.col("__seed"),
        "left",
    )
    return marked.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("community_size"),
        (F.count("__seed") / F.count(F.lit(1))).alias("community_fraud_ratio"),
    )


def account_profile(rows: DataFrame) -> DataFrame:
    """Behaviour of an account over rows with ``direction`` in/out and place columns.

    Night is 22-05 here.  ``balance`` and ``login_attempts`` are used when present.
    """
    night, weekend = is_night(F.col("ts"), 22, 5), F.weekday("ts") >= 5
    aggregates = [
        F.count(F.lit(1)).alias("txn_count_all"),
        F.avg("amount").alias("avg_amount"),
        F.stddev_samp("amount").alias("std_amount"),
        _sum_if(F.col("direction") == "out").alias("total_out"),
        _sum_if(F.col("direction") == "in").alias("total_in"),
        (_count_if(night) / F.count(F.lit(1))).alias("night_txn_ratio"),
        (_count_if(weekend) / F.count(F.lit(1))).alias("weekend_txn_ratio"),
    ]
    if "balance" in rows.columns:
        aggregates.append(F.min("balance").alias("min_balance"))
    if "login_attempts" in rows.columns:
        aggregates.append(F.max("login_attempts").alias("max_login_attempts"))
    out = rows.groupBy("account_id").agg(*aggregates)
    # Distinct pairs first: each shuffled row is one account and value, whatever it occurs.
    places = {"location": "n_locations", "device_id": "n_devices", "merchant_id": "n_merchants"}
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in places])
    pairs = rows.select(F.col("account_id").alias("__a"), F.explode(values).alias("v")).select("__a", "v.*")
    distinct = pairs.filter("value IS NOT NULL").distinct().groupBy("__a").agg(
        *[_count_if(F.col("kind") == c).alias(name) for c, name in places.items()]
    )
    out = out.join(distinct, out["account_id"].eqNullSafe(distinct["__a"]), "left").drop("__a")
    out = out.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in places.values()})
    out = (
        out.withColumn(
            "return_ratio", F.col("total_in") / (F.col("total_out") + F.col("total_in") + 1e-6)
        )
        .withColumn(
            "geography_switch",
            F.least(F.greatest(F.col("n_locations") - 1, F.lit(0)), F.lit(1)).cast("double"),
        )
        .withColumn("counterparty_novelty", F.col("n_merchants") / F.col("txn_count_all"))
    )
    if "balance" in rows.columns:
        out = out.withColumn("sink_score", clamp(1.0 - F.col("min_balance") / (F.col("total_in") + 1.0)))
    if "login_attempts" in rows.columns:
        out = out.withColumn("channel_switch", clamp((F.col("max_login_attempts") - 1) / 4.0))
    return out


def channel_entropy(txn: DataFrame) -> DataFrame:
    counts = txn.groupBy("account_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    # Totals come from the small (account, channel) counts, not from the rows.
    totals = counts.groupBy("account_id").agg(
        F.sum("n").alias("total"), F.collect_list("n").alias("parts")
    )
    share = F.transform("parts", lambda n: n / F.col("total"))
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p + 1e-9))
    return totals.select("account_id", entropy.alias("channel_entropy"))


def account_activity(txn: DataFrame, as_of: Column) -> DataFrame:
    """History counts and how far the newest payment departs from habit.

    ``amount_zscore``: newest amount against the account's mean and deviation.
    ``hour_deviation``: newest hour against mid-afternoon, |hour - 14| / 10.
    ``dormancy_break``: active in the last 30 days after none in the 60 before.
    """
    month = _since(as_of, "30 DAYS")
    quarter = _since(as_of, "90 DAYS")
    rows = txn.filter(F.col("ts").cast("timestamp") <= as_of)
    newest = F.struct("ts", "transaction_id")
    out = rows.groupBy("account_id").agg(
        _count_if(month).alias("txn_count_30d"),
        _count_if(quarter).alias("txn_count_90d"),
        F.count(F.lit(1)).alias("txn_count_all"),
        F.coalesce(F.avg(F.when(month, F.col("amount"))), F.lit(0.0)).alias("avg_txn_amount_30d"),
        F.countDistinct(F.when(month, F.col("payee_account_id"))).alias("distinct_counterparties_30d"),
        F.avg("amount").alias("__mean"),
        F.stddev_samp("amount").alias("__std"),
        F.max_by("amount", newest).alias("__last_amount"),
        F.max_by(F.hour("ts"), newest).alias("__last_hour"),
    )
    spread = F.coalesce(F.col("__std"), F.lit(0.0))
    zscore = F.when(spread < 1e-9, 0.0).otherwise(
        F.abs(F.col("__last_amount") - F.col("__mean")) / spread
    )
    woke = (
        (F.col("txn_count_30d") > 0)
        & (F.col("txn_count_90d") == F.col("txn_count_30d"))
        & (F.col("txn_count_all") > F.col("txn_count_90d"))
    )
    return (
        out.withColumn("amount_zscore", zscore)
        .withColumn("hour_deviation", F.abs(F.col("__last_hour") - 14.0) / 10.0)
        .withColumn("dormancy_break", F.when(woke, 1.0).otherwise(0.0))
        .drop("__mean", "__std", "__last_amount", "__last_hour")
    )


def burst_and_velocity_ratio(txn: DataFrame, as_of: Column) -> DataFrame:
    """Hourly rate of the last 6 hours over that of the last 4 weeks."""
    found = _recent(txn, as_of, "28 DAYS").groupBy("account_id").agg(
        _count_if(_since(as_of, "6 HOURS")).alias("__recent"), F.count(F.lit(1)).alias("__base")
    )
    counted = _all_accounts(txn, found)
    rate = (F.col("__recent") / 6.0) / F.greatest(F.col("__base") / (28.0 * 24.0), F.lit(0.01))
    return counted.select(
        "account_id",
        clamp(rate / 50.0).alias("burst_score"),
        clamp(rate / 10.0, 0.0, 30.0).alias("velocity_ratio"),
        clamp(rate / 10.0, 0.0, 30.0).alias("temporal_acceleration"),
    )


def set_features(txn: DataFrame, as_of: Column, min_rows: int = 5) -> DataFrame:
    """Seven 90-day shares and flags; all null with fewer than five payments."""
    hour, amount = F.hour("ts"), F.col("amount")
    night = (hour < 6) | (hour >= 22)
    age = (
        F.unix_micros(F.col("ts").cast("timestamp"))
        - F.unix_micros(F.col("payee_vpa_created_at").cast("timestamp"))
    ) / 86_400_000_000.0
    new_vpa = F.coalesce(age < 7, F.lit(False))
    high = amount > 100_000
    kinds = ["night", "high", "new_vpa"]
    kind = F.when(night, "night").when(high, "high").when(new_vpa, "new_vpa")
    rounded = (F.round(amount, 0).cast("long") % 1000 == 0) & (amount > 10_000)
    counted = (
        txn.filter(_since(as_of, "90 DAYS"))
        .groupBy("account_id")
        .agg(
            _count_if(night).alias("__night"),
            _count_if(new_vpa).alias("__vpa"),
            _count_if(high).alias("__high"),
            F.countDistinct("channel").alias("__channels"),
            _count_if(amount < 1).alias("__micro"),
            _count_if(rounded).alias("__round"),
            *[F.max((kind == k).cast("int")).alias(f"__is_{k}") for k in kinds],
            F.count(F.lit(1)).alias("__n"),
        )
    )
    n = F.col("__n")
    values = {
        "count_of_night_txns": F.col("__night") / n,
        "count_of_new_vpa_txns": F.col("__vpa") / n,
        "count_of_high_amount_txns": F.col("__high") / n,
        "count_of_channel_switches": (F.least(F.col("__channels"), F.lit(5)) - 1) / 4.0,
        "has_any_micro_test_payment": (F.col("__micro") > 0).cast("double"),
        "has_any_round_amount_burst": (F.col("__round") > 0).cast("double"),
        "distinct_fraud_proximate_action_types": reduce(lambda a, b: a + b, [F.coalesce(f"__is_{k}", F.lit(0)) for k in kinds]) / 3.0,
    }
    enough = n >= min_rows
    return counted.select("account_id", *[F.when(enough, v).alias(k) for k, v in values.items()])


def benford_deviation(txn: DataFrame, as_of: Column, rows: int = 200, min_rows: int = 20) -> DataFrame:
    """Distance of leading digits from the logarithmic law over the newest 200 amounts."""
    recent = txn.filter(_since(as_of, "90 DAYS") & (F.col("amount") > 0))
    digits = latest_n(recent, "account_id", rows).withColumn("__d", leading_digit(F.col("amount")))
    counted = digits.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count("__d").alias("__n"),
        *[_count_if(F.col("__d") == d).alias(f"__d{d}") for d in range(1, 10)],
    )
    gaps = [F.abs(F.col(f"__d{d}") / F.col("__n") - math.log10(1 + 1 / d)) for d in range(1, 10)]
    distance = F.least(reduce(lambda a, b: a + b, gaps) / 2.0, F.lit(1.0))
    usable = (F.col("__rows") >= min_rows) & (F.col("__n") > 0)
    return counted.select("account_id", F.when(usable, distance).alias("benford_deviation"))


def fan_in_zscore(txn: DataFrame, as_of: Column) -> DataFrame:
    """Senders of the last day against the account's usual daily number of senders."""
    incoming = txn.filter(F.col("payee_account_id").isNotNull() & _since(as_of, "90 DAYS"))
    daily = (
        incoming.groupBy("payee_account_id", F.to_date("ts").alias("day"))
        .agg(F.countDistinct("account_id").alias("senders"))
        .groupBy("payee_account_id")
        .agg(F.avg("senders").alias("__avg"), F.stddev_samp("senders").alias("__std"))
    )
    today = (
        incoming.filter(_since(as_of, "24 HOURS"))
        .groupBy("payee_account_id")
        .agg(F.countDistinct("account_id").alias("__today"))
    )
    joined = daily.join(today, "payee_account_id", "left")
    zscore = (F.coalesce("__today", F.lit(0)) - F.col("__avg")) / F.col("__std")
    return joined.select(
        F.col("payee_account_id").alias("account_id"),
        F.when(F.col("__std") > 0, F.bround(zscore, 3)).alias("fan_in_sender_zscore"),
    )


def novelty_stats(queue: DataFrame, as_of: Column) -> DataFrame:
    return queue.agg(
        _count_if(F.col("status") == "PENDING_REVIEW").alias("pending"),
        _count_if(F.col("requires_escalation")).alias("escalated"),
        _count_if(F.col("status") == "REVIEWED_NEW_FRAUD").alias("confirmed_new_patterns"),
        _count_if(_since(as_of, "24 HOURS", "created_at")).alias("last_24h"),
        F.round(F.avg("anomaly_score"), 4).alias("avg_anomaly_score"),
        F.count(F.lit(1)).alias("total"),
    )


def queue_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def action_counts(scores: DataFrame) -> DataFrame:
    """Scores per action, gate and latency bucket (upper bound in ms, null above the last)."""
    bucket = F.lit(None).cast("int")
    for limit in reversed(C.LATENCY_BUCKETS_MS):
        bucket = F.when(F.col("processing_ms") <= limit, F.lit(limit)).otherwise(bucket)
    return scores.groupBy(
        "action", F.coalesce("gate_fired", F.lit("none")).alias("gate_fired"), bucket.alias("latency_ms_le")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_weights(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Positives, negatives and the weight given to a positive row (at least 1)."""
    counted = labelled.agg(
        _count_if(F.col(label) == 1).alias("positives"),
        _count_if(F.col(label) != 1).alias("negatives"),
    )
    ratio = F.when(F.col("positives") > 0, F.floor(F.col("negatives") / F.col("positives")))
    return counted.withColumn("positive_weight", F.greatest(ratio, F.lit(1)).cast("long"))


def archetype_breakdown(scored: DataFrame, archetype: str = "archetype", score: str = "score") -> DataFrame:
    return scored.groupBy(archetype).agg(
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n")
    )


def graph_stats(vertices: DataFrame, edges: DataFrame, devices: DataFrame, vpas: DataFrame) -> DataFrame:
    """Row counts of the four graph tables, one row."""
    tables = {"accounts": vertices, "sent": edges, "uses": devices, "vpas": vpas}
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in tables])


def inflow_retention(edges: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Money received in the window and the share of it that stayed."""
    recent = edges.filter(_since(as_of, f"{days} DAYS"))
    flows = sides(recent).groupBy("account_id").agg(
        _sum_if(F.col("direction") == "in").alias("inflow_last_30d"),
        _sum_if(F.col("direction") == "out").alias("outflow_last_30d"),
    )
    kept = F.greatest(1.0 - F.col("outflow_last_30d") / F.col("inflow_last_30d"), F.lit(0.0))
    return flows.withColumn(
        "retention_ratio", F.when(F.col("inflow_last_30d") > 0, kept).otherwise(0.0)
    )


def trail_summary(trails: DataFrame, key: str = "alert_id") -> DataFrame:
    """Accounts, longest path, money on first hops, start and end of the trails of an alert.

    ``trails`` has ``nodes``, ``amounts``, ``times`` and ``hops``; at most the kept
    paths of a seed reach one group.
    """
    totals = trails.groupBy(key).agg(
        F.count(F.lit(1)).alias("paths"),
        F.max("hops").alias("longest_hops"),
        F.sum(F.element_at("amounts", 1)).alias("first_hop_amount"),
        F.min(F.array_min("times")).alias("trail_start"),
        F.max(F.array_max("times")).alias("trail_end"),
    )
    accounts = (
        trails.select(key, F.explode("nodes").alias("__n"))
        .groupBy(key)
        .agg(F.countDistinct("__n").alias("accounts_involved"))
    )
    return totals.join(accounts, key)
