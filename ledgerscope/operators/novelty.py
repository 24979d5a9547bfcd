"""Novelty discovery over cleared payments, and drift of the score distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.text import fingerprint
from ledgerscope.operators.context import drop_reviewed_benign, fingerprint_occurrences
from ledgerscope.operators.models import predict, train_base
from ledgerscope.scale import cut_lineage, exact_quantiles, prefix_sums, top_per_key


def pass_stream(scores: DataFrame, log: float = C.THRESHOLD_LOG) -> DataFrame:
    """Only payments that were cleared are looked at."""
    return scores.filter(F.col("score") < log)


# ── Isolation forest ────────────────────────────────────────────────────────

TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def standardise(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation by the reference rows; null reads as 0."""
    base = (df if reference is None else reference).fillna(0.0, columns)
    stats = base.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    filled = df.fillna(0.0, columns)
    return filled.select(
        *[c for c in df.columns if c not in columns],
        *[
            ((F.nanvl(F.col(c), F.lit(0.0)) - float(stats[f"m_{c}"] or 0.0)) / (float(stats[f"s_{c}"] or 0.0) or 1.0)).alias(c)
            for c in columns
        ],
    )


def train_isolation_forest(
    df: DataFrame, columns: list[str], key: str, trees: int = 200, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Trees as a table.  Each tree grows on 256 rows drawn by a hash of (row, tree, seed).

    One hash per row first picks a pool about as large as all samples together, so
    the rows are not multiplied by the trees; each tree then takes the rows of the
    pool whose hash for it is smallest, limited map-side.
    """
    n = df.count()
    scale = float(1 << 40)

    def draw(*parts) -> Column:
        return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 40)) / scale

    pool_share = min(1.0, 2.0 * sample * max(trees, 4) / max(n, 1))
    pool = df.select(F.col(key), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    pool = pool.filter(draw(F.col(key), F.lit(-1)) <= pool_share)
    tree_share = min(1.0, 4.0 * sample / max(n * pool_share, 1.0))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("__u", draw(F.col(key), F.col("tree"))).filter(F.col("__u") <= tree_share)
    chosen = top_per_key(drawn, ["tree"], [F.asc("__u"), F.asc(key)], sample).select("tree", "x", "__u")
    return cut_lineage(chosen.groupBy("tree").applyInPandas(_grower(sample, seed), TREE_SCHEMA))


def _grower(sample: int, seed: int):
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("__u")
        data = np.array(ordered["x"].tolist())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(min(sample, len(data)), 2)))
        nodes: list[list] = []

        def add(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(rows)])
            spread = np.nonzero(rows.max(axis=0) > rows.min(axis=0))[0] if len(rows) else []
            if depth >= limit or len(rows) <= 1 or len(spread) == 0:
                return me
            feature = int(rng.choice(spread))
            low, high = rows[:, feature].min(), rows[:, feature].max()
            cut = float(rng.uniform(low, high))
            below = rows[:, feature] <= cut
            nodes[me][2:6] = [feature, cut, add(rows[below], depth + 1), add(rows[~below], depth + 1)]
            return me

        add(data, 0)
        names = ["tree", "node", "feature", "threshold", "left", "right", "size"]
        return pd.DataFrame(nodes, columns=names)

    return grow


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def score_isolation(
    df: DataFrame,
    columns: list[str],
    trees: DataFrame,
    sample: int = 256,
    reference: DataFrame | None = None,
    contamination: float = C.CONTAMINATION,
    threshold: float = C.NOVELTY_THRESHOLD,
) -> DataFrame:
    """Anomaly score (more negative is stranger) and the novelty mark.

    The offset is the contamination quantile over the reference rows.  The forest
    has at most trees x 2 x sample nodes whatever the data, so it is sent along.
    """
    forest = trees.toPandas()
    # Scored once and stored: the quantile and the result both read it.
    raw = cut_lineage(_isolation_raw(df, columns, forest, sample))
    base = raw if reference is None else cut_lineage(_isolation_raw(reference, columns, forest, sample))
    long = base.select(F.lit("all").alias("f"), F.col("__raw").alias("v"))
    offset = float(exact_quantiles(long, "f", "v", [contamination]).first()["quantile"])
    return (
        raw.withColumn("anomaly_score", F.col("__raw") - offset)
        .withColumn("is_novel", F.coalesce(F.col("anomaly_score") < threshold, F.lit(False)))
        .drop("__raw")
    )


def _isolation_raw(df: DataFrame, columns: list[str], forest: pd.DataFrame, sample: int) -> DataFrame:
    tables = [
        g.sort_values("node")[["feature", "threshold", "left", "right", "size"]].to_numpy()
        for _, g in forest.sort_values("tree").groupby("tree")
    ]

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        data = np.array(x.tolist(), dtype=float).reshape(len(x), -1)
        depth = np.zeros(len(data))
        used = []
        for t in tables:
            feature, cut, left, right, size = (t[:, i] for i in range(5))
            at = np.zeros(len(data), dtype=int)
            steps = np.zeros(len(data))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.nonzero(inner)[0]
                node = at[rows]
                goes = data[rows, feature[node].astype(int)] <= cut[node]
                at[rows] = np.where(goes, left[node], right[node]).astype(int)
                steps[rows] += 1
            depth += steps + _mean_path(size[at])
            used.append(size[0])
        norm = _mean_path(np.array([np.mean(used)]))[0] or 1.0
        return pd.Series(-np.power(2.0, -depth / len(tables) / norm))

    return df.withColumn("__raw", score(F.array(*[F.col(c).cast("double") for c in columns])))


# ── Tail probabilities ──────────────────────────────────────────────────────


def unpivot(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long form ``(key, feature, value)``; null and NaN read as 0."""
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"))
        for c in columns
    ]
    return df.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")


def ecdf(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of rows at or below, and at or above, each distinct value of each column.

    Equal values are counted before anything is ordered, and the running totals go
    through range buckets: no column passes through one task.
    """
    counted = unpivot(df, key, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    running = prefix_sums(counted, "value", ["n"], by="feature")
    return running.select(
        "feature",
        "value",
        (F.col("cum_n") / F.col("tot_n")).alias("left_tail"),
        ((F.col("tot_n") - F.col("cum_n") + F.col("n")) / F.col("tot_n")).alias("right_tail"),
    )


def ecod(df: DataFrame, key: str, columns: list[str], percentile: float = 0.97) -> DataFrame:
    """Outlier score from empirical tails, and a mark above the 97th percentile.

    Three sums of -log tail probability: left tails, right tails, and per column the
    tail its skewness points to; the score is the largest.
    """
    filled = df.fillna(0.0, columns)
    skews = filled.agg(*[F.skewness(c).alias(c) for c in columns]).first()
    left_side = [c for c in columns if (skews[c] or 0.0) < 0]
    tails = ecdf(filled, key, columns)
    rows = unpivot(filled, key, columns).join(tails, ["feature", "value"])
    # Per column: the left tail when skewed to the left, else the right tail.
    picked = F.when(F.col("feature").isin(left_side), F.col("left_tail")).otherwise(F.col("right_tail"))
    sums = rows.groupBy(key).agg(
        F.sum(-F.log("left_tail")).alias("__l"),
        F.sum(-F.log("right_tail")).alias("__r"),
        F.sum(-F.log(picked)).alias("__s"),
    )
    scored = sums.select(key, F.greatest("__l", "__r", "__s").alias("ecod_score"))
    scored = cut_lineage(scored)
    long = scored.select(F.lit("all").alias("f"), F.col("ecod_score").alias("v"))
    cut = float(exact_quantiles(long, "f", "v", [percentile]).first()["quantile"])
    return scored.withColumn("is_outlier", F.col("ecod_score") > cut)


def boosted_outlier(
    df: DataFrame, key: str, columns: list[str], label: str = "label", trees: int = 100, rounds: int = 50, seed: int = 42
) -> DataFrame:
    """Boosted trees over the columns and two unsupervised scores; novelty queue only."""
    scaled = standardise(df, columns)
    forest = train_isolation_forest(scaled, columns, key, trees=trees, seed=seed)
    with_iso = score_isolation(scaled, columns, forest).drop("is_novel")
    with_both = cut_lineage(with_iso.join(ecod(df, key, columns).drop("is_outlier"), key))
    features = [*columns, "anomaly_score", "ecod_score"]
    model = train_base(with_both, features, label, depth=4, rounds=rounds, seed=seed)
    return predict(model, with_both, features, "outlier_score").select(
        key, "anomaly_score", "ecod_score", "outlier_score"
    )


# ── Routing ─────────────────────────────────────────────────────────────────


def route_discovery(
    novel: DataFrame,
    registry: DataFrame,
    log: float = C.THRESHOLD_LOG,
    escalate_at: int = C.ESCALATION_OCCURRENCES,
    gap_days: int = C.FINGERPRINT_GAP_DAYS,
) -> DataFrame:
    """Queue rows of novel cleared payments.

    ``novel``: ``transaction_id, account_id, ts, anomaly_score, score, action,
    gate_fired, features``.  Every hit counts for its fingerprint, reviewed or not;
    fingerprints reviewed as benign are then left out.
    """
    cleared = pass_stream(novel, log)
    one = cleared.dropDuplicates(["transaction_id"])
    counted = fingerprint_occurrences(one.withColumn("fingerprint", fingerprint(F.col("features"))), gap_days)
    kept = drop_reviewed_benign(counted, registry)
    return kept.select(
        "transaction_id",
        "account_id",
        "anomaly_score",
        F.col("score").alias("fraud_score"),
        F.col("action").alias("fraud_action"),
        "gate_fired",
        F.col("fingerprint").alias("novelty_fingerprint"),
        F.substring("fingerprint", 1, 16).alias("fingerprint_prefix"),
        F.col("occurrences").alias("fingerprint_occurrences"),
        (F.col("occurrences") >= escalate_at).alias("requires_escalation"),
        F.lit("PENDING_REVIEW").alias("status"),
        F.col("ts").alias("created_at"),
    )


def escalation_events(queue: DataFrame) -> DataFrame:
    return queue.filter("requires_escalation").select(
        F.lit("structural_novelty").alias("pattern_type"),
        F.col("fingerprint_prefix").alias("novelty_fingerprint"),
        F.col("fingerprint_occurrences").alias("occurrences_in_7d"),
        F.col("transaction_id").alias("sample_transaction_id"),
        F.bround("anomaly_score", 4).alias("anomaly_score"),
        F.bround("fraud_score", 4).alias("fraud_score_at_detection"),
        F.lit(True).alias("evaded_detection"),
        F.col("created_at").alias("ts"),
    )


def confirmed_events(feedback: DataFrame, features: DataFrame) -> DataFrame:
    """Confirmed alerts with four graph features and the density of their account."""
    chosen = ["pagerank_fraud_seeded", "community_fraud_ratio", "cycle_membership", "sink_score"]
    confirmed = feedback.filter("confirmed_fraud")
    joined = confirmed.join(features.select("account_id", *chosen, "bipartite_score"), "account_id", "left")
    return joined.select(
        "alert_id",
        "transaction_id",
        "fraud_type",
        F.coalesce("bipartite_score", F.lit(0.0)).alias("density_override"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in chosen],
    )


def review_update(queue: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue after the reviews, and the reviews that could not be applied with the reason.

    Of several valid reviews of one row the newest counts.
    """
    allowed = F.coalesce(F.col("status").isin(C.REVIEW_STATUSES), F.lit(False))
    known = queue.select("transaction_id").withColumn("__known", F.lit(True))
    judged = reviews.join(known, "transaction_id", "left").withColumn(
        "reason",
        F.when(~allowed, "status not allowed").when(F.col("__known").isNull(), "not found"),
    ).drop("__known")
    rejected = judged.filter(F.col("reason").isNotNull())
    newest = judged.filter(F.col("reason").isNull()).groupBy("transaction_id").agg(
        F.max_by(F.struct("status", "developer_notes", "reviewed_at"), "reviewed_at").alias("__r")
    )
    updated = queue.join(newest, "transaction_id", "left").select(
        *[c for c in queue.columns if c not in ("status", "developer_notes", "reviewed_at")],
        F.coalesce("__r.status", "status").alias("status"),
        F.col("__r.developer_notes").alias("developer_notes"),
        F.col("__r.reviewed_at").alias("reviewed_at"),
    )
    return updated, rejected


# ── Drift ───────────────────────────────────────────────────────────────────

PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def psi_baseline(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean, population deviation and five percentiles of every column; missing values left out."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    quantiles = exact_quantiles(long, "feature", "value", PERCENTILES)
    wide = quantiles.groupBy("feature").agg(
        *[
            F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("quantile"))).alias(f"p{round(p * 100)}")
            for p in PERCENTILES
        ]
    )
    return stats.join(wide, "feature")


def score_histogram(df: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """Shares of the scores in equal bins over [0, 1]; the last bin holds 1 itself."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    inside = df.filter((F.col(score) >= 0) & (F.col(score) <= 1))
    counted = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = inside.agg(F.count(F.lit(1)).alias("t")).scalar()
    filled = spine.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("bin", "n", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def psi(baseline: DataFrame, recent: DataFrame, alert: float = C.PSI_ALERT, min_rows: int = C.PSI_MIN_ROWS) -> DataFrame:
    """Population stability index of two histograms, one row; null below 100 recent rows."""
    a = recent.select("bin", F.col("share").alias("a"), "n")
    e = baseline.select("bin", F.col("share").alias("e"))
    floor = F.lit(1e-9)
    term = (F.col("a") - F.col("e")) * F.log(F.greatest("a", floor) / F.greatest("e", floor))
    summed = a.join(e, "bin").agg(F.sum("n").alias("rows"), F.sum(term).alias("__psi"))
    value = F.when(F.col("rows") >= min_rows, F.col("__psi"))
    return summed.select("rows", value.alias("psi"), F.coalesce(value > alert, F.lit(False)).alias("alert"))

