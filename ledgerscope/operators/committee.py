"""Combine scorer outputs, derive thresholds and intervals, find nearest prototypes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import clamp, signal_confidence
from ledgerscope.operators.rules import context_vector_columns
from ledgerscope.scale import cut_lineage, exact_quantiles, prefix_sums, running_max, top_per_key

SCORERS = [s.lower() for s in C.SCORER_IDS]


def _score(s: str) -> Column:
    return F.col(f"scorer_{s}_score")


def _available(s: str) -> Column:
    return ~F.coalesce(F.col(f"scorer_{s}_missing_flag"), F.lit(True)) & _score(s).isNotNull()


def normalise_outputs(df: DataFrame) -> DataFrame:
    """Clamp scores and confidences; an absent scorer reads (0.5, 0, missing)."""
    out = df
    for s in SCORERS:
        absent = _score(s).isNull()
        out = (
            out.withColumn(f"scorer_{s}_missing_flag", F.coalesce(f"scorer_{s}_missing_flag", F.lit(False)) | absent)
            .withColumn(f"scorer_{s}_confidence", F.when(absent, 0.0).otherwise(clamp(F.coalesce(f"scorer_{s}_confidence", F.lit(0.0)))))
            .withColumn(f"scorer_{s}_score", F.coalesce(clamp(_score(s)), F.lit(0.5)))
        )
    return out


_EXTRA: dict[str, tuple[float, float]] = {}


def register_scorer(scorer_id: str, weight: float, override: float) -> None:
    """Give a further scorer a weight and an override threshold.

    Its columns are ``scorer_<id>_score`` and ``scorer_<id>_missing_flag``.
    """
    _EXTRA[scorer_id.lower()] = (weight, override)


def _members() -> dict[str, tuple[float, float]]:
    built_in = {s: (C.SCORER_WEIGHTS[s.upper()], C.SPECIALIST_THRESHOLDS[s.upper()]) for s in SCORERS}
    return {**built_in, **_EXTRA}


def aggregate_committee(df: DataFrame) -> DataFrame:
    """Fallback mean, specialist override, and the final score.

    Missing scorers give their weight to the others; with none available the score
    is 0.5.  Any available specialist at its threshold lifts the score to 1.  The
    final score is the override, else ``meta_score`` where present, else the mean.
    """
    members = _members()
    weight = reduce(lambda a, b: a + b, [F.when(_available(s), w).otherwise(0.0) for s, (w, _) in members.items()])
    total = reduce(
        lambda a, b: a + b, [F.when(_available(s), _score(s) * w).otherwise(0.0) for s, (w, _) in members.items()]
    )
    override = reduce(lambda a, b: a | b, [_available(s) & (_score(s) >= t) for s, (_, t) in members.items()])
    out = df.withColumn("fallback_score", F.when(weight > 0, total / weight).otherwise(0.5)).withColumn(
        "specialist_override", override
    )
    meta = F.col("meta_score") if "meta_score" in df.columns else F.lit(None).cast("double")
    return out.withColumn(
        "final_committee_score",
        F.when(F.col("specialist_override"), 1.0).otherwise(F.coalesce(meta, F.col("fallback_score"))),
    )


def meta_vector_columns() -> dict[str, Column]:
    """The 20 inputs of the meta-learner, in training order."""
    columns: dict[str, Column] = {}
    for s in SCORERS:
        columns[f"m_{s}_score"] = F.coalesce(_score(s), F.lit(0.5))
        columns[f"m_{s}_conf"] = F.coalesce(F.col(f"scorer_{s}_confidence"), F.lit(0.0))
        columns[f"m_{s}_miss"] = F.coalesce(F.col(f"scorer_{s}_missing_flag"), F.lit(True)).cast("double")
    return {**columns, **context_vector_columns()}


def input_dropout(df: DataFrame, key: str, p: float = 0.15, seed: int = 42) -> DataFrame:
    """Blank one hash-chosen scorer in a hash-chosen share ``p`` of the rows."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    pick = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(len(SCORERS)))
    out = df
    for i, s in enumerate(SCORERS):
        hit = (draw < p) & (pick == i)
        out = (
            out.withColumn(f"scorer_{s}_score", F.when(hit, 0.5).otherwise(_score(s)))
            .withColumn(f"scorer_{s}_confidence", F.when(hit, 0.0).otherwise(F.col(f"scorer_{s}_confidence")))
            .withColumn(f"scorer_{s}_missing_flag", F.when(hit, True).otherwise(F.col(f"scorer_{s}_missing_flag")))
        )
    return out


def committee_breakdown(df: DataFrame) -> DataFrame:
    """Nested summary of one decision, numbers to four places."""

    def four(name: str) -> Column:
        return F.bround(F.col(name), 4) if name in df.columns else F.lit(None).cast("double")

    scorers = F.struct(
        *[
            F.struct(
                F.bround(_score(s), 4).alias("score"),
                F.bround(F.col(f"scorer_{s}_confidence"), 4).alias("confidence"),
                F.col(f"scorer_{s}_missing_flag").alias("missing"),
            ).alias(s.upper())
            for s in SCORERS
        ]
    )
    return df.select(
        "transaction_id",
        F.struct(
            scorers.alias("scorers"),
            four("meta_score").alias("meta_score"),
            F.col("specialist_override"),
            four("final_committee_score").alias("final_score"),
            four("mapie_lower").alias("interval_lower"),
            four("mapie_upper").alias("interval_upper"),
        ).alias("breakdown"),
    )


def proxy_labels(shadow: DataFrame) -> DataFrame:
    return shadow.withColumn("label", F.when(F.col("live_action").isin("REVIEW", "HIGH_RISK"), 1).otherwise(0))


def community_proxy_labels(features: DataFrame) -> DataFrame:
    test = (F.col("community_fraud_ratio") > 0.5) & (F.col("sink_score") > 0.4)
    return features.withColumn("label", F.when(test, 1).otherwise(0))


# ── Curves and thresholds ───────────────────────────────────────────────────


def pr_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score, rows at or above it counted as alerts."""
    grouped = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    running = prefix_sums(grouped, "threshold", ["tp", "n"], descending=True)
    return running.select(
        "threshold",
        F.col("tp").alias("positives_here"),
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        F.when(F.col("tot_tp") > 0, F.col("cum_tp") / F.col("tot_tp")).otherwise(1.0).alias("recall"),
        F.col("tot_tp").alias("positives"),
    )


def average_precision(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision over the recall steps, one row."""
    curve = pr_curve(scores, score, label)
    step = F.col("positives_here") / F.col("positives")
    return curve.agg(F.coalesce(F.sum(step * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def thresholds_train(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Cut-offs of an ascending scan along the curve, one row ``(log, review, high_risk)``.

    log follows every score with recall >= .95.  review follows every score above
    log with recall >= .80 and precision >= .60.  The first score above review with
    precision >= .90 is high_risk and ends the scan.

    Recall falls along the scan, so the log value at a score is the score itself or
    the last one with enough recall; the review value is a running maximum.
    """
    curve = cut_lineage(pr_curve(scores, score, label).select("threshold", "precision", "recall"))
    t, rec, prec = F.col("threshold"), F.col("recall"), F.col("precision")
    last = curve.agg(F.max(F.when(rec >= 0.95, t)).alias("m")).scalar()
    settled = F.coalesce(F.bround(last, 4), F.lit(C.THRESHOLD_LOG))
    scan = curve.withColumn("log", F.when(rec >= 0.95, F.bround(t, 4)).otherwise(settled))
    scan = scan.withColumn(
        "candidate", F.when((rec >= 0.80) & (prec >= 0.60) & (t > F.col("log")), t)
    )
    scan = running_max(scan, "threshold", "candidate").withColumn(
        "review", F.coalesce(F.bround("cum_candidate", 4), F.lit(C.THRESHOLD_REVIEW))
    )
    state = F.struct("threshold", "log", "review")
    ends = scan.agg(
        F.min(F.when((prec >= 0.90) & (t > F.col("review")), state)).alias("stop"),
        F.max(state).alias("last"),
    )
    return ends.select(
        F.coalesce("stop.log", "last.log", F.lit(C.THRESHOLD_LOG)).alias("log"),
        F.coalesce("stop.review", "last.review", F.lit(C.THRESHOLD_REVIEW)).alias("review"),
        F.coalesce(F.bround("stop.threshold", 4), F.lit(C.THRESHOLD_HIGH_RISK)).alias("high_risk"),
    )


def thresholds_committee(
    scores: DataFrame, score: str = "score", label: str = "label", current_log: float = C.THRESHOLD_LOG
) -> DataFrame:
    """log: highest score with recall >= .95.  review: best F1 (lowest such score).
    high_risk: lowest score with precision >= .90.  ``log_moved`` warns of a shift above .05.
    """
    curve = pr_curve(scores, score, label)
    t, rec, prec = F.col("threshold"), F.col("recall"), F.col("precision")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    picked = curve.agg(
        F.max(F.when(rec >= 0.95, t)).alias("__log"),
        F.min(t).alias("__least"),
        F.min(F.struct((-F.round(f1, 12)).alias("f"), t.alias("t"))).alias("__f1"),
        F.min(F.when(prec >= 0.90, t)).alias("__high"),
    )
    return picked.select(
        F.bround(F.coalesce("__log", "__least", F.lit(C.THRESHOLD_LOG)), 4).alias("log_threshold"),
        F.bround(F.coalesce("__f1.t", F.lit(C.THRESHOLD_REVIEW)), 4).alias("review_threshold"),
        F.bround(F.coalesce("__high", F.lit(C.THRESHOLD_HIGH_RISK)), 4).alias("high_risk_threshold"),
    ).withColumn("log_moved", F.abs(F.col("log_threshold") - current_log) > 0.05)


def conformal_radius(calibration: DataFrame, alpha: float = 0.10) -> float | None:
    """Split-conformal radius: the ceil((n+1)(1-alpha))-th smallest absolute residual."""
    residual = F.abs(F.col("label").cast("double") - F.col("score"))
    rows = calibration.select(F.lit("all").alias("f"), residual.alias("v")).filter(F.col("v").isNotNull())
    n = rows.count()
    if n == 0:
        return None
    rank = min(int(np.ceil((n + 1) * (1 - alpha))), n)
    p = (rank - 1) / (n - 1) if n > 1 else 0.0
    return exact_quantiles(rows, "f", "v", [p]).first()["quantile"]


def conformal_interval(scores: DataFrame, radius: float | None, score: str = "score") -> DataFrame:
    """Interval for display: score +/- radius within [0, 1]; +/- 0.05 while unfitted."""
    width = 0.05 if radius is None else float(radius)
    return scores.withColumn("mapie_lower", clamp(F.col(score) - width)).withColumn(
        "mapie_upper", clamp(F.col(score) + width)
    )


def conformal_class_radii(calibration: DataFrame, alpha: float = 0.10, label: str = "label", score: str = "score") -> DataFrame:
    """``label, radius, n``: per class the ceil((n+1)(1-alpha))-th smallest distance of score and label.

    ``calibration`` must be rows that the scores were not fitted on and that are not
    judged with the result.  A class with too few rows for the rank has no radius (null):
    nothing speaks against it.
    """
    rows = calibration.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(label).cast("int").alias("label"), F.abs(F.col(label).cast("double") - F.col(score)).alias("v")
    )
    counted = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counted, "v", ["n"], by="label")
    # Rounded first, so that (n + 1) * 0.9 is no hair above a whole number.
    rank = F.ceil(F.round((F.col("tot_n") + 1) * (1 - alpha), 9))
    reached = (F.col("cum_n") >= rank) & (F.col("cum_n") - F.col("n") < rank)
    return ranked.groupBy("label").agg(F.max(F.when(reached, F.col("v"))).alias("radius"), F.max("tot_n").alias("n"))


def conformal_sets(scores: DataFrame, radii: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``may_be_clean`` and ``may_be_fraud``: the classes that are near enough to the score.

    Of the rows of either class, at least 1 - alpha keep their own class, however rare
    the class is.  Without a score both stay.
    """
    # One row a class.
    radius = {r["label"]: r["radius"] for r in radii.collect()}

    def near(c: int) -> Column:
        if radius.get(c) is None:
            return F.lit(True)
        return F.coalesce(F.abs(F.col(score) - c) <= radius[c], F.lit(True))

    return scores.withColumn("may_be_clean", near(0)).withColumn("may_be_fraud", near(1))


# ── Prototypes and remark clusters ──────────────────────────────────────────


def usable_vector(vector: Column, dim: int) -> Column:
    """Right length, at most 30 % missing, not all zero."""
    missing = F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x)))
    known = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x != 0))
    return F.coalesce(
        (F.size(vector) == dim) & (missing / float(dim) <= C.NULL_FRACTION_LIMIT) & (F.size(known) > 0),
        F.lit(False),
    )


def zero_missing(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float"))


def nearest_prototypes(
    vectors: DataFrame, prototypes: DataFrame, k: int = C.PROTOTYPE_K, block: int = 4_096
) -> DataFrame:
    """The ``k`` nearest prototypes of every vector by squared L2, ties by prototype id.

    ``vectors``: ``(id, vector)``; ``prototypes``: ``(proto_id, vector, label)``.
    Prototypes are read in blocks of fixed size, each sent to the executors once;
    the running best ``k`` is kept beside the row, so neither side is shuffled and
    any number of prototypes is handled.
    """
    found = vectors.select("id", "vector").withColumn(
        "best", F.array().cast("array<struct<distance:double,proto_id:long,label:int>>")
    )
    schema = found.schema
    rows: list = []
    for row in prototypes.select("proto_id", "vector", "label").toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            found = found.mapInPandas(_nearest_in(rows, k), schema)
            rows = []
    if rows:
        found = found.mapInPandas(_nearest_in(rows, k), schema)
    return found.select("id", F.explode("best").alias("b")).select("id", "b.*")


def _nearest_in(rows: list, k: int):
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    ids = np.array([r["proto_id"] for r in rows], dtype=np.int64)
    labels = np.array([r["label"] for r in rows], dtype=np.int64)
    # Rows handled at once, so that the differences stay near 64 MB.
    step = max(1, 8_000_000 // max(matrix.size, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                queries = np.array(part["vector"].tolist(), dtype=np.float64)
                distance = ((queries[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2)
                for held, d in zip(part["best"], distance):
                    # Everything at or below the k-th distance stays, so ties are whole.
                    reach = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                    near = np.nonzero(d <= reach)[0]
                    merged = [(float(d[i]), int(ids[i]), int(labels[i])) for i in near]
                    merged += [(h["distance"], h["proto_id"], h["label"]) for h in held]
                    merged.sort(key=lambda m: m[:2])
                    best.append(
                        [{"distance": a, "proto_id": b, "label": c} for a, b, c in merged[:k]]
                    )
            yield batch.assign(best=best)

    return run


def prototype_score(neighbours: DataFrame, min_neighbours: int = 1) -> DataFrame:
    """Distance-weighted fraud share of the neighbours, and confidence from their mean distance."""
    weight = 1.0 / (1.0 + F.col("distance"))
    return (
        neighbours.groupBy("id")
        .agg(
            (F.sum(weight * F.col("label")) / F.sum(weight)).alias("score"),
            (1.0 / (1.0 + F.avg("distance"))).alias("confidence"),
            F.count(F.lit(1)).alias("__n"),
        )
        .filter(F.col("__n") >= min_neighbours)
        .select("id", "score", "confidence")
    )


def scorer_c(vectors: DataFrame, prototypes: DataFrame, dim: int) -> DataFrame:
    """Prototype scorer output of every vector; an unusable vector is (0.5, 0, missing)."""
    good = vectors.filter(usable_vector(F.col("vector"), dim)).select(
        "id", zero_missing(F.col("vector")).alias("vector")
    )
    scored = prototype_score(nearest_prototypes(good, prototypes))
    return vectors.select("id").join(scored, "id", "left").select(
        "id",
        F.coalesce("score", F.lit(0.5)).alias("scorer_c_score"),
        F.coalesce("confidence", F.lit(0.0)).alias("scorer_c_confidence"),
        F.col("score").isNull().alias("scorer_c_missing_flag"),
    )


def curate_prototypes(
    prototypes: DataFrame, candidates: DataFrame, dim: int, cap: int = C.PROTOTYPE_CAP
) -> DataFrame:
    """Add valid pending candidates; beyond ``cap`` the oldest prototypes leave.

    Both have ``(proto_id, vector, label, inserted_at)``; candidates also ``status``.
    """
    accepted = candidates.filter(
        (F.col("status") == "PENDING_REVIEW")
        & F.col("label").isin(0, 1)
        & usable_vector(F.col("vector"), dim)
    ).select("proto_id", zero_missing(F.col("vector")).alias("vector"), "label", "inserted_at")
    merged = prototypes.select("proto_id", "vector", "label", "inserted_at").unionByName(accepted)
    return merged.orderBy(F.desc("inserted_at"), F.desc("proto_id")).limit(cap)


def centroids(vectors: DataFrame, key: str = "cluster") -> DataFrame:
    """Mean vector of each cluster at unit length."""
    parts = vectors.select(key, F.posexplode("vector").alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One number per dimension reaches each group: the vector's fixed length.
    gathered = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
    raw = F.transform("v", lambda e: e["m"])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    return gathered.select(
        key, F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(x)).alias("centroid")
    )


def _best_cosine(rows: list):
    matrix = np.array(rows, dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1)

    @F.pandas_udf("double")
    def best(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        present = vectors.notna().to_numpy()
        if present.any():
            queries = np.array(vectors[present].tolist(), dtype=np.float64)
            product = np.linalg.norm(queries, axis=1)[:, None] * lengths[None, :]
            dots = queries @ matrix.T
            out[present] = np.divide(dots, product, out=np.zeros_like(dots), where=product > 0).max(axis=1)
        return pd.Series(out)

    return best


def scorer_f(remarks: DataFrame, cluster_centroids: DataFrame, block: int = 4_096) -> DataFrame:
    """Best cosine of a remark vector to a cluster centroid, mapped to [0, 1].

    ``remarks``: ``(id, remark, vector)``.  Centroids are read in blocks of fixed
    size; each block is one vectorised expression over the remarks, and any number
    of blocks is handled.
    """
    best, known = F.lit(0.0), False
    rows: list = []
    for row in cluster_centroids.select("centroid").toLocalIterator():
        rows.append(list(row[0]))
        known = True
        if len(rows) == block:
            best, rows = F.greatest(best, _best_cosine(rows)(F.col("vector"))), []
    if rows:
        best = F.greatest(best, _best_cosine(rows)(F.col("vector")))
    blank = F.coalesce(F.trim("remark") == "", F.lit(True)) | F.col("vector").isNull() | F.lit(not known)
    scored = remarks.withColumn("__sim", best)
    return scored.select(
        "id",
        F.when(blank, 0.5).otherwise((F.col("__sim") + 1.0) / 2.0).alias("scorer_f_score"),
        F.when(blank, 0.0).otherwise(clamp(F.col("__sim") * 2.0)).alias("scorer_f_confidence"),
        blank.alias("scorer_f_missing_flag"),
    )


def scorer_columns(scored: DataFrame, scorer: str, probability: str, missing: Column) -> DataFrame:
    """Probability, confidence and missing flag under the scorer's column names."""
    p = F.col(probability)
    return (
        scored.withColumn(f"scorer_{scorer}_missing_flag", missing)
        .withColumn(f"scorer_{scorer}_confidence", signal_confidence(p))
        .withColumn(f"scorer_{scorer}_score", p)
    )


def top_n_contributions(contributions: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Long contributions ``(key, feature, contribution)`` reduced to the ``k`` largest."""
    return top_per_key(contributions, [key], [F.desc(F.abs("contribution")), F.asc("feature")], k)
