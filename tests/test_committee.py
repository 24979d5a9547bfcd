"""Committee, curves, thresholds, prototypes and training jobs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.operators import committee as M
from ledgerscope.operators import models as L

S = ["a", "b", "c", "d", "f"]
SCHEMA = "transaction_id int, " + ", ".join(
    f"scorer_{s}_score double, scorer_{s}_confidence double, scorer_{s}_missing_flag boolean" for s in S
)


def outputs(frame, *rows):
    flat = []
    for i, row in enumerate(rows):
        values = [i]
        for s in S:
            score, missing = row.get(s, (None, True))
            values += [score, 0.5, missing]
        flat.append(tuple(values))
    return frame(flat, SCHEMA)


def final(df):
    return [r["final_committee_score"] for r in M.aggregate_committee(M.normalise_outputs(df)).orderBy("transaction_id").collect()]


def test_weights_move_to_the_available(frame):
    got = final(outputs(
        frame,
        {},
        {s: (0.5, False) for s in S},
        {"a": (0.8, False), "b": (0.2, False)},
        {"d": (0.3, False), "f": (0.5, False)},
    ))
    assert got == pytest.approx([0.5, 0.5, (0.8 * 0.4 + 0.2 * 0.2) / 0.6, 0.4])


def test_specialist_override_at_and_below(frame):
    got = final(outputs(frame, {"c": (0.88, False), "a": (0.0, False)}, {"c": (0.8799, False)}, {"c": (0.99, True), "a": (0.1, False)}))
    assert got == pytest.approx([1.0, 0.8799, 0.1])


def test_outputs_are_clamped(frame):
    row = M.normalise_outputs(outputs(frame, {"a": (1.7, False), "b": (-0.4, False), "c": (None, False)})).first()
    assert (row["scorer_a_score"], row["scorer_b_score"], row["scorer_c_score"]) == (1.0, 0.0, 0.5)
    assert row["scorer_c_missing_flag"] and row["scorer_c_confidence"] == 0.0


def test_override_then_meta_then_mean(frame):
    df = M.normalise_outputs(outputs(frame, {"a": (0.95, False)}, {"a": (0.4, False)}, {"a": (0.4, False)}))
    df = df.withColumn("meta_score", F.when(F.col("transaction_id") < 2, 0.33))
    assert [r["final_committee_score"] for r in M.aggregate_committee(df).orderBy("transaction_id").collect()] == pytest.approx([1.0, 0.33, 0.4])


def test_registered_scorer_counts(frame):
    M.register_scorer("X", 0.6, 0.99)
    try:
        df = M.normalise_outputs(outputs(frame, {"a": (0.5, False)})).withColumn("scorer_x_score", F.lit(0.9)).withColumn("scorer_x_missing_flag", F.lit(False))
        assert M.aggregate_committee(df).first()["final_committee_score"] == pytest.approx((0.5 * 0.4 + 0.9 * 0.6) / 1.0)
    finally:
        M._EXTRA.clear()


def test_meta_vector_order(frame):
    df = outputs(frame, {s: (0.1, False) for s in S}).select(
        "*", F.lit("nri").alias("account_type"), F.lit(120).alias("kyc_age"), F.lit(75).alias("daily_txn_count"),
        F.lit("2024-10-05 23:30:00").cast("timestamp").alias("ts"),
    )
    columns = M.meta_vector_columns()
    assert len(columns) == 20
    row = df.select(*[c.alias(n) for n, c in columns.items()]).first()
    assert list(row)[:3] == [0.1, 0.5, 0.0] and list(row)[15:] == [1.0, 1.0, 1.0, 1.0, 1.0]


def test_input_dropout_blanks_one_scorer(spark):
    df = spark.range(4000).select(
        F.col("id").alias("transaction_id"),
        *[c for s in S for c in (F.lit(0.9).alias(f"scorer_{s}_score"), F.lit(0.8).alias(f"scorer_{s}_confidence"), F.lit(False).alias(f"scorer_{s}_missing_flag"))],
    )
    rows = M.input_dropout(df, "transaction_id").collect()
    blanked = [sum(r[f"scorer_{s}_missing_flag"] for s in S) for r in rows]
    assert set(blanked) == {0, 1} and 0.12 < sum(blanked) / len(rows) < 0.18
    assert all(r[f"scorer_{s}_score"] == (0.5 if r[f"scorer_{s}_missing_flag"] else 0.9) for r in rows for s in S)


def _scores(seed, n=80, places=2):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        y = rnd.random() < 0.3
        out.append((round(min(1.0, max(0.0, rnd.gauss(0.65 if y else 0.4, 0.2))), places), int(y)))
    return out


def _curve(rows):
    """Ascending thresholds with precision and recall of score >= threshold."""
    positives = sum(y for _, y in rows)
    out = []
    for t in sorted({s for s, _ in rows}):
        above = [y for s, y in rows if s >= t]
        out.append((t, sum(above) / len(above), sum(above) / positives))
    return out


def _scan(rows):
    log, review, high = 0.38, 0.62, 0.83
    for t, precision, recall in _curve(rows):
        if recall >= 0.95:
            log = round(t, 4)
        if recall >= 0.80 and precision >= 0.60 and t > log:
            review = round(t, 4)
        if precision >= 0.90 and t > review:
            high = round(t, 4)
            break
    return log, review, high


@pytest.mark.parametrize("seed", range(4))
def test_training_thresholds_follow_the_scan(frame, seed):
    rows = _scores(seed)
    got = M.thresholds_train(frame(rows, "score double, label int")).first()
    assert tuple(got) == pytest.approx(_scan(rows))


def test_curve_and_committee_thresholds(frame):
    rows = _scores(11)
    df = frame(rows, "score double, label int")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in M.pr_curve(df).collect()}
    expected = _curve(rows)
    assert got == {t: pytest.approx((p, r)) for t, p, r in expected}
    row = M.thresholds_committee(df).first()
    assert row["log_threshold"] == pytest.approx(max(t for t, _, r in expected if r >= 0.95))
    best = max(2 * p * r / (p + r) for _, p, r in expected)
    assert row["review_threshold"] == pytest.approx(min(t for t, p, r in expected if abs(2 * p * r / (p + r) - best) < 1e-12))
    area, last = 0.0, 0.0
    for t, p, r in reversed(expected):
        area, last = area + (r - last) * p, r
    assert M.average_precision(df).first()[0] == pytest.approx(area)


def test_conformal_interval_covers(frame):
    rows = [(i / 100, int(i % 3 == 0)) for i in range(101)]
    df = frame(rows, "score double, label int")
    radius = M.conformal_radius(df)
    covered = sum(abs(y - s) <= radius + 1e-12 for s, y in rows) / len(rows)
    assert covered >= 0.90
    row = M.conformal_interval(frame([(0.98,)], "score double"), None).first()
    assert (row["mapie_lower"], row["mapie_upper"]) == pytest.approx((0.93, 1.0))


def test_class_conditional_sets_cover_each_class(frame):
    """Fraud is rare and badly scored: a common radius fails it, its own does not."""
    rnd = random.Random(7)
    rows = []
    for i in range(6_000):
        label = int(rnd.random() < 0.05)
        rows.append((i, label, min(1.0, max(0.0, rnd.gauss(0.45, 0.2) if label else rnd.gauss(0.1, 0.08)))))
    df = frame(rows, "k long, label int, score double")
    calibration, test = df.filter("k % 2 = 0"), df.filter("k % 2 = 1")
    radii = M.conformal_class_radii(calibration)
    for r in radii.collect():
        v = sorted(abs(x[1] - x[2]) for x in rows if x[0] % 2 == 0 and x[1] == r["label"])
        assert r["n"] == len(v) and r["radius"] == v[-(-(len(v) + 1) * 9 // 10) - 1]
    sets = M.conformal_sets(test, radii)
    told = {r["label"]: r["c"] for r in sets.groupBy("label").agg(F.avg(F.when(F.col("label") == 1, F.col("may_be_fraud")).otherwise(F.col("may_be_clean")).cast("int")).alias("c")).collect()}
    assert told[0] > 0.88 and told[1] > 0.82
    pooled = M.conformal_radius(calibration)
    assert test.filter("label = 1").filter(F.abs(1 - F.col("score")) <= pooled).count() < 0.5 * test.filter("label = 1").count()
    few = M.conformal_class_radii(frame([(0, 1, 0.5), (1, 0, None), (2, None, 0.1)], "k long, label int, score double"))
    assert [tuple(r) for r in few.collect()] == [(1, None, 1)]
    both = M.conformal_sets(test.limit(5), few).collect()
    assert all(r["may_be_clean"] and r["may_be_fraud"] for r in both)


def test_prototypes_in_blocks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    v, p = rng.normal(size=(23, 6)).round(1), rng.normal(size=(37, 6)).round(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<float>")
    protos = spark.createDataFrame([(i, [float(x) for x in r], i % 2) for i, r in enumerate(p)], "proto_id long, vector array<float>, label int")
    for block in (5, 1000):
        got = {}
        for r in M.nearest_prototypes(vectors, protos, 4, block).collect():
            got.setdefault(r["id"], []).append((r["distance"], r["proto_id"]))
        v32, p32 = v.astype(np.float32).astype(float), p.astype(np.float32).astype(float)
        for i in range(len(v)):
            d = sorted((float(((v32[i] - p32[j]) ** 2).sum()), j) for j in range(len(p)))[:4]
            assert [j for _, j in sorted(got[i])] == [j for _, j in d]


def test_unusable_vectors_are_missing(frame):
    nan = float("nan")
    rows = [(1, [1.0, 2.0, nan, 4.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, [1.0, 2.0]), (4, [nan, nan, 1.0, 1.0]), (5, None)]
    protos = frame([(1, [1.0, 2.0, 0.0, 4.0], 1)], "proto_id long, vector array<float>, label int")
    got = {r["id"]: tuple(r)[1:] for r in M.scorer_c(frame(rows, "id long, vector array<float>"), protos, 4).collect()}
    assert got[1] == (1.0, 1.0, False)
    assert all(got[i] == (0.5, 0.0, True) for i in (2, 3, 4, 5))


def test_curated_vault_drops_the_oldest(frame):
    schema = "proto_id long, vector array<float>, label int, inserted_at int"
    vault = frame([(i, [1.0, float(i)], 0, i) for i in range(5)], schema)
    waiting = frame([(10, [1.0, 1.0], 1, 10, "PENDING_REVIEW"), (11, [0.0, 0.0], 1, 11, "PENDING_REVIEW"), (12, [1.0, 1.0], 1, 12, "REJECTED"), (13, [1.0, 1.0], 7, 13, "PENDING_REVIEW")], schema + ", status string")
    assert sorted(r["proto_id"] for r in M.curate_prototypes(vault, waiting, 2, cap=4).collect()) == [2, 3, 4, 10]


def test_remark_scorer(frame):
    centroids = frame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "cluster string, centroid array<double>")
    rows = [(1, "pay", [2.0, 0.0]), (2, "  ", [2.0, 0.0]), (3, None, None), (4, "no", [-1.0, -1.0])]
    got = {r["id"]: tuple(r)[1:] for r in M.scorer_f(frame(rows, "id int, remark string, vector array<double>"), centroids).collect()}
    assert got[1] == (1.0, 1.0, False) and got[2] == got[3] == (0.5, 0.0, True)
    assert got[4] == (0.5, 0.0, False)


def test_centroids_have_unit_length(frame):
    df = frame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "cluster string, vector array<double>")
    got = {r[0]: r[1] for r in M.centroids(df).collect()}
    assert got["a"] == pytest.approx([math.sqrt(0.5)] * 2) and got["b"] == [0.0, 0.0]


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(3000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    parts = L.split(df, [0.6, 0.2, 0.2], "id", stratify="label")
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 3000 and abs(sizes[0] - 1800) < 120
    again = L.split(df.orderBy(F.desc("id")).limit(2000), [0.6, 0.2, 0.2], "id", stratify="label")
    assert again[0].join(parts[0], "id", "left_anti").count() == 0


def test_trained_scores_rank_and_calibrate(spark):
    df = spark.range(2500).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0).alias("z")
    )
    df = df.withColumn("label", F.when(F.col("x") + F.col("z") * 0.1 > 0.9, 1).otherwise(0))
    model = L.train_calibrated(df, ["x", "z"], "id", depth=3, rounds=5)
    scored = model.score(df)
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > 0.7 and means[0] < 0.2
    out = L.scorer_a(df, model).first()
    assert out["scorer_a_missing_flag"] and 0 <= out["scorer_a_confidence"] <= 1


def test_meta_learner_needs_enough_rows(frame):
    df = outputs(frame, {"a": (0.5, False)}).withColumn("label", F.lit(1))
    with pytest.raises(ValueError, match="needs"):
        L.train_meta(df, "transaction_id")


def test_weights_are_the_declared_ones():
    assert sum(C.SCORER_WEIGHTS.values()) == pytest.approx(1.0) and list(C.SCORER_WEIGHTS) == C.SCORER_IDS
