"""The chain end to end on the smallest tables: exits, scores and what they are made of."""

import inspect

import pytest
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.plans import chain as K
from ledgerscope.plans.catalog.evidence import chain
from ledgerscope.sources import views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.transaction_id: r for r in chain(spark, SF).collect()}


def test_every_payment_leaves_once(spark, scored):
    assert len(scored) == V.txn(spark, SF).count()
    for r in scored.values():
        canary = list(r.tier1_flags) == ["canary"]
        assert canary == (r.account_id % 101 == 5)
        by_model = r.tier3_score_raw is not None and not canary
        if canary:
            assert (r.score, r.action) == (C.CANARY_SCORE, C.CANARY_ACTION)
        elif r.tier1_result == "FAST_CLEAN":
            assert r.action == "PASS" and r.gate_fired is None and not by_model
        elif r.gate_fired is not None:
            assert (r.score, r.action) == (C.GATE_SCORE, "REVIEW") and not by_model
        elif by_model:
            assert r.tier1_result == "SUSPICIOUS" and 0 <= r.tier3_score_raw <= 1
            factor = 1.0
            for v in r.context_applied.values():
                factor *= v
            assert abs(r.score - min(1.0, r.tier3_score_raw * factor)) < 1e-4


def test_features_are_computed_not_invented(spark):
    txn, edges = V.txnv(spark, SF), V.edges(spark, SF)
    features = K.account_features(txn, edges, V.as_of())
    assert features.count() == features.select("account_id").distinct().count()
    names = set(features.columns) - {"account_id"}
    assert {"sink_score", "bipartite_score", "channel_entropy", "inflow_24h", "benford_deviation", "amount_zscore"} <= names
    assert names <= set(C.FEATURE_VERSIONS["V5"])


def test_committee_without_some_scorers(spark):
    """Absent scorers give their weight away."""
    assert set(C.SCORER_IDS) == {"A", "B", "C", "D", "F"}
    rows = spark.createDataFrame([("t", 0.6, 0.2)], "transaction_id string, a double, d double").select(
        "transaction_id",
        F.col("a").alias("scorer_a_score"), F.lit(1.0).alias("scorer_a_confidence"), F.lit(False).alias("scorer_a_missing_flag"),
        F.col("d").alias("scorer_d_score"), F.lit(1.0).alias("scorer_d_confidence"), F.lit(False).alias("scorer_d_missing_flag"),
        *[x for s in "bcf" for x in (
            F.lit(None).cast("double").alias(f"scorer_{s}_score"), F.lit(None).cast("double").alias(f"scorer_{s}_confidence"),
            F.lit(None).cast("boolean").alias(f"scorer_{s}_missing_flag"),
        )],
    )
    got = K.M.aggregate_committee(K.M.normalise_outputs(rows)).first()
    assert abs(got["fallback_score"] - (0.4 * 0.6 + 0.1 * 0.2) / 0.5) < 1e-12


def test_chain_trains_as_its_operators_do(spark, monkeypatch):
    """The registered chain takes the operators' own number and depth of trees."""
    own = inspect.signature(K.L.train_base).parameters
    asked = []

    class Asked(Exception):
        pass

    def spy(*args, **options):
        asked.append(options)
        raise Asked

    monkeypatch.setattr(K.L, "train_base", spy)
    with pytest.raises(Asked):
        chain(spark, SF)
    for name in ("rounds", "depth"):
        assert asked[0].get(name, own[name].default) == own[name].default
