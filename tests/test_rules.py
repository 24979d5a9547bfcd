"""Tier 1 rules, context factors, the eight stories, and scalar functions against Python."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions import rules as R
from ledgerscope.functions import text as X
from ledgerscope.functions import vectors as L
from ledgerscope.operators import rules as O
from ledgerscope.plans.scoring import score_payments

STORY = (
    "transaction_id string, account_id string, amount double, channel string, hour int, velocity_1h int, velocity_24h int, "
    "account_age_days int, avg_amount_30d double, payee_in_known_contacts boolean, payee_account_age_days int, "
    "payee_vpa_age_days int, kyc_occupation string, kyc_age int, account_type string, daily_txn_count int, "
    "has_festival_gifting_history boolean, gate_fired string, raw_score double"
)
# (row, allowed actions, lowest score, highest score)
STORIES = [
    (("rapid_layering", "L", 95000.0, "UPI", 2, 6, 20, 30, 5000.0, False, 5, 2, "SALARIED", 30, "SAVINGS", 8, False, None, 0.88), {"REVIEW", "HIGH_RISK"}, 0.62, 1.0),
    (("low_slow", "M", 180000.0, "UPI", 2, 1, 2, 45, 3000.0, False, 10, 5, "SALARIED", 35, "SAVINGS", 1, False, None, 0.75), {"REVIEW", "HIGH_RISK"}, 0.62, 1.0),
    (("festival", "F", 2000.0, "UPI", 11, 3, 8, 800, 1500.0, True, 500, 180, "SALARIED", 42, "SAVINGS", 4, True, None, 0.45), {"PASS", "LOG"}, 0.0, 0.62),
    (("digital_arrest", "S", 500000.0, "UPI", 2, 1, 1, 3650, 5000.0, False, 2, 2, "RETIRED", 68, "SAVINGS", 1, False, None, 0.72), {"REVIEW", "HIGH_RISK"}, 0.62, 1.0),
    (("cash_trail", "C", 124000.0, "CASH", 8, 1, 3, 60, 2000.0, False, None, None, None, None, "SAVINGS", 1, False, "cash_mule_sink", None), {"REVIEW"}, 1.0, 1.0),
    (("structuring", "T", 96500.0, "UPI", 14, 5, 5, 200, 15000.0, False, 30, 60, "BUSINESS", 40, "CURRENT", 5, False, None, 0.70), {"REVIEW", "HIGH_RISK"}, 0.62, 1.0),
    (("bipartite", "B", 50000.0, "UPI", 15, 1, 3, 90, 10000.0, False, 30, 30, "SALARIED", 28, "SAVINGS", 7, False, "bipartite_core", None), {"REVIEW"}, 1.0, 1.0),
    (("salary_cycle", "E", 45000.0, "UPI", 10, 1, 1, 1200, 42000.0, True, 2000, 730, "SALARIED", 32, "SAVINGS", 1, False, None, 0.25), {"PASS", "LOG"}, 0.0, 0.62),
]


def _stories(frame):
    df = frame([s[0] for s in STORIES], STORY)
    day = F.lit("2024-07-10 00:00:00").cast("timestamp")
    return df.withColumn("ts", day + F.make_dt_interval(F.lit(0), F.col("hour")))


def test_eight_stories(frame):
    got = {r["transaction_id"]: r for r in score_payments(_stories(frame)).collect()}
    assert len(got) == len(STORIES)
    for row, actions, low, high in STORIES:
        r = got[row[0]]
        assert r["action"] in actions, row[0]
        assert low <= r["score"] <= high, row[0]
        assert r["gate_fired"] == row[17]
    assert set(got["digital_arrest"]["context_applied"]) == {"senior_night_amplification", "senior_new_vpa_amplification"}
    assert got["salary_cycle"]["tier1_result"] == "FAST_CLEAN" and got["salary_cycle"]["action"] == "PASS"


def test_canary_wins_over_everything(frame):
    canaries = frame([("C",), ("L",)], "account_id string")
    got = {r["transaction_id"]: r for r in score_payments(_stories(frame), canaries=canaries).collect()}
    for name in ("cash_trail", "rapid_layering"):
        assert (got[name]["score"], got[name]["action"], got[name]["tier1_flags"]) == (0.5, "LOG", ["canary"])
        assert got[name]["gate_fired"] is None


def test_gates_beat_the_model_and_scores_stay_in_range(frame):
    df = _stories(frame).withColumn("gate_fired", F.lit("confirmed_cycle")).withColumn("raw_score", F.lit(0.0))
    for r in score_payments(df).collect():
        assert r["action"] == ("PASS" if r["tier1_result"] == "FAST_CLEAN" else "REVIEW")
        assert 0 <= r["score"] <= 1


def test_null_inputs_raise_no_flag(frame):
    df = frame(
        [(1.0, None, None, None, None, None)],
        "amount double, payee_vpa_age_days int, velocity_1h int, kyc_occupation string, payee_account_age_days int, avg_amount_30d double",
    ).withColumn("ts", F.lit("2024-03-05 12:00:00").cast("timestamp"))
    assert O.tier1_flags(df).first()["tier1_flags"] == []


def test_occupation_matches_any_case(frame):
    df = frame([("Gig_Worker",), ("salaried",), (None,)], "o string")
    got = [r[0] for r in df.select(R.occupation_in(F.col("o"), C.GIG_OCCUPATIONS)).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize(
    "amount,band,pct",
    [(49_000.0, True, True), (48_999.99, False, True), (50_000.0, False, False), (47_500.0, False, True), (999_999.0, True, True), (990_000.0, True, True), (950_000.0, False, True)],
)
def test_threshold_edges(frame, amount, band, pct):
    row = frame([(amount,)], "a double").select(R.near_threshold_band(F.col("a")), R.near_threshold_pct(F.col("a"))).first()
    assert tuple(row) == (band, pct)


def test_large_value_needs_high_risk(frame):
    df = frame([(1_000_000.0, "HIGH_RISK"), (999_999.0, "HIGH_RISK"), (5e6, "REVIEW")], "amount double, action string")
    assert O.large_value_escalation(df).count() == 1 and O.hold_candidates(df).count() == 2


def test_vpa_age_floors_at_zero(frame):
    t = dt.datetime(2024, 1, 10, 12)
    rows = [(t, t - dt.timedelta(days=3, hours=23)), (t, t + dt.timedelta(days=1)), (t, None)]
    df = frame(rows, "a timestamp, b timestamp")
    assert [r[0] for r in df.select(R.vpa_age_days(F.col("a"), F.col("b"))).collect()] == [3, 0, None]


def test_staleness_pulls_to_the_middle(frame):
    base = _stories(frame).filter("transaction_id = 'structuring'").withColumn("raw_score", F.lit(0.9))
    for hours, expected in ((26.0, 0.9), (26 + 36.0, 0.9 * 0.85 + 0.5 * 0.15), (1000.0, 0.9 * 0.7 + 0.5 * 0.3)):
        row = O.apply_context(base.withColumn("graph_staleness_hours", F.lit(hours))).first()
        assert row["adjusted_score"] == pytest.approx(expected)
        assert ("graph_staleness_penalty" in row["adjustments"]) == (hours > 26)


def test_jitter_is_bounded_and_repeatable(spark):
    df = spark.range(500).withColumn("s", (F.col("id") % 11) / 10.0)
    a = [r[0] for r in df.select(R.jitter(F.col("s"), F.col("id"))).collect()]
    b = [r[0] for r in df.select(R.jitter(F.col("s"), F.col("id"))).collect()]
    assert a == b and all(0 <= x <= 1 for x in a) and len(set(a)) > 100
    assert all(abs(x - (i % 11) / 10.0) <= 0.01 + 1e-12 for i, x in enumerate(a))


def test_keyed_pseudonym_is_hmac(frame):
    for key in ("short", "x" * 100):
        got = [r[0] for r in frame([("acc-1",), ("ä",)], "a string").select(X.pseudonymize(F.col("a"), key)).collect()]
        assert got == [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()[:12] for v in ("acc-1", "ä")]


def test_fingerprint_ignores_order_and_small_features(frame):
    big = {f"f{i}": float(i + 1) for i in range(10)}
    a = {**big, "tiny": 0.01}
    b = dict(reversed(list({**big, "small": -0.02, "none": None}.items())))
    df = frame([(a,), (b,), ({**big, "f0": 99.0},)], "m map<string,double>")
    got = [r[0] for r in df.select(X.fingerprint(F.col("m"))).collect()]
    top = sorted(big.items(), key=lambda e: (-abs(e[1]), e[0]))
    assert got[0] == got[1] == hashlib.sha256("|".join(f"{k}:{round(v, 2)}" for k, v in top).encode()).hexdigest()
    assert got[2] != got[0]


def test_nan_and_infinity_become_null(frame):
    df = frame([({"a": float("nan"), "b": float("inf"), "c": 1.0, "d": None},)], "m map<string,double>")
    assert df.select(L.nan_to_null_map(F.col("m"))).first()[0] == {"a": None, "b": None, "c": 1.0, "d": None}


def test_cosine_of_zero_vector_is_zero(frame):
    df = frame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(L.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_clean_text_strips_controls_and_cuts(frame):
    got = frame([("a\x1b[31mb\x00c\u009bd" + "x" * 600,)], "s string").select(X.clean_text(F.col("s"))).first()[0]
    assert got.startswith("a[31mbcdxxx") and len(got) == 500


def test_unknown_gate_is_named(frame):
    df = frame([("rapid_relay", 0.5)], "g string, s double")
    names = F.array().cast("array<string>")
    assert df.select(X.narrative(F.col("g"), names, F.col("s"))).first()[0] == (
        "System fraud score: 50.00%. Hard gate fired: rapid_relay. " + C.NARRATIVE_CLOSE
    )


def test_registry_is_append_only():
    assert len(C.GRAPH_FEATURES) == 36 and len(C.FEATURE_VERSIONS["V2"]) == 70 and len(C.FEATURE_VERSIONS["V5"]) == 113
    versions = [C.FEATURE_VERSIONS[f"V{i}"] for i in range(2, 6)]
    for older, newer in zip(versions, versions[1:]):
        assert newer[: len(older)] == older
    for names in versions:
        assert len(set(names)) == len(names)
