"""Feedback routing, seals, erasure; readers and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.text import fingerprint
from ledgerscope.operators import context as X
from ledgerscope.operators import evidence as E
from ledgerscope.operators import profile as P
from ledgerscope.sources import sinks, tables

T0 = dt.datetime(2024, 1, 1)
D = dt.timedelta(days=1)


def _case(frame):
    alerts = frame([("A1", "t1", "OPEN"), ("A2", "t2", "OPEN"), ("A3", "t3", "OPEN")], "alert_id string, transaction_id string, status string")
    scores = frame([("t1", {"x": 1.0, "bad": float("nan")}), ("t2", {"x": 2.0})], "transaction_id string, feature_vector map<string,double>")
    rows = [("A1", None, False, None, None, T0), ("A2", "i", True, None, "seen", T0), ("A3", "i", True, "mule", None, T0), ("A9", "i", True, None, None, T0)]
    feedback = frame(rows, "alert_id string, investigator_id string, confirmed_fraud boolean, fraud_type string, notes string, created_at timestamp")
    return alerts, scores, feedback


def test_feedback_reaches_its_tables(frame):
    alerts, scores, feedback = _case(frame)
    routes = E.route_feedback(feedback, alerts, scores)
    curated = {r["alert_id"]: r for r in routes.curated.collect()}
    assert {k: v["label"] for k, v in curated.items()} == {"A1": 0, "A2": 1}
    assert curated["A1"]["feature_vector"] == {"x": 1.0, "bad": None}
    assert [r["alert_id"] for r in routes.candidates.collect()] == ["A2"]
    assert routes.candidates.first()["fraud_type"] == "unknown" and routes.registry.count() == 1
    # Unknown alerts go nowhere; an alert without a stored score reaches log and audit.
    assert sorted(r["alert_id"] for r in routes.log.collect()) == ["A1", "A2", "A3"]
    kinds = [r["event_type"] for r in routes.audit.collect()]
    assert kinds.count("FEEDBACK") == 3 and kinds.count("FEEDBACK_ROUTING") == 2


def test_false_positive_resets_a_registered_fingerprint(frame):
    alerts, scores, feedback = _case(frame)
    known = frame([({"x": 1.0, "bad": None},)], "m map<string,double>").select(
        fingerprint(F.col("m")).alias("fingerprint"), F.lit(1).alias("label"), F.lit("t0").alias("source_transaction_id"), F.lit("h").alias("registered_by")
    )
    row = E.route_feedback(feedback, alerts, scores, known).registry.collect()
    assert len(row) == 1 and (row[0]["label"], row[0]["source_transaction_id"]) == (0, "t0")


def test_newest_verdict_sets_the_status(frame):
    alerts, _, _ = _case(frame)
    feedback = frame([("A1", True, T0), ("A1", False, T0 + D), ("A2", True, T0)], "alert_id string, confirmed_fraud boolean, created_at timestamp")
    got = {r["alert_id"]: r["status"] for r in E.alert_status(alerts, feedback).collect()}
    assert got == {"A1": "FALSE_POSITIVE", "A2": "CONFIRMED_FRAUD", "A3": "OPEN"}


def test_seal_notices_a_change(frame):
    df = frame([("A1", 1.0, None), ("A2", 2.0, "x")], "alert_id string, score double, gate string")
    seals = E.seal(df, ["alert_id", "score", "gate"], F.lit(T0))
    changed = df.withColumn("score", F.when(F.col("alert_id") == "A2", 2.5).otherwise(F.col("score")))
    more = changed.union(frame([("A3", 0.0, None)], "alert_id string, score double, gate string"))
    got = {r["alert_id"]: r["intact"] for r in E.verify_seal(more, ["gate", "alert_id", "score"], seals).collect()}
    assert got == {"A1": True, "A2": False, "A3": False}


def test_seal_depends_on_nulls(frame):
    a = frame([("A", None, "v")], "alert_id string, p string, q string")
    b = frame([("A", "v", None)], "alert_id string, p string, q string")
    cols = ["alert_id", "p", "q"]
    assert E.seal(a, cols, F.lit(T0)).first()["evidence_hash"] != E.seal(b, cols, F.lit(T0)).first()["evidence_hash"]


def test_erasure_keeps_protected_columns(frame):
    accounts = frame([("a", "clerk", "KA"), ("b", "clerk", "KA")], "id string, kyc_occupation string, kyc_home_state string")
    txn = frame([("t", "a", 5.0, "dev", "1.1.1.1")], "transaction_id string, account_id string, amount double, device_id string, ip_address string")
    acc, pay = E.erase(accounts, txn, frame([("a",), ("a",)], "account_id string"))
    assert {tuple(r) for r in acc.collect()} == {("a", None, None), ("b", "clerk", "KA")}
    assert tuple(pay.first()) == ("t", "a", 5.0, None, None)


def test_alert_ids_are_stable(frame):
    df = frame([(7, "a", 0.9, None, "HIGH_RISK", T0), (8, "a", 0.1, None, "PASS", T0)], "transaction_id int, account_id string, score double, gate_fired string, action string, scored_at timestamp")
    first, second = E.make_alerts(df).collect(), E.make_alerts(df).collect()
    assert first == second and len(first) == 1 and len(first[0]["alert_id"]) == 36


# ── Sources and sinks ───────────────────────────────────────────────────────


def test_csv_with_schema(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as out:
        out.write("b,a,label\n2.5,1,0\n,3,1\n")
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.IntegerType()), T.StructField("label", T.IntegerType())])
    rows = tables.read_labelled_csv(spark, path, schema).collect()
    assert [tuple(r) for r in rows] == [(2.5, 1, 0), (None, 3, 1)]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.read_labelled_csv(spark, path, schema, ["a", "z"])


def test_json_lines_and_wrapped(spark, tmp_path):
    lines, wrapped = str(tmp_path / "l.json"), str(tmp_path / "w.json")
    rows = [{"id": "a", "amount": 1.5}, {"id": "b", "amount": 2.0}]
    with open(lines, "w") as out:
        out.write("\n".join(json.dumps(r) for r in rows))
    with open(wrapped, "w") as out:
        out.write(json.dumps({"transactions": rows}))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("amount", T.DoubleType())])
    for path in (lines, wrapped):
        assert sorted(tuple(r) for r in tables.read_transactions_json(spark, path, schema).collect()) == [("a", 1.5), ("b", 2.0)]


def test_declared_tables_round_trip(spark, tmp_path):
    spark.createDataFrame([], tables.ACCOUNTS_SCHEMA).write.parquet(str(tmp_path / "accounts"))
    spark.createDataFrame([], tables.TRANSACTIONS_SCHEMA).write.parquet(str(tmp_path / "transactions"))
    accounts, transactions = tables.read_tables(spark, str(tmp_path))
    assert accounts.schema == tables.ACCOUNTS_SCHEMA and transactions.schema == tables.TRANSACTIONS_SCHEMA


def test_validation_reports_every_reason(frame):
    rows = [("x y", "a", None, 0.0, "CASH", T0 + D), ("ok", "a", "b", 10.25, "UPI", T0), ("p", "a", "b", 1.005, "UPI", T0), (None, "a", "b", 1.0, "UPI", None)]
    df = frame(rows, "transaction_id string, account_id string, payee_account_id string, amount double, channel string, ts timestamp")
    valid, rejected = tables.validate_transactions(df, F.lit(T0))
    assert [r["transaction_id"] for r in valid.collect()] == ["ok"]
    got = {r["transaction_id"]: r["reasons"] for r in rejected.collect()}
    assert got["x y"] == ["transaction_id", "amount_range", "channel", "timestamp"]
    assert got["p"] == ["amount_precision"] and got[None] == ["transaction_id", "timestamp"]


def test_features_expire_and_empty_rows_are_dropped(spark, frame, tmp_path):
    path = str(tmp_path / "features")
    df = frame([("a", 1.0, None), ("b", None, None)], "account_id string, x double, y double")
    sinks.write_account_features(df, path, F.lit(T0))
    assert [r["account_id"] for r in sinks.read_account_features(spark, path, F.lit(T0 + D)).collect()] == ["a"]
    assert sinks.read_account_features(spark, path, F.lit(T0 + dt.timedelta(hours=26))).count() == 0


def test_patch_ignores_unknown_keys_and_nulls(frame):
    base = frame([("a", 1.0, 5), ("b", 2.0, 6)], "account_id string, x double, k int")
    patch = frame([("a", 9.0), ("b", None), ("z", 3.0)], "account_id string, x double")
    assert sorted(tuple(r) for r in sinks.patch_features(base, patch, ["x"]).collect()) == [("a", 9.0, 5), ("b", 2.0, 6)]


def test_append_only_sinks(spark, frame, tmp_path):
    df = frame([(1, 0.5)], "transaction_id int, score double")
    for sink in (sinks.append_scores, sinks.append_alerts, sinks.append_audit, sinks.append_shadow):
        path = str(tmp_path / sink.__name__)
        sink(df, path)
        sink(df, path)
        assert spark.read.parquet(path).count() == 2


def test_list_is_replaced_whole_and_never_by_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "ofac")
    assert sinks.list_version(spark, path) is None
    first = sinks.replace_list(spark, path, frame([("a",), ("b",)], "entry string"))
    second = sinks.replace_list(spark, path, frame([("c",)], "entry string"))
    assert first != second
    assert [r["entry"] for r in sinks.read_list(spark, path).collect()] == ["c"]
    with pytest.raises(ValueError):
        sinks.replace_list(spark, path, frame([], "entry string"))
    assert sinks.list_version(spark, path) == second


def test_merge_skips_other_columns(frame):
    base = frame([(1.0, 0)], "x double, label int")
    merged, report = tables.merge_labelled_sets(base, {"same": frame([(1, 2.0)], "label int, x double"), "other": frame([(1,)], "label int")})
    assert merged.count() == 2
    assert {r["set_name"]: (r["appended"], r["row_count"], r["positives"]) for r in report.collect()} == {"same": (True, 1, 1), "other": (False, 1, 1)}


# ── Joins and aggregates on edge cases ──────────────────────────────────────


def test_clean_accounts_are_seeded_and_disjoint(frame):
    accounts = frame([(f"a{i}",) for i in range(40)], "id string")
    fraud = frame([(f"a{i}",) for i in range(5)], "account_id string")
    first = [r[0] for r in X.clean_accounts(accounts, fraud, 5, seed=1).collect()]
    assert len(first) == 5 and not set(first) & {f"a{i}" for i in range(5)}
    assert first == [r[0] for r in X.clean_accounts(accounts, fraud, 5, seed=1).collect()]
    assert first != [r[0] for r in X.clean_accounts(accounts, fraud, 5, seed=2).collect()]


def test_sanctions_prefer_list_then_id(frame):
    txn = frame([(1, "x1", "Bad Name"), (2, "x2", None), (3, "x3", "Good")], "transaction_id int, account_id string, holder_name string")
    lists = frame([("MHA_INDIA", "x1"), ("UN", "BAD NAME"), ("UN", "x1"), ("MHA_INDIA", "x2")], "list_name string, entry string")
    got = {r["transaction_id"]: (r["list_name"], r["matched"]) for r in X.sanctions_match(txn, lists).collect()}
    assert got == {1: ("UN", "account_id"), 2: ("MHA_INDIA", "account_id")}


def test_benford_needs_twenty_rows(frame):
    rows = [("a", float(10 ** (i % 4)) * (1 + i % 3), T0, i) for i in range(20)] + [("b", 1.0, T0, i) for i in range(19)]
    df = frame(rows, "account_id string, amount double, ts timestamp, transaction_id int")
    got = {r[0]: r[1] for r in P.benford_deviation(df, F.lit(T0 + D)).collect()}
    assert got["b"] is None and 0 < got["a"] <= 1


def test_flat_history_has_no_zscore(frame):
    rows = [("s", "p", T0 + i * D, i) for i in range(3)]
    df = frame(rows, "account_id string, payee_account_id string, ts timestamp, transaction_id int")
    assert P.fan_in_zscore(df, F.lit(T0 + 3 * D)).first()["fan_in_sender_zscore"] is None


def test_set_features_are_null_for_short_history(frame):
    rows = [("a", 5.0, "UPI", T0, None)] * 4 + [("b", 20_000.0, "UPI", T0, T0)] * 5
    df = frame(rows, "account_id string, amount double, channel string, ts timestamp, payee_vpa_created_at timestamp")
    got = {r["account_id"]: r for r in P.set_features(df, F.lit(T0 + D)).collect()}
    assert got["a"]["count_of_night_txns"] is None
    assert (got["b"]["has_any_round_amount_burst"], got["b"]["count_of_new_vpa_txns"], got["b"]["distinct_fraud_proximate_action_types"]) == (1.0, 1.0, pytest.approx(1 / 3))


def test_class_weights_without_positives(frame):
    row = P.class_weights(frame([(0,), (0,)], "label int")).first()
    assert (row["positives"], row["negatives"], row["positive_weight"]) == (0, 2, 1)
