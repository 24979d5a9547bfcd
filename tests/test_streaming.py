"""Streams give the rows of their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.context import fingerprint_occurrences
from ledgerscope.plans.context import payment_context
from ledgerscope.sources import tables
from ledgerscope.sources import views as V
from ledgerscope.streaming import streams as S

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


@pytest.fixture
def land(spark, tmp_path):
    """Write rows as several files and stream them one file at a time."""

    def make(df, parts=3, name="in"):
        path = str(tmp_path / name)
        df.coalesce(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", max(1, df.count() // parts + 1)).parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


@pytest.fixture
def run(spark, tmp_path):
    def make(df, name, mode="append"):
        query = (
            df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
        )
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    return make


def payments(spark):
    return V.txn(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))


def test_velocity_equals_batch(spark, land, run):
    df = payments(spark)
    got = run(S.stream_velocity(land(df)), "velocity", "complete")
    batch = (
        df.groupBy(F.window("ts", "1 hour", "5 minutes"), "account_id")
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .select("account_id", F.col("window.start").alias("start"), "txn_count")
    )
    assert got.select("account_id", "start", "txn_count").exceptAll(batch).count() == 0
    assert got.count() == batch.count()


def test_flows_and_patch(spark, frame, land, run):
    rows = [("a", "b", 10.0, T0), ("b", "a", 4.0, T0 + H / 2), ("a", "c", 6.0, T0 + 3 * H)]
    edges = frame(rows, "src string, dst string, amount double, ts timestamp")
    flows = run(S.stream_flows(land(edges)), "flows", "complete")
    features = frame([("a", 0.0, 0.0, 1), ("z", 7.0, 7.0, 2)], "account_id string, inflow_1h double, outflow_1h double, k int")
    patched = {r["account_id"]: tuple(r)[1:] for r in S.patch_latest_flows(flows, features).collect()}
    assert patched == {"a": (0.0, 6.0, 1), "z": (7.0, 7.0, 2)}


def test_flow_patches_of_all_batches_last(spark, frame, tmp_path):
    sink = S.flow_patch_sink(str(tmp_path / "deltas"))
    schema = "account_id string, end timestamp, inflow_1h double, outflow_1h double"
    sink(frame([("a", T0, 1.0, 2.0), ("a", T0 + H, 3.0, 4.0), ("b", T0, 5.0, 6.0)], schema), 0)
    for _ in range(2):
        sink(frame([("a", T0 + 2 * H, 7.0, 8.0)], schema), 1)
    features = frame([("a", 0.0, 0.0, 1), ("b", 0.0, 0.0, 2), ("z", 9.0, 9.0, 3)], "account_id string, inflow_1h double, outflow_1h double, k int")
    got = {r["account_id"]: tuple(r)[1:] for r in S.patched_features(features, str(tmp_path / "deltas")).collect()}
    assert got == {"a": (7.0, 8.0, 1), "b": (5.0, 6.0, 2), "z": (9.0, 9.0, 3)}


def test_readers_take_the_last_compaction_and_what_follows(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT_EVERY", 3)
    path = str(tmp_path / "deltas")
    assert S.left_by_batches(spark, path) is None
    sink = S.flow_patch_sink(path)
    schema = "account_id string, end timestamp, inflow_1h double, outflow_1h double"
    for n in range(8):
        sink(frame([(f"a{n % 5}", T0 + n * H, float(n), 0.0), ("hot", T0 + n * H, float(n), 1.0)], schema), n)
    read = S.left_by_batches(spark, path).inputFiles()
    assert {m for f in read for m in S._PLACE.findall(f)} == {("upto", "5"), ("batch", "6"), ("batch", "7")}
    features = frame([(f"a{i}", -1.0, -1.0) for i in range(5)] + [("hot", -1.0, -1.0)], "account_id string, inflow_1h double, outflow_1h double")
    got = {r["account_id"]: r["inflow_1h"] for r in S.patched_features(features, path).collect()}
    assert got == {"a0": 5.0, "a1": 6.0, "a2": 7.0, "a3": 3.0, "a4": 4.0, "hot": 7.0}
    (tmp_path / "deltas" / "batch=8").mkdir()
    (tmp_path / "deltas" / "batch=8" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception):
        S.left_by_batches(spark, path).collect()


def test_occurrences_go_on_across_batches(spark, frame, tmp_path):
    day = dt.timedelta(days=1)
    times = [0, 1, 2, 8.5, 16, 17]
    schema = "transaction_id int, fingerprint string, ts timestamp"
    rows = [(i, "f", T0 + t * day) for i, t in enumerate(times)]
    want = {r["transaction_id"]: r["occurrences"] for r in fingerprint_occurrences(frame(rows, schema)).collect()}
    path, got = str(tmp_path / "out"), {}
    for batch_id, part in enumerate([rows[:2], rows[2:3], rows[3:5], rows[5:]]):
        counted = fingerprint_occurrences(frame(part, schema)).select(
            "transaction_id",
            F.col("fingerprint").alias("novelty_fingerprint"),
            F.col("occurrences").alias("fingerprint_occurrences"),
            (F.col("occurrences") >= 4).alias("requires_escalation"),
            F.col("ts").alias("created_at"),
        )
        # The second try of a batch gives the same rows.
        for _ in range(2):
            queue = S.continue_runs(counted, f"{path}/runs", batch_id, escalate_at=4).cache()
            S.run_ends(queue).write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")
        got |= {r["transaction_id"]: (r["fingerprint_occurrences"], r["requires_escalation"]) for r in queue.collect()}
    assert got == {i: (n, n >= 4) for i, n in want.items()} and max(want.values()) == 4


def test_dedupe_keeps_first(spark, frame, land, run):
    rows = [(1, T0, 1.0), (1, T0 + H / 60, 2.0), (2, T0 + H / 60, 3.0)]
    stream = land(frame(rows, "transaction_id long, ts timestamp, amount double"))
    got = run(S.stream_dedupe(stream, "1 hour"), "dedupe")
    assert sorted(r["transaction_id"] for r in got.collect()) == [1, 2]


def test_fingerprint_sessions_equal_batch_runs(spark, frame, land, run):
    day = dt.timedelta(days=1)
    times = [0, 1, 5, 20, 21, 40]
    rows = [(i, "f", T0 + t * day) for i, t in enumerate(times)] + [(9, "g", T0)]
    df = frame(rows, "transaction_id int, fingerprint string, ts timestamp")
    got = run(S.stream_fingerprints(land(df)), "sessions", "complete")
    batch = fingerprint_occurrences(df).groupBy("fingerprint", "run_id").agg(F.max("occurrences").alias("n"))
    assert sorted((r["fingerprint"], r["occurrences"]) for r in got.collect()) == sorted(
        (r["fingerprint"], r["n"]) for r in batch.collect()
    )


def test_quarantine_splits_the_stream(spark, frame, land, run):
    rows = [("ok1", "a", "b", 5.0, "UPI", T0), ("bad id!", "a", "b", 5.0, "UPI", T0), ("ok2", "a", "b", -1.0, "CASH", T0)]
    df = frame(rows, "transaction_id string, account_id string, payee_account_id string, amount double, channel string, ts timestamp")
    as_of = F.lit(T0 + H)
    valid, rejected = S.quarantine(land(df, 1), as_of)
    assert [r["transaction_id"] for r in run(valid, "valid").collect()] == ["ok1"]
    broken = {r["transaction_id"]: r["reasons"] for r in run(rejected, "rejected").collect()}
    assert broken == {"bad id!": ["transaction_id"], "ok2": ["amount_range", "channel"]}
    alarms = S.quarantine_alarm(spark.table("rejected"), limit=0).collect()
    assert all(r["alarm"] for r in alarms)


def test_late_rows_fall_behind_the_watermark(spark, frame, tmp_path, run):
    path = str(tmp_path / "late")
    schema = "account_id string, amount double, ts timestamp"
    # The engine drops by the watermark of the batch before, hence two advancing files.
    for at in (T0, T0 + 10 * H, T0 + 11 * H, T0 + 12 * H, T0 + H / 60, T0 + 40 * H):
        frame([("a", 1.0, at)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(S.stream_velocity(stream, "1 hour", "1 hour"), "late", "append")
    counted = {r["start"]: r["txn_count"] for r in got.collect()}
    assert counted[T0] == 1 and sum(counted.values()) == 4


def test_scoring_batches_append_and_match_batch(spark, land, tmp_path):
    accounts = V.acct(spark, SF)
    history = V.txnv(spark, SF)
    as_of = V.as_of()
    context = payment_context(history, accounts, as_of).withColumn("ts", F.col("ts").cast("timestamp"))
    context = context.withColumn("raw_score", (F.col("transaction_id") % 100) / 100.0)
    context = context.withColumn("gate_fired", F.when(F.col("transaction_id") % 9 == 0, "bipartite_core"))
    stored = str(tmp_path / "context")
    context.write.parquet(stored)
    context = spark.read.parquet(stored)

    def enrich(batch):
        return context.join(batch.select("transaction_id"), "transaction_id", "left_semi")

    def discover(cleared):
        return cleared.select(
            "transaction_id", "account_id", "ts", "score", "action", "gate_fired",
            F.lit(-0.3).alias("anomaly_score"),
            F.create_map(F.lit("f"), (F.col("account_id") % 3).cast("double")).alias("features"),
        )

    registry = spark.createDataFrame([], "fingerprint string, label int")
    out = str(tmp_path / "out")
    sink = S.score_batch_sink(enrich, out, discover=discover, registry=registry)
    stream = land(payments(spark).select("transaction_id", "ts"))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    scores = spark.read.parquet(f"{out}/scores")
    assert scores.count() == payments(spark).count() == scores.select("transaction_id").distinct().count()
    alerts = spark.read.parquet(f"{out}/alerts")
    assert alerts.count() == scores.filter(F.col("action").isin("REVIEW", "HIGH_RISK")).count()
    assert spark.read.parquet(f"{out}/audit").count() == scores.count()
    queue = spark.read.parquet(f"{out}/novelty_queue")
    assert queue.join(scores.filter("action != 'PASS'"), "transaction_id", "left_semi").count() == 0
    assert scores.filter("batch = 0").count() < scores.count()


def test_stream_source_schema(spark, tmp_path):
    path = str(tmp_path / "tx")
    spark.createDataFrame([], tables.TRANSACTIONS_SCHEMA).write.parquet(path)
    stream = tables.stream_transactions(spark, path)
    assert stream.isStreaming and stream.schema == tables.TRANSACTIONS_SCHEMA
