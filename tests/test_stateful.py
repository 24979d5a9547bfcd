"""Exact streams give the batch operator's value at every row, in whatever order rows arrive."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.context import fingerprint_occurrences, sliding_velocity, sliding_volume
from ledgerscope.operators.profile import sides
from ledgerscope.scale import trailing_stats
from ledgerscope.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)
PAY = "transaction_id long, account_id string, amount double, ts timestamp"


@pytest.fixture
def stream(frame, spark, tmp_path):
    """One file a batch, in the given order."""

    def make(batches, schema):
        path = str(tmp_path / "in")
        for rows in batches:
            frame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


@pytest.fixture
def run(spark, tmp_path):
    def make(df, name, stop_after=None):
        writer = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck_{name}"))
        for _ in range(2 if stop_after else 1):
            query = writer.start()
            query.processAllAvailable()
            query.stop()
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    return make


def shuffled(rows, span_minutes, parts):
    """Batches in which rows lie up to ``span_minutes`` out of order, then one that moves the clock on."""
    rnd = random.Random(1)
    late = sorted(rows, key=lambda r: r[-1] + rnd.random() * span_minutes * MIN)
    size = -(-len(late) // parts)
    return [late[i : i + size] for i in range(0, len(late), size)]


def payments(n=400, minutes=3_000):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        at = T0 + rnd.randrange(minutes * 60) * dt.timedelta(seconds=1) if i % 7 else T0 + rnd.randrange(minutes // 30) * 30 * MIN
        out.append((i, rnd.choice(["hot", "hot", "hot", "a", "b", None]), round(rnd.random() * 1e5, 2) if i % 11 else None, at))
    return out + [(n - 1, "hot", 7.25, T0 + 5 * MIN), (n - 1, "hot", 7.25, T0 + 5 * MIN)]


FLUSH = T0 + dt.timedelta(days=90)


def test_velocity_equals_batch_row_by_row(frame, stream, run):
    rows = payments()
    batches = shuffled(rows, 25, 6) + [[(-1, "flush", 1.0, FLUSH)], [(-2, "flush", 1.0, FLUSH + 60 * MIN)]]
    got = run(S.stream_velocity_exact(stream(batches, PAY), watermark="30 minutes"), "velocity", stop_after=True)
    df = frame(rows, PAY)
    cols = ["transaction_id", "account_id", "ts"]
    batch = sliding_velocity(df).select(*cols, "amount", "velocity_1h", "velocity_24h")
    volumes = sliding_volume(df).select(*cols, "volume_1h").distinct()
    same = (F.col("b.transaction_id") == F.col("v.transaction_id")) & F.col("b.account_id").eqNullSafe(F.col("v.account_id")) & (F.col("b.ts") == F.col("v.ts"))
    batch = batch.alias("b").join(volumes.alias("v"), same).select("b.transaction_id", "b.account_id", "b.ts", "velocity_1h", "velocity_24h", "volume_1h")
    key = lambda r: tuple(map(str, r))
    got = got.filter("transaction_id >= 0").select(*batch.columns)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)


def test_means_and_current_row(frame, stream, run):
    rows = payments(150, 600)
    measures = {"n": (900, "count", None), "mean": (7_200, "avg", "amount"), "total": (900, "sum", "amount")}
    batches = shuffled(rows, 8, 4) + [[(-1, "flush", 1.0, FLUSH)], [(-2, "flush", 1.0, FLUSH + 60 * MIN)]]
    got = run(S.stream_trailing(stream(batches, PAY), "account_id", measures, include_current=True), "means")
    want = trailing_stats(frame(rows, PAY), "account_id", "ts", measures, include_current=True)
    pick = lambda df: sorted(
        ((r.transaction_id, str(r.account_id), r.ts, r.n, round(r.mean, 6), r.total) for r in df.collect()), key=str
    )
    assert pick(got.filter("transaction_id >= 0")) == pick(want)


def test_rows_wait_for_the_watermark_and_late_rows_are_left_out(stream, run):
    batches = [
        [(1, "a", 1.0, T0), (2, "a", 2.0, T0 + 20 * MIN)],
        [(3, "a", 4.0, T0 + 15 * MIN)],
        [(4, "a", 8.0, T0 + 120 * MIN)],
        [(5, "a", 16.0, T0 + 121 * MIN)],
        [(6, "a", 32.0, T0 + 1 * MIN)],  # behind the watermark
        [(7, "a", 64.0, T0 + 130 * MIN)],
    ]
    got = {r.transaction_id: r for r in run(S.stream_velocity_exact(stream(batches, PAY)), "late").collect()}
    assert set(got) == {1, 2, 3, 4}  # the last two still wait
    assert [got[i].velocity_1h for i in (1, 3, 2, 4)] == [0, 1, 2, 0] and got[2].volume_1h == 5.0


def test_rows_without_time(stream, run):
    got = run(S.stream_velocity_exact(stream([[(1, "a", 1.0, None)]], PAY)), "untimed").collect()
    assert [tuple(r) for r in got] == [("a", 1, None, 0, 0, 0.0)]


def test_flows_equal_batch(frame, stream, run):
    rnd = random.Random(4)
    schema = "src string, dst string, amount double, ts timestamp, transaction_id long"
    rows = [(*rnd.sample("abc", 2), float(rnd.randrange(1, 500)), T0 + rnd.randrange(400) * MIN, i) for i in range(120)]
    late = sorted(rows, key=lambda r: r[3] + rnd.random() * 5 * MIN)
    batches = [late[:50], late[50:], [("x", "y", 1.0, FLUSH, -1)], [("x", "y", 1.0, FLUSH + 60 * MIN, -2)]]
    got = run(S.stream_flows_exact(stream(batches, schema)), "flows").filter("transaction_id >= 0")
    both = sides(frame(rows, schema)).withColumn("i", F.expr("IF(direction = 'in', amount, 0D)")).withColumn("o", F.expr("IF(direction = 'out', amount, 0D)"))
    want = trailing_stats(both, "account_id", "ts", {"inflow_1h": (3_600, "sum", "i"), "outflow_1h": (3_600, "sum", "o")}, include_current=True)
    cols = ["account_id", "transaction_id", "ts", "inflow_1h", "outflow_1h"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_occurrences_equal_batch(frame, stream, run):
    rnd = random.Random(6)
    day = dt.timedelta(days=1)
    schema = "transaction_id long, fingerprint string, ts timestamp"
    at = {"f": 0.0, "g": 0.0, "h": 0.0}
    rows = []
    for i in range(60):
        f = rnd.choice("fgh")
        at[f] += rnd.choice([0, 0.5, 1, 6.999, 7, 9])
        rows.append((i, f, T0 + at[f] * day))
    rows.sort(key=lambda r: r[2])
    for i in range(0, 58, 2):
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    end = T0 + 900 * day
    batches = [rows[:20], rows[20:45], rows[45:], [(-1, "z", end)], [(-2, "z", end + day)]]
    got = run(S.stream_occurrences(stream(batches, schema), watermark="40 days"), "runs").filter("transaction_id >= 0")
    want = {r.transaction_id: r.occurrences for r in fingerprint_occurrences(frame(rows, schema)).collect()}
    assert {r.transaction_id: r.occurrences for r in got.collect()} == want
