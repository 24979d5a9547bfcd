"""Hot-key routes give the same rows as the plain ones."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import context as X
from ledgerscope.scale import as_of_join, exact_quantiles, prefix_sums, running_max, split_hot, trailing_stats


def _payments(seed=3, rows=120):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for i in range(rows):
        account = "hub" if rnd.random() < 0.5 else f"a{rnd.randrange(6)}"
        # Whole minutes produce ties and exact window edges.
        ts = start + dt.timedelta(minutes=rnd.randrange(0, 3 * 24 * 60, 5))
        out.append((i, account, f"p{rnd.randrange(3)}", float(rnd.randrange(1, 10_000)) / 100, ts))
    return out


SCHEMA = "transaction_id long, account_id string, payee_account_id string, amount double, ts timestamp"


def _expected(rows, span, include_current):
    result = {}
    for i, account, _, _, ts in rows:
        lo = ts - dt.timedelta(seconds=span)
        near = [
            r[3] for r in rows if r[1] == account and lo < r[4] and (r[4] <= ts if include_current else r[4] < ts)
        ]
        result[i] = (len(near), round(sum(near), 4), round(sum(near) / len(near), 4) if near else 0.0)
    return result


@pytest.mark.parametrize("include_current", [False, True])
@pytest.mark.parametrize("hot", ["3", "1000000"])
def test_trailing_stats_matches_brute_force(spark, hot, include_current):
    rows = _payments()
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.ledgerscope.hotRows", hot)
    try:
        for span in (3_600, 86_400):
            got = trailing_stats(
                df,
                "account_id",
                "ts",
                {"n": (span, "count", None), "s": (span, "sum", "amount"), "m": (span, "avg", "amount")},
                include_current,
            ).collect()
            expected = _expected(rows, span, include_current)
            assert len(got) == len(expected)
            for r in got:
                assert (r["n"], r["s"], r["m"]) == pytest.approx(expected[r["transaction_id"]], abs=1e-3)
    finally:
        spark.conf.unset("spark.ledgerscope.hotRows")


@pytest.mark.parametrize("include_current", [False, True])
def test_both_routes_keep_odd_rows(spark, include_current):
    t = dt.datetime(2024, 1, 1, 10, 0)
    m = dt.timedelta(minutes=1)
    rows = [(1, "a", t, 10.0), (1, "a", t, 10.0), (1, "a", t + m, None), (2, "a", None, 5.0), (2, "a", None, None)]
    rows += [(None, "a", t + 2 * m, 4.0), (3, None, t, 1.0), (3, None, t, 2.0), (4, None, t + m, None), (5, None, None, 9.0), (6, "b", t, None)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id string, ts timestamp, amount double")
    found = []
    for hot in ("2", "1000000"):
        spark.conf.set("spark.ledgerscope.hotRows", hot)
        try:
            got = trailing_stats(
                df, "account_id", "ts",
                {"n": (3_600, "count", None), "s": (3_600, "sum", "amount"), "m": (3_600, "avg", "amount")},
                include_current,
            )
            found.append(sorted(map(repr, got.collect())))
        finally:
            spark.conf.unset("spark.ledgerscope.hotRows")
    assert len(found[0]) == len(rows) and found[0] == found[1]
    last = next(r for r in got.collect() if r["transaction_id"] is None)
    assert (last["n"], last["s"], last["m"]) == ((4, 24.0, 8.0) if include_current else (3, 20.0, 10.0))


def test_split_hot_keeps_every_row(spark, tiny_hot):
    df = spark.createDataFrame([(1, "x")] * 5 + [(2, "y")] * 2 + [(3, None)] * 6, "i int, k string")
    cold, hot = split_hot(df, ["k"])
    assert cold.count() == 2 and hot.count() == 11


def test_prefix_sums_over_buckets(spark):
    values = list(range(1, 200))
    df = spark.createDataFrame([(float(v), v % 7) for v in values], "x double, w long")
    for descending in (False, True):
        got = {r["x"]: r["cum_w"] for r in prefix_sums(df, "x", ["w"], descending=descending, parts=8).collect()}
        running, expected = 0, {}
        for v in sorted(values, reverse=descending):
            running += v % 7
            expected[float(v)] = running
        assert got == expected


def test_scans_by_feature_with_nulls_ties_and_many_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(f, float(v), int(w)) for f in ("a", "b", None) for v, w in zip(rng.permutation(60), rng.integers(0, 9, 60))]
    rows.append(("a", None, 5))
    df = spark.createDataFrame(rows, "f string, x double, w long")
    for parts in (1, 3, 17):
        got = {(r["f"], r["x"]): (r["cum_w"], r["tot_w"]) for r in prefix_sums(df, "x", ["w"], by="f", parts=parts).collect()}
        for f in ("a", "b", None):
            mine = sorted((r for r in rows if r[0] == f), key=lambda r: (r[1] is not None, r[1] or 0))
            total, running = sum(r[2] for r in mine), 0
            for _, x, w in mine:
                running += w
                assert got[f, x] == (running, total)
    top = running_max(spark.createDataFrame([(float(x), w) for _, x, w in rows[:60]], "x double, w long"), "x", "w", parts=7)
    best, want = -1, {}
    for _, x, w in sorted(rows[:60], key=lambda r: r[1]):
        best = max(best, w)
        want[x] = best
    assert {r["x"]: r["cum_w"] for r in top.collect()} == want
    assert prefix_sums(df.filter("false"), "x", ["w"], by="f").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_as_of_join_on_both_routes(spark, hot, request):
    if hot:
        request.getfixturevalue("tiny_hot")
    rnd = random.Random(5)
    t0, m = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    keys = ["h", "h", "h", "a", None]
    rows = [(i, rnd.choice(keys), None if i % 17 == 0 else t0 + rnd.randrange(600) * m, "own") for i in range(150)]
    versions = [(rnd.choice(keys), None if i % 13 == 0 else t0 + rnd.randrange(600) * m, i % 5, t0 + rnd.randrange(900) * m if i % 3 else None) for i in range(40)]
    left = spark.createDataFrame(rows, "i int, k string, ts timestamp, note string")
    right = spark.createDataFrame(versions, "k string, start timestamp, state int, stop timestamp")
    got = {r["i"]: r["state"] for r in as_of_join(left, right, "k", "ts", "start", ["state"], "stop", bucket_seconds=3_000).collect()}
    assert len(got) == len(rows)
    low = dt.datetime.min
    for i, k, ts, _ in rows:
        fit = [(s, v, e or low, e) for vk, s, v, e in versions if vk == k and s is not None and ts is not None and k is not None and s <= ts]
        best = max(fit, key=lambda x: x[:3]) if fit else None
        want = best[1] if best and (best[3] is None or ts < best[3]) else None
        assert got[i] == want, (i, k, ts)
    assert as_of_join(left, right.filter("false"), "k", "ts", "start", ["state"]).filter("state IS NULL").count() == 150
    assert as_of_join(left.filter("false"), right, "k", "ts", "start", ["state"]).count() == 0


def test_scan_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(rows):
        for r in rows:
            seen.add(1)
            yield r

    counted = spark.sparkContext.parallelize([(float(i), 1) for i in range(100)], 4).mapPartitions(touch).toDF("x double, w long")
    out = prefix_sums(counted, "x", ["w"], parts=5)
    assert out.agg(F.max("cum_w")).first()[0] == 100 and seen.value == 100
    # Borders are not part of the plan.
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 20_000


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=301), np.round(rng.exponential(size=77), 1)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    got = exact_quantiles(spark.createDataFrame(rows, "f string, v double"), "f", "v", [0.1, 0.5, 0.99]).collect()
    for row in got:
        expected = np.percentile(a if row["f"] == "a" else b, row["p"] * 100)
        assert row["quantile"] == pytest.approx(expected)


def test_fingerprint_runs(spark):
    day = dt.timedelta(days=1)
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "f", t), (2, "f", t + day), (3, "f", t + 7.9 * day), (4, "f", t + 14.9 * day), (5, "g", t)]
    df = spark.createDataFrame(rows, "transaction_id int, fingerprint string, ts timestamp")
    got = {r["transaction_id"]: (r["run_id"], r["occurrences"]) for r in X.fingerprint_occurrences(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (2, 1), 5: (1, 1)}


def test_burst_window_finds_first_run(spark):
    t = dt.datetime(2024, 1, 1, 10, 0)
    m = dt.timedelta(minutes=1)
    rows = [("a", t), ("a", t + 20 * m), ("a", t + 31 * m), ("a", t + 45 * m), ("b", t), ("b", t + 40 * m), ("b", t + 80 * m)]
    got = X.burst_window(spark.createDataFrame(rows, "graph_id string, ts timestamp")).collect()
    assert [(r["graph_id"], r["burst_start"], r["burst_seconds"]) for r in got] == [("a", t + 20 * m, 1500.0)]


def test_no_python_in_hot_path(spark):
    rows = _payments(rows=10)
    plan = X.point_in_time(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert F is not None
