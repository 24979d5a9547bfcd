"""Tree contributions against subset enumeration and the model's own log-odds."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerscope.operators import explain as X
from ledgerscope.operators import models as L

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        a, b, c, d = (round(rnd.random(), 3) for _ in FEATURES)
        rows.append((i, a, b, None if i % 13 == 0 else c, d, int(a * (c > 0.4) + b * d > 0.5) if i % 10 else rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, label int")
    return df, L.train_base(df, FEATURES, depth=4, rounds=6, step=0.3)


def conditional(tree, at, row, known):
    """Expected value of a tree when only some features are known, by training weight."""
    node = tree[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    left, right = tree[node["leftChild"]], tree[node["rightChild"]]
    if node["feature"] in known:
        child = node["leftChild"] if row[node["feature"]] <= node["threshold"] else node["rightChild"]
        return conditional(tree, child, row, known)
    return (
        left["weight"] * conditional(tree, node["leftChild"], row, known)
        + right["weight"] * conditional(tree, node["rightChild"], row, known)
    ) / node["weight"]


def enumerated(trees, weights, row):
    n = len(row)
    value = {
        s: sum(2 * w * conditional(t, 0, row, s) for t, w in zip(trees, weights))
        for r in range(n + 1)
        for s in map(frozenset, itertools.combinations(range(n), r))
    }
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(
            sum(
                math.factorial(r) * math.factorial(n - r - 1) / math.factorial(n) * (value[frozenset(s) | {i}] - value[frozenset(s)])
                for r in range(n)
                for s in itertools.combinations(rest, r)
            )
        )
    return value[frozenset()], out


def test_equal_to_subset_enumeration(spark, fitted):
    df, model = fitted
    nodes = X.node_table(model, spark)
    weights = list(model.stages[-1].treeWeights)
    trees = [{n["id"]: n for n in nodes if n["treeID"] == t} for t in range(len(weights))]
    # Some path splits on a feature twice, which the intervals must merge.
    assert max(len(t) for t in trees) > 9
    rows = df.filter("k % 37 = 0").collect()
    got = {r.k: r for r in X.tree_contributions(df.filter("k % 37 = 0"), model, FEATURES, "k").collect()}
    for r in rows:
        base, want = enumerated(trees, weights, [r[f] or 0.0 for f in FEATURES])
        mine = {c.feature: c.contribution for c in got[r.k].contributions}
        assert abs(got[r.k].expected - base) < 1e-9
        assert np.allclose([mine[f] for f in FEATURES], want, atol=1e-9)


def test_sums_to_the_models_log_odds(fitted):
    df, model = fitted
    p = L.predict(model, df, FEATURES, "p").select("k", "p")
    told = X.tree_contributions(df, model, FEATURES, "k").withColumn(
        "total", F.col("expected") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["contribution"])
    )
    off = told.join(p, "k").select(
        F.max(F.abs(F.col("total") - F.col("log_odds"))).alias("t"),
        F.max(F.abs(1 / (1 + F.exp(-F.col("log_odds"))) - F.col("p"))).alias("p"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    assert off["n"] == 900 and off["t"] < 1e-9 and off["p"] < 1e-9


def test_odd_rows(spark, fitted):
    _, model = fitted
    nan = float("nan")
    rows = [(None, 0.1, None, None, nan), (7, nan, nan, nan, nan), (7, 0.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    got = X.tree_contributions(df, model, FEATURES, "k").collect()
    vectors = [Vectors.dense([v if v is not None else 0.0 for v in r[1:]]) for r in rows]
    boosted = model.stages[-1]
    want = sorted(2 * sum(w * t.predict(v) for w, t in zip(boosted.treeWeights, boosted.trees)) for v in vectors)
    assert np.allclose(sorted(r.log_odds for r in got), want)
    assert X.tree_contributions(df.filter("false"), model, FEATURES, "k").count() == 0
    assert X.long_form(X.tree_contributions(df, model, FEATURES, "k"), "k").count() == 12


def test_unsplit_tree():
    nodes = [{"treeID": 0, "id": 0, "prediction": 0.25, "leftChild": -1, "rightChild": -1, "weight": 4.0, "feature": -1, "threshold": None, "categorical": False}]
    table = X.leaves(nodes, [2.0])
    assert X.shapley(np.zeros((3, 2)), table).tolist() == [[0, 0]] * 3 and table[0].expected == 0.5
