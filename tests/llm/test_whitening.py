from fractions import Fraction
from math import floor

import numpy as np
import pytest

from ledgerscope.llm import whitening
from ledgerscope.llm.queries import QUERIES


def brute(rows):
    """Plain fractions over the fit list; centred before multiplying."""
    ok = [(i, [floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[n * x[j] - sums[j] for j in range(d)] for x in fit], object)
    v = np.array([[float(Fraction(int(s), n**3)) for s in row] for row in y.T.dot(y)])
    return ok, n, sums, v


def check(got, rows, k=4):
    ok, n, sums, v = brute(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u.T[::-1]
    k = min(k, len(e))
    assert len(got) == len(ok) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for c in range(1, k + 1):
        mine = np.array([by[i][c].whitened for i, _ in ok])
        want = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in ok]) @ u[c - 1] / e[c - 1] ** 0.5
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-8
        assert all(abs(by[i][c].explained - e[c - 1] / v.trace()) < 1e-9 for i, _ in ok)
    for i, x in ok:
        assert {r.deviation for r in by[i].values()} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_against_fractions(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"][0](spark, folder).collect(), rows)


def test_copies_count_once_and_many_tasks(spark):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(6).tolist()
    rows = [(i, same if i % 3 else (rng.standard_normal(6) * [5, 3, 2, 1, 1, 1]).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check(whitening.report(table).collect(), rows)


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits in (10, 24, 40, 61):
        z = rng.integers(-(2**bits), 2**bits, (300, 5))
        want = [sum(int(v) ** 2 for v in z[:, j]) for j in range(5)]
        assert whitening.square_sums(z).tolist() == want
        assert whitening.square_sums(z.astype(object)).tolist() == want


def test_large_values(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(2**40, 1), (-(2**41), 5), (2**39, -7), (3, 2**33)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.report(table).collect()
    assert {r.deviation for r in got} == {None}
    ok, n, sums, v = brute(rows)
    model = whitening.fit(whitening.distinct_vectors(whitening.scaled(table)))
    assert model.sums == sums and np.allclose(model.covariance, v, rtol=1e-15)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 0.0], 0), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1),
        (6, [inf, 0.0], 1), (7, [1.0], 1), (8, [], 1), (9, [-0.001, 2.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = whitening.report(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {3}
    assert whitening.report(table.filter("false")).count() == 0
    assert whitening.report(table.filter("false")).columns == whitening.report(table).columns


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, rows):
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}


def test_component_without_variance(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert got[0].identity_error < 1e-12
