import numpy as np
from pyspark.sql import functions as F

from ledgerscope.llm import ann
from ledgerscope.llm.queries import QUERIES


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x * x[i]).sum(axis=1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = r
    hits = sum(v in found.get(q, {}) for q, near in want.items() for v, _ in near)
    for q, near in want.items():
        ranks = sorted(found[q].values(), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranks] == list(range(1, len(near) + 1))
        assert [(-r.score, r.vec_id) for r in ranks] == sorted((-r.score, r.vec_id) for r in ranks)
    return hits / max(1, sum(map(len, want.values())))


def test_query_recall(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        want = brute(rows)
        got = QUERIES["op9_neighbours"][0](spark, folder).collect()
        assert len(got) == sum(map(len, want.values()))
        assert recall(got, want) >= 0.9
        exact = {(q, v): s for q, near in want.items() for v, s in near}
        assert all(abs(exact.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-12 for r in got)


def test_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 100)
    assert recall(ann.nearest(table, F.col("id") % 50 == 0).collect(), brute(rows)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 1.0], 2), (3, None, 2), (4, [0.0, 0.0], 2), (5, [nan, 1.0], 2),
        (6, [1.0, None], 2), (7, [inf, 1.0], 2), (None, [1.0, 0.0], 2), (8, [1.0, 0.0, 0.0], 2), (9, [3.0, 0.0], 2), (9, [3.0, 0.0], 2),
        (50, None, 3), (10, [], 3),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = ann.nearest(table, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 9), (0, 9), (0, 2)]
    assert abs(got[-1].score - 0.5**0.5) < 1e-15
    assert ann.nearest(table.filter("false"), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(table.filter("vec_id = 0"), F.col("id") % 50 == 0).count() == 0


def test_rows_that_repeat_a_query_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (0, [1.0, 0.0]), (7, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 0), (0, 0), (0, 7)]


def test_copies_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(64).tolist()
    rows = [(i, same if i % 3 else rng.standard_normal(64).tolist()) for i in range(1_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4, 5, 7]
