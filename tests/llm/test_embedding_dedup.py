import numpy as np
import pytest

from ledgerscope.llm import embedding_dedup
from ledgerscope.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    """``id -> (links, component, kept)`` by plain cosines within each label."""
    n = len(rows)
    ok = [
        label is not None and i is not None and bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        for i, v, label in rows
    ]
    root, links = list(range(n)), [0] * n
    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if ok[k]:
            groups.setdefault((label, len(v)), []).append(k)
    for at in groups.values():
        x = np.array([rows[k][1] for k in at], np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        hit = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
        for p, k in enumerate(at):
            for q in np.flatnonzero(hit[p]):
                if q != p:
                    links[k] += 1
                    a, b = k, at[q]
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    root[max(a, b)] = min(a, b)
    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, links[k], least.get(top(k)), i == least.get(top(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def result(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()), key=str)


def planted(seed=0, n=900, d=24):
    """Groups of near copies (chains included), exact copies and unrelated vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.standard_normal(d)
        for _ in range(int(rng.choice([1, 1, 1, 3, 40]))):
            rows.append((base + rng.standard_normal(d) * rng.choice([0, 0.05, 0.25])).tolist())
    ids = rng.permutation(len(rows)).tolist()
    return [(i, v, int(rng.integers(3))) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("tile_rows", [None, 40])
def test_against_plain_cosines(spark, tile_rows):
    rows = planted()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(embedding_dedup.near_duplicates(table, tile_rows=tile_rows)) == brute(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert result(QUERIES["op11_embedding_dedup"][0](spark, folder)) == brute(rows)


def test_hot_vector_and_hot_group(spark):
    rng = np.random.default_rng(5)
    same, base = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(i, same.tolist(), 1) for i in range(0, 600, 2)]
    rows += [(i, (base + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(1, 600, 2)]
    rows += [(600 + i, rng.standard_normal(16).tolist(), 1) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(embedding_dedup.near_duplicates(table, tile_rows=64)) == brute(rows)


def test_threshold_is_met_exactly(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.93, (1 - 0.93**2) ** 0.5], 1), (3, [0.93, 0.3675], 1), (4, [3.0, 4.0], 2), (5, [6.0, 8.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(embedding_dedup.near_duplicates(table)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], None), (4, [1.0, 0.0], "b"),
        (5, None, "a"), (6, [0.0, 0.0], "a"), (7, [nan, 1.0], "a"), (8, [1.0, None], "a"), (9, [-inf, 0.0], "a"), (10, [], "a"),
        (None, [1.0, 0.0], "a"), (11, [1.0, 0.0, 0.0], "a"), (12, [-0.0, 1.0], "b"), (0, [0.0, 1.0], "b"), (13, [1.0], "a"),
    ]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label string, node int")
    got = result(embedding_dedup.near_duplicates(table))
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(table.filter("false")).count() == 0
    assert result(embedding_dedup.near_duplicates(table.filter("vec_id = 6"))) == [(6, 0, 6, True)]


def test_blocks_stop_early():
    """The suffix bound leaves no link out whatever the order of dimensions."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((700, 40)) * np.linspace(3, 0.1, 40)
    x[300:] = x[:400] + rng.standard_normal((400, 40)) * 0.3
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))}
    for axes in (embedding_dedup.Axes.plain(40), embedding_dedup.Axes(unit.mean(axis=0), np.linalg.eigh(np.cov(unit.T))[1][:, ::-1], np.ones(40))):
        tile = embedding_dedup.Tile(x, axes)
        assert {(int(i), int(j)) for a, b in embedding_dedup.tile_links(tile, None, 0.93) for i, j in zip(a, b)} == want
