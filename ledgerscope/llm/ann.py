"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length one, where the largest cosine is the smallest distance.  A
Gaussian (2-stable) projection to ``DIMS`` dimensions keeps distances in law: the squared
projected distance over the squared distance is chi-squared with ``DIMS`` degrees of
freedom.  Points are spread evenly over chunks by a hash of their row number; each chunk builds a
kd-tree over its projected points.  A query takes the leaves in order of their projected
distance and checks their points exactly, until the chi-squared test says that a point as
near as the k-th found would, with probability ``CONFIDENCE``, have been projected nearer
than the next leaf.

A bounded sample of vectors gives each query a first bound of its k-th distance; all rows
are indexed.  Queries go out in blocks of ``QUERY_BLOCK``; only one block is on the driver
at a time, and any number of blocks is handled.

Defined results: null, zero and non-finite vectors, those with a null component, rows
without id, and vectors that have not the most frequent length take no part; copies of a
vector are candidates each, ties go to the smaller id; of rows that repeat an id, each is
a candidate and the one with the smallest hash is the query, which all but its own row may
answer; fewer candidates than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.frames import column, starts_of, stream_groups

DIMS = 12
CONFIDENCE = 0.97
LEAF = 128
CHUNK_ROWS = 16_384
QUERY_BLOCK = 16_384
SAMPLE = 1_024
SEED = 20_240_607


def chi_squared_quantile(p: float, k: int) -> float:
    """By the Wilson-Hilferty normal form."""
    spread = 2 / (9 * k)
    return k * (1 - spread + NormalDist().inv_cdf(p) * spread**0.5) ** 3


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    rows = vectors.select(column(vec_id).alias("id"), column(embedding).cast("array<double>").alias("v")).filter(
        "id IS NOT NULL AND size(v) > 0 "
        "AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
        "AND exists(v, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


class Tree:
    """kd-tree of projected points: leaves as ranges of an order, each with its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            part = points[order[a:b]]
            width = part.max(axis=0) - part.min(axis=0) if b > a else np.zeros(1)
            if b - a <= leaf or width.max() == 0:
                self.bounds.append((a, b))
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, width.argmax()], middle)]
            stack += [(a, a + middle), (a + middle, b)]
        self.order = order
        boxes = [points[order[a:b]] for a, b in self.bounds]
        self.low = np.array([x.min(axis=0) for x in boxes])
        self.high = np.array([x.max(axis=0) for x in boxes])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance of ``q`` to each leaf's box."""
        off = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (off * off).sum(axis=1)


def _search(tree, points, vectors, norms, ids, own, q, q_norm, q_row, projected, k, bound, factor):
    """The ``k`` nearest of one chunk: scores and positions, best first."""
    near = tree.distances(projected)
    best_score, best_at = np.zeros(0), np.zeros(0, np.int64)
    for leaf in np.argsort(near, kind="stable"):
        limit = factor * bound + 1e-9
        if near[leaf] > limit:
            break
        a, b = tree.bounds[leaf]
        at = tree.order[a:b]
        off = points[at] - projected
        at = at[((off * off).sum(axis=1) <= limit) & (own[at] != q_row)]
        if not len(at):
            continue
        # Row-wise sums: equal vectors get equal scores wherever they lie.
        score = (vectors[at] * q).sum(axis=1) / (norms[at] * q_norm)
        best_score, best_at = np.concatenate((best_score, score)), np.concatenate((best_at, at))
        if len(best_at) > k:
            keep = np.lexsort((ids[best_at], -best_score))[:k]
            best_score, best_at = best_score[keep], best_at[keep]
        if len(best_at) == k:
            bound = min(bound, max(0.0, 2 - 2 * float(best_score.min())))
    return best_score, best_at


def _block_search(rows: DataFrame, queries: list[tuple], sample: np.ndarray, k: int, chunks: int) -> DataFrame:
    """The nearest of each chunk for one block of queries."""
    dims = len(queries[0][1])
    vectors = np.array([v for _, v, _ in queries], np.float64)
    # A block of queries and a bounded sample.
    ids_rows = np.array([i for i, _, _ in queries]), np.array([r for _, _, r in queries], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((*ids_rows, vectors, sample))
    chunked = rows.select(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), "id", "row", "v")

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict]:
        q_ids, q_rows, q, seeds = shared.value
        project = np.random.default_rng(SEED).standard_normal((dims, DIMS))
        factor = chi_squared_quantile(CONFIDENCE, DIMS)
        q_norms = np.sqrt((q * q).sum(axis=1))
        q_points = (q / q_norms[:, None]) @ project
        bounds = _seed_bounds(q / q_norms[:, None], seeds, k)
        for part in parts:
            edges = starts_of(part["chunk"])
            for a, b in zip(edges[:-1], edges[1:]):
                ids, own = part["id"][a:b], part["row"][a:b]
                x = np.stack(part["v"][a:b])
                norms = np.sqrt((x * x).sum(axis=1))
                points = (x / norms[:, None]) @ project
                tree = Tree(points)
                found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                for i in range(len(q)):
                    score, at = _search(
                        tree, points, x, norms, ids, own, q[i], q_norms[i], q_rows[i], q_points[i], k, bounds[i], factor
                    )
                    found["query_id"] += [q_ids[i]] * len(at)
                    found["vec_id"] += ids[at].tolist()
                    found["score"] += score.tolist()
                yield found

    return stream_groups(chunked, ["chunk"], [], "query_id long, vec_id long, score double", work)


def _seed_bounds(units: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """A squared distance within which each query surely has ``k`` neighbours.

    The sample may hold the query itself, so one more is asked for.
    """
    if len(seeds) <= k:
        return np.full(len(units), 4.0)
    cosine = np.concatenate([np.partition(u @ seeds.T, -k - 1, axis=1)[:, -k - 1] for u in np.array_split(units, -(-len(units) // 1024))])
    return np.clip(2 - 2 * cosine + 1e-9, 0, 4)


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, by cosine.

    ``is_query`` is a condition on the column ``id``.
    """
    from ledgerscope.llm.components import use_checkpoints

    spark = vectors.sparkSession
    use_checkpoints(spark)
    # Read for the sample, the counts and once a block.
    rows = usable(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    first = F.min_by(F.struct("v", "row"), F.struct(F.xxhash64("v"), F.col("row"))).alias("q")
    queries = rows.filter(is_query).groupBy("id").agg(first).select("id", "q.v", "q.row")
    n, wanted = rows.count(), queries.count()
    seeds = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()], np.float64)
    if n:
        seeds = seeds / np.sqrt((seeds * seeds).sum(axis=1))[:, None]
    chunks, blocks = max(1, -(-n // CHUNK_ROWS)), max(1, -(-wanted // QUERY_BLOCK))
    found = []
    for i in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == i).collect()
        if block:
            found.append(_block_search(rows, [(r["id"], r["v"], r["row"]) for r in block], seeds, k, chunks))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
