"""Simple graphs, clustering, breadth-first distances and community tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.scale import cut_lineage


def simple_graph(edges: DataFrame, weight: str = "sum") -> DataFrame:
    """One row per (src, dst); parallel transfers are added up, or the latest one wins."""
    if weight == "sum":
        value = F.sum("amount")
    elif weight == "last":
        value = F.max_by("amount", F.struct("ts", "transaction_id"))
    else:
        raise ValueError("weight must be 'sum' or 'last'")
    return edges.groupBy("src", "dst").agg(value.alias("weight"))


def undirected(graph: DataFrame) -> DataFrame:
    """Unordered pairs without loops; both directions are added up."""
    return (
        graph.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum("weight").alias("weight"))
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair as two directed rows."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(
        pairs.select("b", "a", "weight")
    )


def node_ids(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("id")).union(graph.select("dst")).distinct()


# Wedges of one task.
WEDGE_ROWS = 2_000_000


def clustering_coefficient(graph: DataFrame) -> DataFrame:
    """Share of closed pairs of neighbours, on the undirected graph.

    Edges point from the lower to the higher degree, so no node has more than
    sqrt(2m) outgoing edges and a hub is never the middle of a wedge join.
    """
    pairs = cut_lineage(undirected(graph).select("a", "b"))
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    degree = cut_lineage(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    da = degree.select(F.col("id").alias("a"), F.col("degree").alias("da"))
    db = degree.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    ranked = pairs.join(da, "a").join(db, "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    oriented = cut_lineage(
        ranked.select(
            F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"),
            F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"),
        )
    )
    first = oriented.select("u", F.col("v").alias("v"))
    second = oriented.select("u", F.col("v").alias("w"))
    wedges = first.join(second, "u").filter(F.col("v") < F.col("w"))
    # Wedges grow faster than links: as many parts as keep one task's sort small.
    out = oriented.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    total = out.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("n")).first()["n"] or 0
    parts = max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * WEDGE_ROWS)))
    wedges = wedges.repartition(parts, "v", "w")
    closing = oriented.select(
        F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")
    )
    triangles = wedges.join(closing, (wedges["v"] == closing["x"]) & (wedges["w"] == closing["y"]))
    corners = triangles.select(F.explode(F.array("u", "v", "w")).alias("id"))
    counted = corners.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = F.col("degree")
    return degree.join(counted, "id", "left").select(
        F.col("id").alias("account_id"),
        F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.when(d > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1)))
        .otherwise(0.0)
        .alias("clustering_coefficient"),
    )


def hops_to_fraud(graph: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Fewest transfers, in either direction, between an account and a known-fraud account.

    Runs until no account is new; ``max_hops`` leaves farther accounts out on request.
    """
    links = cut_lineage(both_ways(undirected(graph)).select("src", "dst"))
    nodes = node_ids(graph)
    start = seeds.select(F.col("account_id").alias("id")).distinct().join(nodes, "id", "left_semi")
    reached = cut_lineage(start.withColumn("hops", F.lit(0)))
    frontier = reached.select("id")
    for hop in count(1):
        if max_hops is not None and hop > max_hops:
            break
        following = (
            frontier.join(links, frontier["id"] == links["src"])
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(reached.select("id"), "id", "left_anti")
        )
        following = cut_lineage(following)
        if not following.take(1):
            break
        reached = reached.union(following.withColumn("hops", F.lit(hop)))
        frontier = following
    return reached.select(F.col("id").alias("account_id"), "hops")


def fraud_distance_proxy(ranks: DataFrame) -> DataFrame:
    """Distance read off the seeded rank: 10 for rank 0, down to 1 from a rank of 0.009."""
    pr = F.col("pagerank_fraud_seeded")
    near = F.greatest(10.0 * (1.0 - F.least(pr * 100, F.lit(1.0))), F.lit(1.0))
    return ranks.withColumn("shortest_path_to_fraud", F.when(pr <= 0, 10.0).otherwise(near))


def bridge_probability(centrality: DataFrame) -> DataFrame:
    """Betweenness relative to the largest one."""
    top = centrality.agg(F.max("betweenness_centrality").alias("m")).scalar()
    return centrality.withColumn(
        "bridge_node_probability",
        F.when(top > 0, F.col("betweenness_centrality") / top).otherwise(F.col("betweenness_centrality")),
    )


def hyperedges(membership: DataFrame) -> DataFrame:
    """Node and hyperedge rows of communities with at least two members."""
    groups = (
        membership.filter(F.col("community_id") >= 0)
        .groupBy("community_id")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= 2)
        .select("community_id")
    )
    return membership.join(groups, "community_id", "left_semi").select(
        F.col("account_id").alias("node"), F.col("community_id").alias("hyperedge")
    )
