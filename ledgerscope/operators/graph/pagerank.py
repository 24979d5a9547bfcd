"""Amount-weighted PageRank that restarts at known-fraud accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.graph.basic import node_ids
from ledgerscope.scale import cut_lineage


def personalized_pagerank(
    graph: DataFrame,
    seeds: DataFrame | None = None,
    alpha: float = 0.85,
    iters: int = 100,
    tol: float | None = 1e-6,
) -> DataFrame:
    """Rank of every account; restarts and the mass of dead ends go to the seeds.

    Without a seed in the graph the restart is uniform.  One round is a join of the
    transition table with the ranks and a map-side-combined sum per receiver; the
    ranks are materialised each round, and two sums over them (dead-end mass and
    the change) come back to the driver.  ``tol=None`` runs exactly ``iters`` rounds.
    """
    positive = graph.filter(F.col("weight") > 0)
    out = positive.groupBy("src").agg(F.sum("weight").alias("__out"))
    steps = cut_lineage(
        positive.join(out, "src").select("src", "dst", (F.col("weight") / F.col("__out")).alias("share"))
    )
    nodes = cut_lineage(node_ids(graph))
    n = nodes.count()
    if n == 0:
        return nodes.select(F.col("id").alias("account_id"), F.lit(0.0).alias("pagerank_fraud_seeded"))
    marked = nodes.withColumn("__seed", F.lit(False))
    seeded = 0
    if seeds is not None:
        known = seeds.select(F.col("account_id").alias("id")).distinct().withColumn("__seed", F.lit(True))
        marked = nodes.join(known, "id", "left").withColumn("__seed", F.coalesce("__seed", F.lit(False)))
        seeded = marked.filter("__seed").count()
    restart = F.when(F.col("__seed"), 1.0 / seeded).otherwise(0.0) if seeded else F.lit(1.0 / n)
    senders = steps.select(F.col("src").alias("id")).distinct().withColumn("__sends", F.lit(True))
    ranks = cut_lineage(
        marked.join(senders, "id", "left").select(
            "id",
            F.lit(1.0 / n).alias("rank"),
            restart.alias("restart"),
            F.col("__sends").isNull().alias("dead_end"),
            F.lit(0.0).alias("change"),
        )
    )
    lost = ranks.agg(F.sum(F.when(F.col("dead_end"), F.col("rank")))).first()[0] or 0.0
    for _ in range(iters):
        received = (
            steps.join(ranks.select(F.col("id").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("__in"))
        )
        fresh = alpha * F.coalesce("__in", F.lit(0.0)) + (alpha * lost + 1.0 - alpha) * F.col("restart")
        ranks = cut_lineage(
            ranks.join(received, "id", "left").select(
                "id",
                fresh.alias("rank"),
                "restart",
                "dead_end",
                F.abs(fresh - F.col("rank")).alias("change"),
            )
        )
        lost, change = ranks.agg(
            F.sum(F.when(F.col("dead_end"), F.col("rank"))), F.sum("change")
        ).first()
        lost = lost or 0.0
        if tol is not None and change < n * tol:
            break
    return ranks.select(F.col("id").alias("account_id"), F.col("rank").alias("pagerank_fraud_seeded"))
