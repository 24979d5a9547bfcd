"""The nightly feature row of every account: graph metrics, flows and behaviour in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import clamp
from ledgerscope.operators import profile as P
from ledgerscope.operators.graph import basic as B
from ledgerscope.operators.graph.betweenness import betweenness
from ledgerscope.operators.graph.community import communities
from ledgerscope.operators.graph.components import cycle_membership
from ledgerscope.operators.graph.pagerank import personalized_pagerank
from ledgerscope.scale import cut_lineage


def behaviour(txn: DataFrame, as_of: Column) -> DataFrame:
    """Behavioural columns per account from its own payments."""
    day = F.weekday("ts") >= 5
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 5)
    n = F.count(F.lit(1))
    ratios = txn.groupBy("account_id").agg(
        (F.count(F.when(night, 1)) / n).alias("night_txn_ratio"),
        (F.count(F.when(day, 1)) / n).alias("weekend_txn_ratio"),
        (F.countDistinct("payee_account_id") / n).alias("counterparty_novelty"),
        ((F.least(F.countDistinct("channel"), F.lit(5)) - 1) / 4.0).alias("channel_switch"),
        F.least(F.greatest(F.countDistinct("geo_state") - 1, F.lit(0)), F.lit(1)).cast("double").alias("geography_switch"),
    )
    parts = [
        P.account_activity(txn, as_of),
        P.channel_entropy(txn),
        P.burst_and_velocity_ratio(txn, as_of),
        ratios,
    ]
    return reduce(lambda a, b: a.join(b, "account_id", "full"), parts).withColumn(
        "amount_series_score", clamp(F.col("amount_zscore") / 5.0)
    )


def account_graph_features(
    vertices: DataFrame,
    edges: DataFrame,
    txn: DataFrame,
    seeds: DataFrame,
    as_of: Column,
    k: int = 500,
    pagerank_iters: int = 100,
    pagerank_tol: float | None = 1e-6,
) -> DataFrame:
    """One row per account of ``vertices`` with the registry's graph and window columns.

    Every part is one row per account and is keyed by it, so the final step is a
    chain of joins on one key.  Accounts outside the graph get the declared defaults.
    """
    # Six parts read the transfers: stored once, they are not derived six times.
    edges = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select("src", "dst", "amount", "ts"))
    graph = cut_lineage(B.simple_graph(edges))
    degree = P.bipartite_scores(P.sink_scores(P.degrees(edges)))
    ranks = B.fraud_distance_proxy(personalized_pagerank(graph, seeds, iters=pagerank_iters, tol=pagerank_tol))
    member = cut_lineage(communities(graph))
    community = member.join(P.community_stats(member, seeds), "community_id")
    central = B.bridge_probability(betweenness(graph, k=k))
    retention = P.inflow_retention(edges, as_of)
    returned = retention.select(
        "account_id",
        "retention_ratio",
        "inflow_last_30d",
        (F.col("inflow_last_30d") / (F.col("inflow_last_30d") + F.col("outflow_last_30d") + 1e-6)).alias("return_ratio"),
    )
    parts = [
        degree,
        ranks,
        community,
        B.clustering_coefficient(graph).drop("triangles"),
        cycle_membership(graph),
        central,
        P.window_flows(edges, as_of),
        P.days_since(edges, as_of, "receive"),
        P.days_since(edges, as_of, "send"),
        returned,
        behaviour(txn, as_of),
    ]
    base = vertices.select(
        F.col("id").alias("account_id"),
        F.coalesce(F.col("account_age_days").cast("double"), F.lit(0.0)).alias("account_age_days"),
        F.coalesce("kyc_completeness_score", F.lit(0.0)).alias("kyc_completeness_score"),
    )
    wide = reduce(lambda a, b: a.join(b, "account_id", "left"), parts, base)
    defaults = {"days_since_last_receive": 999.0, "community_id": -1.0, "community_size": 1.0, "shortest_path_to_fraud": 10.0}
    # Woken accounts carry both names of the same signal.
    wide = wide.withColumn("dormancy_reactivation_flag", F.col("dormancy_break"))
    names = [n for n in C.GRAPH_FEATURES + C.WINDOW_FEATURES if n != "graph_staleness_hours"]
    return wide.select(
        "account_id",
        *[F.coalesce(F.col(n).cast("double"), F.lit(defaults.get(n, 0.0))).alias(n) for n in names],
        # Silence of the sending side stays null while it has never sent.
        "days_since_last_send",
        F.coalesce("retention_ratio", F.lit(0.0)).alias("retention_ratio"),
        F.coalesce("inflow_last_30d", F.lit(0.0)).alias("inflow_last_30d"),
    )
