"""Score small transfer graphs by their shape: seven gates per graph, all graphs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.rules import near_threshold_pct, score_to_action
from ledgerscope.operators.context import burst_window
from ledgerscope.operators.graph.components import chain_heads, longest_chain, strong_components
from ledgerscope.scale import cut_lineage, micros, top_per_key


def _usable(edges: DataFrame) -> DataFrame:
    return edges.filter(
        F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("amount") > 0)
    )


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct links; of parallel transfers the latest amount counts."""
    return edges.groupBy("graph_id", "src", "dst").agg(
        F.max_by("amount", F.struct("ts", "transaction_id")).alias("amount")
    )


def _node_sides(pairs: DataFrame) -> DataFrame:
    both = pairs.select("graph_id", F.col("src").alias("node"), F.lit("out").alias("side"), "amount").union(
        pairs.select("graph_id", "dst", F.lit("in"), "amount")
    )
    out, into = F.col("side") == "out", F.col("side") == "in"
    return both.groupBy("graph_id", "node").agg(
        F.count(F.when(out, 1)).alias("n_out"),
        F.count(F.when(into, 1)).alias("n_in"),
        F.sum(F.when(out, F.col("amount"))).alias("outflow"),
        F.sum(F.when(into, F.col("amount"))).alias("inflow"),
    )


def score_graphs(edges: DataFrame) -> DataFrame:
    """Score, verdict, leading fraud type and signals of every ``graph_id``.

    ``edges`` has ``graph_id, src, dst, amount, ts, transaction_id``.  The fan-in
    score is that of the smallest account id with four senders.
    """
    rows = cut_lineage(_usable(edges))
    pairs = cut_lineage(_pairs(rows))
    nodes = cut_lineage(_node_sides(pairs))
    conservation = F.col("outflow") / F.col("inflow")
    relays = (F.col("n_in") >= 2) & (F.col("n_out") >= 1) & (F.col("inflow") > 0) & (conservation >= 0.80)
    collector = F.when(F.col("n_in") >= 4, F.struct("node", "n_in"))
    shape = nodes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.max(F.col("n_out") >= 4).alias("fan_out"),
        F.min(collector).alias("collector"),
        F.max(F.when(relays, F.least(0.78 + (conservation - 0.80) * 0.50, F.lit(0.95)))).alias("relay_score"),
    )
    links = pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("transactions_scored"))
    money = rows.groupBy("graph_id").agg(
        F.count(F.when(near_threshold_pct(F.col("amount")), 1)).alias("n_near"),
        F.max("amount").alias("top_amount"),
        F.sum("amount").alias("total"),
        F.count(F.lit(1)).alias("n_edges"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 1_000_000.0).alias("span_s"),
    )
    repeated = (
        rows.groupBy("graph_id", F.bround("amount", 2).alias("a"))
        .agg(F.count(F.lit(1)).alias("c"))
        .filter((F.col("c") >= 3) & (F.col("a") > 1_000))
        .select("graph_id")
        .distinct()
        .withColumn("repeats", F.lit(True))
    )
    bursts = burst_window(rows).select("graph_id", F.lit(True).alias("burst"))
    chains = longest_chain(pairs)
    wide = reduce(
        lambda a, b: a.join(b, "graph_id", "left"), [shape, links, money, chains, repeated, bursts]
    )
    n_in = F.col("collector.n_in")
    structured = F.col("n_near") >= 2
    fast = (F.col("n_edges") >= 2) & (F.col("span_s") < 600) & (F.col("total") > 200_000)
    gates = [
        (F.col("cyclic"), F.lit(0.97), "circular_transfer_fraud", "circular_path_detected"),
        (F.col("fan_out"), F.lit(0.85), "smurfing_fan_out", "fan_out_detected"),
        (
            n_in.isNotNull(),
            F.least(0.82 + (n_in - 4) * 0.02, F.lit(0.92)),
            "mule_network_aggregation",
            "bipartite_collector",
        ),
        (F.col("relay_score").isNotNull(), F.col("relay_score"), "rapid_relay_mule", "relay_conservation"),
        (
            F.col("depth") > 3,
            0.75 + F.least((F.col("depth") - 3) * 0.04, F.lit(0.10)),
            "layering_chain",
            "chain_depth_exceeded",
        ),
        # A graph that is not acyclic and not small scores without naming a signal.
        (F.col("not_acyclic") & (F.col("n_nodes") > 4), F.lit(0.78), None, None),
        (
            structured,
            F.least(0.72 + (F.col("n_near") - 2) * 0.08, F.lit(0.88)),
            "structuring_below_threshold",
            "near_threshold_clustering",
        ),
        (
            ~structured & F.col("repeats"),
            F.lit(0.72),
            "structuring_below_threshold",
            "repeated_amount_structuring",
        ),
        (F.col("burst"), F.lit(0.65), "rapid_transfer_burst", "burst_30min_window"),
        (fast, F.lit(0.60), "rapid_transfer_burst", "high_velocity_transfer"),
    ]
    held = [(F.coalesce(test, F.lit(False)), score, kind, signal) for test, score, kind, signal in gates]
    large = F.col("top_amount") >= 500_000
    parts = [F.when(test, score) for test, score, _, _ in held] + [F.when(large, 0.45)]
    named = [(test, kind, signal) for test, _, kind, signal in held if kind]
    any_named = reduce(lambda a, b: a | b, [t for t, _, _ in named])
    signals = F.array_compact(
        F.array(
            *[F.when(test, F.lit(signal)) for test, _, signal in named],
            F.when(large & ~any_named, F.lit("large_amount_threshold")),
        )
    )
    first = F.coalesce(
        *[F.when(test, F.lit(kind)) for test, kind, _ in named],
        F.when(large, F.lit("large_value_transfer")),
    )
    score = F.bround(F.coalesce(F.greatest(*parts), F.lit(0.0)), 4)
    action = score_to_action(F.col("score"))
    verdict = (
        F.when(action == "HIGH_RISK", "FRAUD")
        .when(action == "REVIEW", "SUSPICIOUS")
        .when(action == "LOG", "LOGGED")
        .otherwise("CLEAN")
    )
    scored = wide.select(
        "graph_id", score.alias("score"), first.alias("__first"), signals.alias("signals"), "transactions_scored"
    ).withColumn("verdict", verdict)
    fallback = F.when(F.col("verdict") == "CLEAN", "none").otherwise("unknown_pattern")
    scored = scored.withColumn("fraud_type", F.coalesce("__first", fallback)).drop("__first")
    # Graphs without a usable transfer are clean.
    every = edges.select("graph_id").distinct()
    return every.join(scored, "graph_id", "left").select(
        "graph_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("verdict", F.lit("CLEAN")).alias("verdict"),
        F.coalesce("fraud_type", F.lit("none")).alias("fraud_type"),
        F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
        F.coalesce("verdict", F.lit("CLEAN")).isin("FRAUD", "SUSPICIOUS").alias("flagged"),
        F.coalesce("transactions_scored", F.lit(0)).alias("transactions_scored"),
    )


def flagged_accounts(edges: DataFrame) -> DataFrame:
    """Accounts each graph's gates point at: ``(graph_id, account_id, reason)``.

    Cycle members; fan-out and fan-in centres with their first six partners;
    relays with four partners on each side; the first six accounts of a longest
    chain; ends of structured amounts, or else of amounts that repeat.
    """
    rows = cut_lineage(_usable(edges))
    pairs = cut_lineage(_pairs(rows))
    nodes = cut_lineage(_node_sides(pairs))
    keyed = pairs.select(
        F.struct("graph_id", F.col("src").alias("n")).alias("src"),
        F.struct("graph_id", F.col("dst").alias("n")).alias("dst"),
    )
    ring = strong_components(keyed).select(
        F.col("account_id.graph_id").alias("graph_id"),
        F.col("account_id.n").alias("account_id"),
        F.lit("circular_path").alias("reason"),
    )
    out_center = top_per_key(nodes.filter(F.col("n_out") >= 4), ["graph_id"], [F.asc("node")], 1)
    in_center = top_per_key(nodes.filter(F.col("n_in") >= 4), ["graph_id"], [F.asc("node")], 1)
    relay = nodes.filter(
        (F.col("n_in") >= 2) & (F.col("n_out") >= 1) & (F.col("outflow") / F.col("inflow") >= 0.80)
    )

    def around(center, mine, other, n, reason):
        chosen = center.select("graph_id", F.col("node").alias(mine))
        partners = top_per_key(
            pairs.join(chosen, ["graph_id", mine], "left_semi"), ["graph_id", mine], [F.asc(other)], n
        ).select("graph_id", F.col(other).alias("account_id"))
        return partners.union(center.select("graph_id", "node")).withColumn("reason", F.lit(reason))

    parts = [
        ring,
        around(out_center, "src", "dst", 6, "fan_out"),
        around(in_center, "dst", "src", 6, "fan_in"),
        around(relay, "src", "dst", 4, "relay"),
        around(relay, "dst", "src", 4, "relay"),
    ]
    near = rows.filter(near_threshold_pct(F.col("amount")))
    enough = near.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("graph_id")
    ends = near.join(enough, "graph_id", "left_semi")
    parts.append(
        ends.select("graph_id", F.explode(F.array("src", "dst")).alias("account_id"), F.lit("structuring").alias("reason"))
    )
    parts.append(chain_heads(pairs, longest_chain(pairs)).withColumn("reason", F.lit("layering_chain")))
    same = rows.withColumn("__a", F.bround("amount", 2)).filter(F.col("__a") > 1_000)
    often = same.groupBy("graph_id", "__a").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("graph_id", "__a")
    repeats = same.join(often, ["graph_id", "__a"], "left_semi").join(enough, "graph_id", "left_anti")
    parts.append(
        repeats.select("graph_id", F.explode(F.array("src", "dst")).alias("account_id"), F.lit("repeated_amount").alias("reason"))
    )
    return reduce(DataFrame.unionByName, parts).distinct()


