"""Strongly connected components by colouring, and peeling of acyclic parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.scale import cut_lineage


def trim(links: DataFrame, keys: list[str]) -> DataFrame:
    """Drop links that start at a node nobody reaches or end at one that leads nowhere."""
    size = links.count()
    while size:
        starts = links.select(*keys, F.col("src").alias("dst")).distinct()
        ends = links.select(*keys, F.col("dst").alias("src")).distinct()
        links = cut_lineage(
            links.join(starts, [*keys, "dst"], "left_semi").join(ends, [*keys, "src"], "left_semi")
        )
        left = links.count()
        if left == size:
            break
        size = left
    return links


def strong_components(graph: DataFrame) -> DataFrame:
    """Accounts on directed cycles with the id of their component: ``(account_id, component)``.

    Accounts that are a component of their own are left out.  Each outer round
    spreads the largest id along the links, then walks back from every account
    that kept its own id; what it reaches within its colour is its component.
    """
    links = cut_lineage(graph.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    found: list[DataFrame] = []
    while True:
        links = trim(links, [])
        if not links.take(1):
            break
        colour = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
        colour = cut_lineage(colour.withColumn("colour", F.col("id")))
        while True:
            offered = (
                links.join(colour.select(F.col("id").alias("src"), "colour"), "src")
                .groupBy(F.col("dst").alias("id"))
                .agg(F.max("colour").alias("__new"))
            )
            raised = colour.join(offered, "id", "left").select(
                "id",
                F.greatest("colour", F.coalesce("__new", "colour")).alias("colour"),
                (F.coalesce("__new", "colour") > F.col("colour")).alias("moved"),
            )
            raised = cut_lineage(raised)
            colour = raised.select("id", "colour")
            if not raised.filter("moved").take(1):
                break
        same = links.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src")
        same = same.join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst")
        links = cut_lineage(same.filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        reached = cut_lineage(colour.filter(F.col("id") == F.col("colour")).select("id", "colour"))
        frontier, rounds = reached, 0
        while True:
            back = (
                links.join(frontier.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"])
                .select(F.col("src").alias("id"), "colour")
                .distinct()
                .join(reached.select("id"), "id", "left_anti")
            )
            frontier = cut_lineage(back)
            if not frontier.take(1):
                break
            reached, rounds = reached.union(frontier), rounds + 1
            if rounds % 10 == 0:
                reached = cut_lineage(reached)
        found.append(reached)
        rest = links.join(reached.select(F.col("id").alias("src")), "src", "left_anti")
        links = cut_lineage(rest.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if not found:
        return graph.select(F.col("src").alias("account_id"), F.col("src").alias("component")).limit(0)
    members = reduce(DataFrame.union, found).select(
        F.col("id").alias("account_id"), F.col("colour").alias("component")
    )
    members = cut_lineage(members)
    several = (
        members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    )
    return members.join(several, "component", "left_semi").select("account_id", "component")


def cycle_membership(graph: DataFrame) -> DataFrame:
    """1 for accounts in a component of more than one account, else 0."""
    nodes = graph.select(F.col("src").alias("account_id")).union(graph.select("dst")).distinct()
    members = strong_components(graph).select("account_id", F.lit(1.0).alias("__hit"))
    return nodes.join(members, "account_id", "left").select(
        "account_id", F.coalesce("__hit", F.lit(0.0)).alias("cycle_membership")
    )


def chain_heads(edges: DataFrame, chains: DataFrame, key: str = "graph_id", deeper: int = 3, n: int = 6) -> DataFrame:
    """The first ``n`` accounts of one longest path of each acyclic graph deeper than ``deeper``.

    Of equally long continuations the smallest account is taken.  Nodes are peeled from
    the ends of the paths; the round a node still sends in is the longest path from it.
    """
    deep = cut_lineage(chains.filter(F.col("depth") > deeper).select(key, "depth"))
    links = cut_lineage(edges.join(deep.select(key), key, "left_semi").select(key, "src", "dst").distinct())
    heights, remaining, level = None, links, 0
    while remaining.take(1):
        level += 1
        senders = remaining.select(key, F.col("src").alias("node")).distinct()
        marked = senders.withColumn("height", F.lit(level))
        heights = marked if heights is None else heights.unionByName(marked)
        remaining = cut_lineage(remaining.join(senders.withColumnRenamed("node", "dst"), [key, "dst"], "left_semi"))
    if heights is None:
        return links.select(key, F.col("src").alias("account_id"))
    height = cut_lineage(heights.groupBy(key, "node").agg(F.max("height").alias("height")))
    tip = height.join(deep, key).filter("height = depth").groupBy(key).agg(F.min("node").alias("src"), F.first("height").alias("h"))
    # One step of a longest path: the height falls by one.
    falls = links.join(height.select(key, F.col("node").alias("dst"), "height"), [key, "dst"], "left").select(
        key, "src", "dst", F.coalesce("height", F.lit(0)).alias("rest")
    )
    found = tip.select(key, F.col("src").alias("account_id"))
    for _ in range(n - 1):
        after = tip.join(falls, [key, "src"]).filter(F.col("rest") == F.col("h") - 1)
        tip = cut_lineage(after.groupBy(key).agg(F.min("dst").alias("src"), F.first("rest").alias("h")))
        found = found.unionByName(tip.select(key, F.col("src").alias("account_id")))
    return found


def longest_chain(edges: DataFrame, key: str = "graph_id") -> DataFrame:
    """Longest directed path of each graph in links, and whether the graph has a cycle.

    Every round peels the nodes without incoming links from all graphs at once;
    the round a node leaves in is the length of the longest path ending there.
    Nodes that never leave hang on a cycle, and ``depth`` is null for their graph.
    """
    loops = edges.groupBy(key).agg(F.max(F.col("src") == F.col("dst")).alias("has_loop"))
    links = cut_lineage(edges.filter(F.col("src") != F.col("dst")).select(key, "src", "dst").distinct())
    depth = loops.select(key, "has_loop", F.lit(0).alias("depth"))
    level = 0
    while True:
        targets = links.select(key, F.col("dst").alias("src")).distinct()
        remaining = cut_lineage(links.join(targets, [key, "src"], "left_semi"))
        level += 1
        shrunk = (
            links.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
            .join(remaining.groupBy(key).agg(F.count(F.lit(1)).alias("after")), key, "left")
            .filter(F.coalesce("after", F.lit(0)) < F.col("before"))
            .select(key)
        )
        shrunk = cut_lineage(shrunk.withColumn("__level", F.lit(level)))
        if not shrunk.take(1):
            break
        depth = cut_lineage(
            depth.join(shrunk, key, "left").select(
                key, "has_loop", F.coalesce("__level", "depth").alias("depth")
            )
        )
        links = remaining
    stuck = links.select(key).distinct().withColumn("__stuck", F.lit(True))
    return depth.join(stuck, key, "left").select(
        key,
        F.coalesce("__stuck", F.lit(False)).alias("cyclic"),
        (F.coalesce("__stuck", F.lit(False)) | F.col("has_loop")).alias("not_acyclic"),
        F.when(F.col("__stuck").isNull() & ~F.col("has_loop"), F.col("depth")).alias("depth"),
    )
