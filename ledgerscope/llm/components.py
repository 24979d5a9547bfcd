"""Connected components over a table of links, in few rounds.

Alternating star contraction: links are turned towards the smallest neighbour, once from
larger nodes and once from smaller ones, until nothing changes.  Rounds grow with the
logarithm of the longest chain.  Each round is cut by a reliable checkpoint, so lost
executors cost one round at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``; a local session may use a temp folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="corpus-")
        context.setCheckpointDir(shared)


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them and the node itself.

    ``larger``: only neighbours above the node move; otherwise those below it and itself.
    The smallest comes from a map-side-combined minimum and a join, so a node with very
    many neighbours is not gathered in one place.
    """
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        moved = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(
            least.select(F.col("a").alias("x"), F.col("m").alias("y"))
        )
    return moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with a link."""
    use_checkpoints(links.sparkSession)
    current = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct().checkpoint()
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)")))
    before = current.agg(mark.alias("m")).first()["m"]
    while before[0]:
        after_links = _star(_star(current, True), False).checkpoint()
        after = after_links.agg(mark.alias("m")).first()["m"]
        current = after_links
        if after == before:
            break
        before = after
    # Every link now leads from a node to the smallest of its component.
    nodes = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.unionByName(roots)
