"""Random-walk embeddings of accounts."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.operators.graph.basic import both_ways, undirected
from ledgerscope.scale import cut_lineage


def _draw_table(links: DataFrame, parts: int = 64) -> DataFrame:
    """Neighbour lookup for weighted draws: ``(id, slot, lo, hi, nbr, deg)``.

    A node of degree d has d equal slots over [0, 1); each neighbour covers the
    slots its share overlaps, at most 2d rows in all.  A draw finds its slot by an
    equi-join and meets two rows of it on average, however large the hub is.
    Shares are cumulated in hashed parts of the neighbour list.
    """
    parted = links.withColumn("__part", F.pmod(F.xxhash64("dst"), F.lit(parts)))
    sums = parted.groupBy("src", "__part").agg(
        F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("__n")
    )
    whole = Window.partitionBy("src")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "src",
        "__part",
        F.coalesce(F.sum("__w").over(before), F.lit(0.0)).alias("__off"),
        F.sum("__w").over(whole).alias("__total"),
        F.sum("__n").over(whole).alias("deg"),
    )
    inside = (
        Window.partitionBy("src", "__part").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = parted.withColumn("__cum", F.sum("weight").over(inside)).join(offsets, ["src", "__part"])
    hi = (F.col("__off") + F.col("__cum")) / F.col("__total")
    lo = hi - F.col("weight") / F.col("__total")
    spans = ranked.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "deg", lo.alias("lo"), hi.alias("hi"))
    last = F.col("deg") - 1
    first_slot = F.least(F.greatest(F.floor(F.col("lo") * F.col("deg")), F.lit(0)), last)
    last_slot = F.least(F.greatest(F.floor(F.col("hi") * F.col("deg")), F.lit(0)), last)
    return spans.withColumn("slot", F.explode(F.sequence(first_slot, last_slot)))


def random_walks(
    graph: DataFrame, length: int = 30, walks: int = 10, seed: int = 42
) -> DataFrame:
    """``walks`` weighted walks of ``length`` accounts from every account: ``(walk, path)``.

    Every draw hashes (walk, step, seed), so a rerun walks the same way.
    """
    links = both_ways(undirected(graph)).filter(F.col("weight") > 0)
    table = cut_lineage(_draw_table(cut_lineage(links)))
    degrees = cut_lineage(table.groupBy("id").agg(F.max("deg").alias("deg")))
    # The degree of the neighbour rides along, so a step is one join.
    options = table.select(F.col("id").alias("tip"), "slot", "lo", "hi", "nbr").join(
        degrees.select(F.col("id").alias("nbr"), F.col("deg").alias("nbr_deg")), "nbr"
    )
    options = cut_lineage(options)
    state = degrees.select(
        F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("__w"), F.col("id"), "deg"
    ).select(
        F.xxhash64("id", "__w", F.lit(seed)).alias("walk"),
        F.col("id").alias("start"),
        F.array("id").alias("path"),
        F.col("id").alias("tip"),
        "deg",
    )
    for step in range(1, length):
        draw = F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        placed = state.withColumn("__u", draw)
        slot = F.least(F.floor(F.col("__u") * F.col("deg")), F.col("deg") - 1)
        placed = placed.select("walk", "start", "path", "tip", "__u", slot.alias("slot"))
        met = placed.join(options, ["tip", "slot"])
        # Rounding can leave a draw on the seam of two shares: the later start wins.
        # A walk is at one slot, so the join's own keys group it and no other shuffle is due.
        chosen = (
            met.filter(F.col("lo") <= F.col("__u") + 1e-12)
            .groupBy("tip", "slot", "walk")
            .agg(
                F.first("start").alias("start"),
                F.first("path").alias("path"),
                F.max(F.struct("lo", "nbr", "nbr_deg")).alias("__next"),
            )
        )
        state = chosen.select(
            "walk",
            "start",
            F.concat("path", F.array("__next.nbr")).alias("path"),
            F.col("__next.nbr").alias("tip"),
            F.col("__next.nbr_deg").alias("deg"),
        )
        if step % 5 == 0:
            state = cut_lineage(state)
    return state.select("walk", "start", "path")


def walk_embeddings(
    graph: DataFrame,
    dim: int = 32,
    length: int = 30,
    walks: int = 10,
    window: int = 5,
    seed: int = 42,
    method: str = "projection",
) -> DataFrame:
    """Embedding of every account with a neighbour; empty for fewer than ten accounts.

    The projection of window neighbours is distributed at every size.  ``"word2vec"``
    asks for Spark's skip-gram instead, which trains in one task and keeps its
    vocabulary on the driver.
    """
    paths = cut_lineage(random_walks(graph, length, walks, seed))
    nodes = paths.select("start").distinct().count()
    if nodes < 10:
        return paths.select(
            F.col("start").alias("account_id"), F.array().cast("array<float>").alias("embedding")
        ).limit(0)
    if method == "projection":
        return _projection(paths, dim, window, seed)
    if method != "word2vec":
        raise ValueError("method must be 'projection' or 'word2vec'")
    sentences = paths.select(F.transform("path", lambda n: n.cast("string")).alias("path"))
    # A fixed order of the sentences keeps the training run repeatable.
    sentences = sentences.orderBy(F.xxhash64("path"))
    model = Word2Vec(
        vectorSize=dim, windowSize=window, minCount=1, seed=seed, inputCol="path", outputCol="v", maxIter=1
    ).fit(sentences)
    kind = graph.schema["src"].dataType
    return model.getVectors().select(
        F.col("word").cast(kind).alias("account_id"),
        vector_to_array("vector", "float32").alias("embedding"),
    )


def _projection(paths: DataFrame, dim: int, window: int, seed: int) -> DataFrame:
    """Signed random projection of the window neighbours, unit length, no driver state."""
    at = paths.select("path", F.posexplode("path").alias("pos", "account_id"))
    near = at.select(
        "account_id",
        F.explode(
            F.concat(
                F.slice("path", F.greatest(F.col("pos") - window + 1, F.lit(1)), F.least(F.col("pos"), F.lit(window))),
                F.slice("path", F.col("pos") + 2, F.lit(window)),
            )
        ).alias("ctx"),
    )
    counts = near.groupBy("account_id", "ctx").agg(F.count(F.lit(1)).alias("n"))
    signs = [
        F.sum(
            F.log1p("n") * F.when(F.pmod(F.xxhash64("ctx", F.lit(seed), F.lit(i)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        ).alias(f"c{i}")
        for i in range(dim)
    ]
    vectors = counts.groupBy("account_id").agg(*signs)
    raw = F.array(*[f"c{i}" for i in range(dim)])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.select(
        "account_id",
        F.transform(raw, lambda x: F.when(length > 0, x / length).otherwise(0.0).cast("float")).alias("embedding"),
    )
