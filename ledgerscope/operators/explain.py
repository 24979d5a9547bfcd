"""Contributions of the features to a boosted-tree score, exactly and for every row.

The trees of a fitted model become small tables of leaves.  Each leaf has the conditions
of its path by feature (an interval, as a path may split on a feature more than once) and,
by feature, the share of the training weight that went the path's way.  The path-dependent
Shapley value of a feature on the path depends on a row only through which of the path's
intervals it lies in, so all patterns are worked out once per leaf, from the coefficients
of ``prod(z_j + o_j t)``; rows then look their pattern up, many at a time.

Contributions are on the scale of the log-odds and add up, with the expected value, to the
row's own log-odds.  The tables grow with the model, never with the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.scale import checkpoint_folder

# Rows a worker keeps side by side.
BATCH_ROWS = 4_096


@dataclass(frozen=True)
class Leaf:
    """Features of a path with their interval ``(low, high]`` and the values of every pattern."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray  # [pattern, feature]
    expected: float


def node_table(model: PipelineModel, spark: SparkSession) -> list[dict]:
    """Nodes of all trees with their training weight, from the model's own stored form."""
    path = f"{checkpoint_folder(spark)}/model-{uuid.uuid4().hex}"
    trees = model.stages[-1]
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    rows = nodes.select(
        "treeID", "id", "prediction", "leftChild", "rightChild",
        F.get("impurityStats", F.lit(0)).alias("weight"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        (F.col("split.numCategories") >= 0).alias("categorical"),
    )
    return [r.asDict() for r in rows.collect()]


def pattern_values(z: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of the ``d`` features of a path, for each of the ``2 ** d`` patterns.

    Bit ``j`` of the pattern says that the row goes the path's way at feature ``j``.
    """
    d = len(z)
    share = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
    patterns = np.arange(1 << d)
    o = (patterns[:, None] >> np.arange(d) & 1).astype(np.float64)
    out = np.zeros((1 << d, d))
    for i in range(d):
        # Coefficients of the product over the other features, for all patterns at once.
        poly = np.zeros((1 << d, d))
        poly[:, 0] = 1.0
        for n, j in enumerate(j for j in range(d) if j != i):
            up = poly[:, : n + 1] * o[:, j : j + 1]
            poly[:, : n + 1] *= z[j]
            poly[:, 1 : n + 2] += up
        out[:, i] = value * (o[:, i] - z[i]) * (poly @ np.array(share))
    return out


def leaves(nodes: list[dict], weights: list[float]) -> list[Leaf]:
    """All leaves of all trees; ``weights`` are the trees' own."""
    by_tree: dict[int, dict[int, dict]] = {}
    for n in nodes:
        if n["leftChild"] >= 0 and n["categorical"]:
            raise ValueError("splits on categories are not explained")
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    out = []
    for tree, of in by_tree.items():
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = of[at]
            if node["leftChild"] < 0:
                features = sorted(path)
                z = np.array([path[f][2] for f in features])
                value = weights[tree] * node["prediction"]
                out.append(
                    Leaf(
                        np.array(features, np.int64),
                        np.array([path[f][0] for f in features]),
                        np.array([path[f][1] for f in features]),
                        pattern_values(z, value) if features else np.zeros((1, 0)),
                        value * float(np.prod(z)),
                    )
                )
                continue
            f, cut = node["feature"], node["threshold"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                part = of[child]["weight"] / node["weight"]
                stack.append((child, {**path, f: (*bounds, share * part)}))
    return out


def shapley(x: np.ndarray, table: list[Leaf]) -> np.ndarray:
    """Contributions of every feature for every row."""
    out = np.zeros(x.shape)
    columns = np.ascontiguousarray(x.T)
    for leaf in table:
        pattern = np.zeros(len(x), np.int64)
        for j, f in enumerate(leaf.features):
            inside = (columns[f] > leaf.low[j]) & (columns[f] <= leaf.high[j])
            pattern |= inside.astype(np.int64) << j
        # A feature stands once among those of a leaf.
        out[:, leaf.features] += leaf.values[pattern]
    return out


def tree_contributions(df: DataFrame, model: PipelineModel, features: list[str], key: str | Column) -> DataFrame:
    """``key, expected, log_odds, contributions``: an array of ``(feature, contribution)`` per row.

    Null inputs count as zero, as when scoring.  Rows may repeat a key.
    """
    spark = df.sparkSession
    boosted = model.stages[-1]
    # The class probability is the sigmoid of twice the sum of the trees.
    table = leaves(node_table(model, spark), [2.0 * w for w in boosted.treeWeights])
    expected = float(sum(leaf.expected for leaf in table))
    shared = spark.sparkContext.broadcast(table)  # grows with the model only
    column = F.col(key) if isinstance(key, str) else key
    source = df.select(column.alias("key"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    schema = T.StructType([source.schema["key"], *T._parse_datatype_string("log_odds double, made array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # A NaN goes right at every split, as in the trees.
                made = shapley(np.where(np.isnan(x), np.inf, x), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(made.sum(axis=1) + expected), pa.array(list(made), pa.list_(pa.float64()))],
                    ["key", "log_odds", "made"],
                )

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("made")[i].alias("contribution")) for i, f in enumerate(features)])
    name = key if isinstance(key, str) else "key"
    return source.mapInArrow(run, schema).select(
        F.col("key").alias(name), F.lit(expected).alias("expected"), "log_odds", pairs.alias("contributions")
    )


def long_form(explained: DataFrame, key: str) -> DataFrame:
    """One row per key and feature, as the linear contributions have it."""
    return explained.select(key, F.explode("contributions").alias("c")).select(key, "c.*")
