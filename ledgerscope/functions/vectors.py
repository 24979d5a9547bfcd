"""Vector formulas on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    )


def nan_to_null(x: Column) -> Column:
    """A float with NaN or an infinity turned into null."""
    value = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(value) != float("inf"), value)


def nan_to_null_map(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: nan_to_null(v))


def top_features(m: Column, k: int = 10) -> Column:
    """The ``k`` map entries largest in magnitude; ties by name."""

    def order(a: Column, b: Column) -> Column:
        size_a = F.abs(F.coalesce(a["value"], F.lit(0.0)))
        size_b = F.abs(F.coalesce(b["value"], F.lit(0.0)))
        return (
            F.when(size_a > size_b, -1)
            .when(size_a < size_b, 1)
            .when(a["key"] < b["key"], -1)
            .when(a["key"] > b["key"], 1)
            .otherwise(0)
        )

    return F.slice(F.array_sort(F.map_entries(m), order), 1, k)


def top_contributions(contributions: Column, k: int = 10) -> Column:
    """Largest ``struct(feature, contribution)`` entries by absolute value; ties by name."""

    def order(a: Column, b: Column) -> Column:
        size_a, size_b = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (
            F.when(size_a > size_b, -1)
            .when(size_a < size_b, 1)
            .when(a["feature"] < b["feature"], -1)
            .when(a["feature"] > b["feature"], 1)
            .otherwise(0)
        )

    return F.slice(F.array_sort(contributions, order), 1, k)
