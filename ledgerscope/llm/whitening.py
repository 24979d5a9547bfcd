"""Embedding whitening by polarisation of exact variances.

Entries become integers ``x = floor(256 * c)``; the fit list holds each distinct vector
once: ``n`` vectors with sums ``S``.  With ``y = n * x - S`` every centred value is an
integer, and so is the sum of its squares.  Tasks add up the squares of ``y_i`` for each
dimension and of ``y_i + y_j`` for each pair of dimensions, exactly; the polarisation
identity ``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2`` then gives every covariance
without a cross product, correctly rounded.  The assembled matrix goes to ``eigh``.

Spark removes copies (combined before the shuffle, so a vector that a third of all rows
share is one row a task) and adds up the partial sums; the driver gets ``d * (d + 1) / 2``
sums and one small row a task, whatever the number of vectors.

Defined results: null and empty vectors, and those with a null or non-finite entry, give
no rows; neither do vectors that have not the most frequent length (the longer on a tie).
Rows may repeat an id or have none; each gives its own result.  ``x`` saturates at the
range of a long.  ``deviation`` is null where it exceeds a long.  A component without
variance (up to rounding) has a null ``whitened`` and is left out of the identity check;
``explained`` is null if nothing varies.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.components import use_checkpoints
from ledgerscope.llm.frames import arrow_type, column, map_rows, small_batches

SCALE = 256
COMPONENTS = 4
# Partial sums travel as digits of this base, which Spark adds up as decimals.
BASE = 10**18
DIGITS = 5
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """Fitted: ``values`` fall, row ``k`` of ``components`` is the unit vector of ``values[k]``."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def varying(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        top = max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        return self.values > len(self.values) * np.finfo(float).eps * top


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    rows = vectors.select(column(vec_id).alias("vec_id"), column(embedding).cast("array<double>").alias("v")).filter(
        "size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    )
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0)).select(
        "vec_id", F.expr(f"transform(v, c -> floor({SCALE} * c))").alias("x")
    )


def matrix(x: pa.Array) -> np.ndarray:
    """A batch of equally long integer lists as rows."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``: 64-bit integers where sums of two stay in range, else Python's."""
    if n * max(int(x.max()), -int(x.min())) < 2**60:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(z: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each column as Python integers.

    Values are cut into limbs so short that no sum of products leaves 64 bits.
    """
    if z.dtype == object:
        return (z * z).sum(axis=0)
    width = (62 - len(z).bit_length()) // 2
    top = max(int(z.max()), -int(z.min()))
    limbs = []
    for _ in range(top.bit_length() // width):
        limbs.append(z & ((1 << width) - 1))
        z = z >> width
    limbs.append(z)
    total = 0
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs[a:], a):
            part = np.einsum("ij,ij->j", left, right).astype(object)
            total = total + part * (1 << width * (a + b) + (b > a))
    return total


def _added(rows: DataFrame, size: int, partial: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact totals of ``size`` integers that ``partial`` gives for each batch of ``x``."""
    schema = T._parse_datatype_string("k int, digits array<bigint>")
    kind = arrow_type(schema)
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = partial(matrix(batch.column("x")))
                total = made if total is None else total + made
        for start in range(0, 0 if total is None else size, 1 << 16):
            ks = range(start, min(size, start + (1 << 16)))
            digits = [[int(abs(total[k]) // BASE**p % BASE) * (1 if total[k] >= 0 else -1) for p in range(DIGITS)] for k in ks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(ks), kind[0].type), pa.array(digits, kind[1].type)], ["k", "digits"]
            )

    parts = rows.select("x").mapInArrow(run, schema)
    sums = parts.groupBy("k").agg(
        F.array(*[F.sum(F.col("digits")[p].cast("decimal(20,0)")).cast("decimal(38,0)") for p in range(DIGITS)]).alias("digits")
    )
    out = [0] * size
    for row in sums.toLocalIterator():
        out[row["k"]] = sum(int(v) * BASE**p for p, v in enumerate(row["digits"]))
    return out


def pair_starts(d: int) -> np.ndarray:
    """Where the sums of ``(i, i + 1), (i, i + 2), ...`` start, after those of the dimensions."""
    return d + np.concatenate(([0], np.cumsum(np.arange(d - 1, 0, -1)))).astype(int)


def variance_sums(fit_list: DataFrame, n: int, sums: list[int]) -> list[int]:
    """Exact sums of squared centred values: of each dimension, then of each pair's sum."""
    d = len(sums)
    at = pair_starts(d)

    def partial(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)
        out = np.zeros(d * (d + 1) // 2, object)
        out[:d] = square_sums(y)
        for i in range(d - 1):
            out[at[i] : at[i + 1]] = square_sums(y[:, i : i + 1] + y[:, i + 1 :])
        return out

    return _added(fit_list, d * (d + 1) // 2, partial)


def polarised(squares: list[int], n: int, d: int) -> np.ndarray:
    """The covariance matrix from variances of dimensions and of pair sums."""
    at = pair_starts(d)
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = squares[i] / n**3
        for j in range(i + 1, d):
            twice = squares[at[i] + j - i - 1] - squares[i] - squares[j]
            out[i, j] = out[j, i] = twice / (2 * n**3)
    return out


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The fit list, stored once where the cluster shares it: three passes read it."""
    use_checkpoints(rows.sparkSession)
    return rows.select("x").distinct().checkpoint()


def fit(fit_list: DataFrame) -> Whitening | None:
    """Covariance and components of a list of distinct integer vectors; None if it is empty."""
    shape = fit_list.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = shape["n"], shape["d"]
    if not n:
        return None
    sums = _added(fit_list, d, lambda x: x.astype(object).sum(axis=0))
    covariance = polarised(variance_sums(fit_list, n, sums), n, d)
    values, vectors = np.linalg.eigh(covariance)
    values, components = values[::-1], vectors.T[::-1]
    # A fixed sign: the entry of the largest size is positive.
    sign = np.sign(components[np.arange(d), np.abs(components).argmax(axis=1)])
    return Whitening(n, sums, covariance, values, components * sign[:, None])


def projected(x: np.ndarray, model: Whitening, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitened coordinates of up to ``k`` components (NaN: no variance), and ``y``."""
    y = centred(x, model.n, model.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.varying[:k], 1 / np.sqrt(np.maximum(model.values[:k], 0)), np.nan)
    return (y / model.n).astype(np.float64) @ model.components[:k].T * scale, y


def identity_error(fit_list: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity.

    Each task centres at its own mean; the parts are merged by their counts and means.
    """
    use = np.flatnonzero(model.varying[:k])
    if not len(use):
        return None
    schema = T._parse_datatype_string("n long, mean array<double>, m2 array<double>")
    kind = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                w = projected(matrix(batch.column("x")), model, k)[0][:, use]
                mean = w.mean(axis=0)
                held = _merged(held, (len(w), mean, (w - mean).T @ (w - mean)))
        if held is not None:
            made = [[held[0]], [held[1].tolist()], [held[2].ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, kind)], [f.name for f in kind])

    held = None
    for row in fit_list.mapInArrow(run, schema).collect():
        held = _merged(held, (row["n"], np.array(row["mean"]), np.array(row["m2"]).reshape(len(use), -1)))
    return float(np.abs(held[2] / held[0] - np.eye(len(use))).max())


def _merged(a, b):
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """``vec_id, deviation, whitened``: one row a vector, an array over the components."""

    def setup():
        def work(x: pa.Array) -> list[dict]:
            if not len(x):
                return []
            w, y = projected(matrix(x), model, k)
            deviations = square_sums(np.ascontiguousarray(y.T))
            return [
                {"deviation": int(s) if s <= _LONG else None, "whitened": [v if v == v else None for v in values]}
                for s, values in zip(deviations, w.tolist())
            ]

        return work

    done = map_rows(rows, ["vec_id"], [F.col("x")], "deviation long, whitened array<double>", setup)
    return done.select("row.vec_id", "result.deviation", "result.whitened")


def report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, with the figures of the fit."""
    rows = scaled(vectors, vec_id, embedding)
    fit_list = distinct_vectors(rows)
    model = fit(fit_list)
    if model is None:
        return rows.select(
            "vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
                ("component", "int"), ("n", "long"), ("deviation", "long"),
                ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
            )]
        ).filter("false")
    trace = float(np.trace(model.covariance))
    shares = [float(max(v, 0.0)) / trace if trace > 0 else None for v in model.values[:k]]
    error = identity_error(fit_list, model, k)
    return whiten(rows, model, k).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(s).cast("double") for s in shares])[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
