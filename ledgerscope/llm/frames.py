"""Helpers the corpus operators share: row-wise Arrow passes and sorted streams of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of an Arrow batch: texts average a few KB, some reach hundreds, so a batch
# stays at a few MB in the worker.
BATCH_ROWS = 500
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session."""
    if int(spark.conf.get(_BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def arrow_type(schema: T.StructType) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.struct(list(to_arrow_schema(schema)))


def map_rows(
    df: DataFrame,
    carry: Sequence[str],
    inputs: Sequence[Column],
    result: str,
    setup: Callable[[], Callable[..., list[tuple] | list[dict]]],
) -> DataFrame:
    """Run a function over Arrow batches: columns ``row`` (``carry``) and ``result``.

    ``setup()`` runs once per task and returns ``work(*columns)``, which gets one Arrow
    array per input and returns a list of dicts, one per row, with the fields of
    ``result`` (a DDL string).  ``row`` passes through unread, so columns of the table
    may have any name.
    """
    small_batches(df.sparkSession)
    schema = T._parse_datatype_string(result)
    kind = arrow_type(schema)
    names = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(
        F.struct(*[_quoted(c) for c in carry]).alias("row"),
        *[c.alias(n) for c, n in zip(inputs, names)],
    )
    out = T.StructType([source.schema["row"], T.StructField("result", schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(*[batch.column(n) for n in names])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(made, kind)], ["row", "result"]
            )

    return source.mapInArrow(run, out)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return _quoted(name)


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 of each text without decoding it; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return pc.fill_null(array, "").cast(kind).to_pylist()


def as_texts(array: pa.Array) -> list[str]:
    """Each text as ``str``; null counts as empty."""
    return pc.fill_null(array, "").to_pylist()


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each (null: empty)."""
    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


# Text bytes worked on at a time where a pass needs several numbers a byte.
SLICE_BYTES = 1 << 20


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in runs of about ``limit`` bytes: bounds the memory of numpy passes."""
    _, at = flat(array)
    start = 0
    while start < len(array):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield array.slice(start, stop - start)
        start = stop


def stream_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    result: str,
    work: Callable[[Iterator[dict[str, np.ndarray]]], Iterator[dict]],
) -> DataFrame:
    """One shuffle by ``keys``, a sort, and ``work`` over whole groups in batches.

    ``work`` gets column dicts of numpy arrays; each holds complete groups, many small
    ones at a time, so a group costs no call of its own.  Only the group cut by the end
    of a batch is held back.  It yields dicts of columns of ``result``.
    """
    schema = T._parse_datatype_string(result)
    kind = arrow_type(schema)
    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = df.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            first, last = batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)
            if held and _key(held[-1].slice(held[-1].num_rows - 1, 1), keys) != _key(first, keys):
                yield _columns(held, names)
                held = []
            held.append(batch)
            if _key(first, keys) != _key(last, keys):
                cut = _last_group(batch, keys)
                held[-1] = batch.slice(0, cut)
                yield _columns(held, names)
                held = [batch.slice(cut)]
        if held:
            yield _columns(held, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in work(whole(batches)):
            arrays = [pa.array(made[f.name], f.type) for f in kind]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kind])

    return ready.mapInArrow(run, schema)


def _key(row: pa.RecordBatch, keys: Sequence[str]) -> tuple:
    return tuple(row.column(k)[0].as_py() for k in keys)


def _last_group(batch: pa.RecordBatch, keys: Sequence[str]) -> int:
    """Where the last group of a sorted batch starts."""
    lo, hi, last = 0, batch.num_rows - 1, _key(batch.slice(batch.num_rows - 1, 1), keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if _key(batch.slice(mid, 1), keys) == last:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _columns(parts: list[pa.RecordBatch], names: Sequence[str]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts)
    return {n: table.column(n).to_numpy() for n in names}


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows, plus the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
