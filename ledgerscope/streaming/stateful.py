"""Exact streaming twins of the trailing measures and fingerprint counters.

Rows wait in state until the watermark passes them and are then taken in event-time
order, so each sees exactly its own past: the result is that of the batch operator over
every row that was not too late, whatever order they arrived in.  State is kept by slots
of time: a batch reads the slots at the moving ends of the spans and totals of the slots
between, not a key's whole history.  Slots that no span can reach are removed, and a timer
clears keys that fall silent.  One key's rows are in order by nature, so they are one
state; its memory is one span of times and amounts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerscope import constants as C
from ledgerscope.operators.context import DAY, HOUR
from ledgerscope.operators.profile import sides
from ledgerscope.scale import micros

SECOND = 1_000_000
# Amounts are kept in millionths, the decimals of the batch sums.
UNIT = 1_000_000
# Slots a longest span is cut into.
SLOTS = 144


def use_state_store(spark: SparkSession) -> None:
    """State variables need the RocksDB store; a session may have chosen another."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class InOrder(StatefulProcessor):
    """Hold rows until the watermark passes them; hand them on in order of time and id."""

    def __init__(self, key: str, row_id: str, id_type: str, slot: int, carried: list[str], made: dict[str, str]):
        self.key, self.row_id, self.id_type, self.slot = key, row_id, id_type, slot
        self.carried, self.made = carried, made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{c} array<bigint>" for c in ["us", *self.carried])
        self.pending = handle.getMapState("pending", "slot bigint", f"{columns}, id array<{self.id_type}>")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ["us", *self.carried, "id"]
        for part in rows:
            untimed = part[part["us"].isna()]
            if len(untimed):
                yield self._out(key, untimed, self.without_time(untimed))
            part = part[part["us"].notna()]
            for slot, mine in part.groupby(part["us"].astype("int64") // self.slot):
                held = self.pending.getValue((int(slot),))
                lists = [_plain(mine[n]) for n in names]
                if held is not None:
                    lists = [list(old) + new for old, new in zip(held, lists)]
                self.pending.updateValue((int(slot),), tuple(lists))
            if len(part):
                self._wake_at(int(part["us"].min()) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs()
        ready = self._ready(now * 1000)
        if len(ready):
            yield self._out(key, ready, self.advance(ready, now * 1000))
        waiting = [k[0] * self.slot // 1000 for k in self.pending.keys()]
        at = min(waiting) if waiting else self.forget(now * 1000)
        if at is not None:
            self._wake_at(max(at, now + 1))

    def close(self) -> None:
        pass

    def _wake_at(self, ms: int) -> None:
        """One timer a key: the earliest moment anything can be due."""
        known = self.alarm.get()
        if known is not None and known[0] <= ms:
            return
        if known is not None:
            self.handle.deleteTimer(int(known[0]))
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def _ready(self, until: int) -> pd.DataFrame:
        names = ["us", *self.carried, "id"]
        parts = []
        for (slot,) in sorted(self.pending.keys()):
            if slot > until // self.slot:
                break
            rows = pd.DataFrame(dict(zip(names, map(list, self.pending.getValue((slot,))))), dtype=object)
            due = rows["us"] <= until
            parts.append(rows[due])
            if due.all():
                self.pending.removeKey((slot,))
            else:
                self.pending.updateValue((slot,), tuple(rows.loc[~due, n].tolist() for n in names))
        if not parts:
            return pd.DataFrame(columns=names)
        return pd.concat(parts).sort_values(["us", "id"], kind="stable", ignore_index=True)

    def _out(self, key: Any, rows: pd.DataFrame, made: dict[str, Any]) -> pd.DataFrame:
        us = pd.to_datetime(pd.Series(rows["us"].tolist(), dtype="Int64"), unit="us", utc=True)
        out = {self.key: [key[0]] * len(rows), self.row_id: rows["id"].tolist(), "ts": us.tolist()}
        return pd.DataFrame(out | made)

    def without_time(self, rows: pd.DataFrame) -> dict[str, Any]:
        raise NotImplementedError

    def advance(self, rows: pd.DataFrame, now: int) -> dict[str, Any]:
        """Results of rows in order; ``now`` is the watermark in microseconds."""
        raise NotImplementedError

    def forget(self, now: int) -> int | None:
        """Drop what no later row needs; when to come back (ms), or None."""
        raise NotImplementedError


def _plain(column: pd.Series) -> list:
    return [None if v is None or v != v else (int(v) if isinstance(v, (float, np.integer)) else v) for v in column.tolist()]


class Trailing(InOrder):
    """Counts, sums and means over the spans before each row."""

    def __init__(self, key, row_id, id_type, measures, columns, include_current):
        slot = max(SECOND, max(span for span, _, _ in measures.values()) * SECOND // SLOTS)
        made = {n: "bigint" if kind == "count" else "double" for n, (_, kind, _) in measures.items()}
        super().__init__(key, row_id, id_type, slot, [f"v{i}" for i in range(len(columns))], made)
        self.measures, self.columns, self.include_current = measures, columns, include_current
        self.reach = max(span for span, _, _ in measures.values()) * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getMapState("past", "slot bigint", ", ".join(f"{c} array<bigint>" for c in ["us", *self.carried]))
        totals = ["n bigint", *[f"{c}_n bigint, {c}_s bigint" for c in self.carried]]
        self.totals = handle.getMapState("totals", "slot bigint", ", ".join(totals))

    def without_time(self, rows: pd.DataFrame) -> dict[str, Any]:
        return {n: [0] * len(rows) if kind == "count" else [0.0] * len(rows) for n, (_, kind, _) in self.measures.items()}

    def advance(self, rows: pd.DataFrame, now: int) -> dict[str, Any]:
        for slot, mine in rows.groupby(rows["us"].astype("int64") // self.slot):
            held = self.past.getValue((int(slot),))
            lists = [mine[n].tolist() for n in ["us", *self.carried]]
            if held is not None:
                lists = [list(old) + new for old, new in zip(held, lists)]
            self.past.updateValue((int(slot),), tuple(lists))
            totals = [len(lists[0])]
            for values in lists[1:]:
                known = [v for v in values if v is not None]
                totals += [len(known), sum(known)]
            self.totals.updateValue((int(slot),), tuple(totals))
        at = rows["us"].to_numpy(np.int64)
        known = sorted((k[0], v) for k, v in self.totals.iterator())
        slots = np.array([k for k, _ in known], np.int64)
        # Totals of all slots before each; Python's integers, as sums may be large.
        before = np.vstack((np.zeros((1, 1 + 2 * len(self.carried)), object), np.cumsum(np.array([list(v) for _, v in known], object), axis=0)))
        cache: dict[int, tuple] = {}
        upper = self._up_to(at, "right" if self.include_current else "left", slots, before, cache)
        lower = {span: self._up_to(at - span * SECOND, "right", slots, before, cache) for span in {s for s, _, _ in self.measures.values()}}
        out: dict[str, Any] = {}
        for name, (span, kind, column) in self.measures.items():
            inside = upper - lower[span]
            if kind == "count":
                out[name] = [int(v) for v in inside[:, 0]]
                continue
            i = 1 + 2 * self.columns.index(column)
            sums = [int(s) / UNIT for s in inside[:, i + 1]]
            out[name] = sums if kind == "sum" else [s / int(n) if n else 0.0 for s, n in zip(sums, inside[:, i])]
        self._expire(now)
        return out

    def _up_to(self, x: np.ndarray, side: str, slots, before, cache) -> np.ndarray:
        """Counts and sums of the rows before (or at) each time."""
        out = np.empty((len(x), before.shape[1]), object)
        own = x // self.slot
        for slot in np.unique(own):
            at = np.flatnonzero(own == slot)
            place = int(np.searchsorted(slots, slot))
            out[at] = before[place]
            if place < len(slots) and slots[place] == slot:
                if int(slot) not in cache:
                    cache[int(slot)] = self._running(self.past.getValue((int(slot),)))
                us, running = cache[int(slot)]
                out[at] = out[at] + running[np.searchsorted(us, x[at], side=side)]
        return out

    def _running(self, lists: tuple) -> tuple[np.ndarray, np.ndarray]:
        us = np.array(lists[0], np.int64)
        order = np.argsort(us, kind="stable")
        columns = [np.ones(len(us), object)]
        for values in lists[1:]:
            values = np.array([None, *values], object)[1:][order]
            columns += [np.array([int(v is not None) for v in values], object), np.array([v or 0 for v in values], object)]
        running = np.cumsum(np.column_stack(columns), axis=0)
        return us[order], np.vstack((np.zeros((1, running.shape[1]), object), running))

    def _expire(self, now: int) -> None:
        for (slot,) in list(self.totals.keys()):
            if (slot + 1) * self.slot <= now - self.reach:
                self.totals.removeKey((slot,))
                self.past.removeKey((slot,))

    def forget(self, now: int) -> int | None:
        self._expire(now)
        left = [k[0] for k in self.totals.keys()]
        return ((max(left) + 1) * self.slot + self.reach) // 1000 + 1 if left else None


class Runs(InOrder):
    """A counter that starts again when nothing came for ``gap`` microseconds."""

    def __init__(self, key, row_id, id_type, gap):
        super().__init__(key, row_id, id_type, max(SECOND, gap // SLOTS), [], {"occurrences": "bigint"})
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us bigint, hits bigint")

    def without_time(self, rows: pd.DataFrame) -> dict[str, Any]:
        return {"occurrences": [None] * len(rows)}

    def advance(self, rows: pd.DataFrame, now: int) -> dict[str, Any]:
        us, hits = self.last.get() or (None, 0)
        out = []
        for at in rows["us"].tolist():
            hits = hits + 1 if us is not None and at - us < self.gap else 1
            us = at
            out.append(hits)
        self.last.update((us, hits))
        return {"occurrences": out}

    def forget(self, now: int) -> int | None:
        last = self.last.get()
        if last is None:
            return None
        if last[0] + self.gap <= now:
            self.last.clear()
            return None
        return (last[0] + self.gap) // 1000 + 1


def _run(stream: DataFrame, processor: InOrder, ts: str, watermark: str, columns: list[str]) -> DataFrame:
    use_state_store(stream.sparkSession)
    # Timestamps without zone count as UTC, as everywhere.
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    source = rows.select(
        F.col(processor.key).alias("__key"),
        "__ts",
        micros("__ts").alias("us"),
        *[(F.col(c).cast("decimal(28,6)") * UNIT).cast("long").alias(f"v{i}") for i, c in enumerate(columns)],
        F.col(processor.row_id).alias("id"),
    )
    kinds = dict(stream.dtypes)
    made = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in processor.made.items()))
    schema = T.StructType(
        [
            T.StructField(processor.key, stream.schema[processor.key].dataType),
            T.StructField(processor.row_id, stream.schema[processor.row_id].dataType),
            T.StructField("ts", T.TimestampType()),
            *made,
        ]
    )
    assert kinds[processor.row_id] == processor.id_type
    return source.groupBy("__key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def stream_trailing(
    stream: DataFrame,
    key: str,
    measures: dict[str, tuple[int, str, str | None]],
    ts: str = "ts",
    row_id: str = "transaction_id",
    include_current: bool = False,
    watermark: str = "10 minutes",
) -> DataFrame:
    """``key, row_id, ts`` and the measures of :func:`ledgerscope.scale.trailing_stats` at every row.

    A row comes out once the watermark has passed it.  Rows without a time come out at
    once with empty spans; rows without a key form one group; repeated ids are all kept.
    """
    columns = sorted({c for _, _, c in measures.values() if c is not None})
    processor = Trailing(key, row_id, dict(stream.dtypes)[row_id], measures, columns, include_current)
    return _run(stream, processor, ts, watermark, columns)


def stream_velocity_exact(stream: DataFrame, include_current: bool = False, watermark: str = "10 minutes") -> DataFrame:
    """Payments of the last hour and day and the volume of the last hour, at each payment."""
    measures = {"velocity_1h": (HOUR, "count", None), "velocity_24h": (DAY, "count", None), "volume_1h": (HOUR, "sum", "amount")}
    return stream_trailing(stream, "account_id", measures, include_current=include_current, watermark=watermark)


def stream_flows_exact(edges: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Money in and out of an account in the hour up to each of its transfers, itself included."""
    flow = lambda side: F.when(F.col("direction") == side, F.col("amount")).otherwise(0.0)
    rows = sides(edges).withColumn("inflow", flow("in")).withColumn("outflow", flow("out"))
    measures = {"inflow_1h": (HOUR, "sum", "inflow"), "outflow_1h": (HOUR, "sum", "outflow")}
    return stream_trailing(rows, "account_id", measures, include_current=True, watermark=watermark)


def stream_occurrences(novel: DataFrame, gap_days: int = C.FINGERPRINT_GAP_DAYS, watermark: str = "10 minutes") -> DataFrame:
    """Running count of each fingerprint within runs whose gaps stay under ``gap_days``, at each hit."""
    kind = dict(novel.dtypes)["transaction_id"]
    return _run(novel, Runs("fingerprint", "transaction_id", kind, gap_days * DAY * SECOND), "ts", watermark, [])
