"""An index of every account's transfers: the first by id of those from a time on.

Transfers are sorted by account and time and cut into chunks of at most ``CHUNK_ROWS``
rows by their place in the sorted partitions, so a hub that holds a third of all transfers
is many chunks and no task holds it.  Chunks form a tree with ``FANOUT`` children a node,
and each node keeps the first ``m`` transfers of its span by id.  The transfers of an
account at or after a time lie in one chunk, which is read and filtered, and in the later
siblings of that chunk and of its ancestors, of which the kept ones suffice: at most
``CHUNK_ROWS + (FANOUT - 1) * levels * m`` rows answer a question, whatever the account has.

Many questions at once are answered by ``first``, which reads each account's transfers once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.scale import cut_lineage, micros, top_per_key

# Powers of two, as chunks and nodes are numbered by shifting places.
CHUNK_BITS = 12
FANOUT_BITS = 3
CHUNK_ROWS = 1 << CHUNK_BITS
# Transfers and questions for which a task of its own pays.
TASK_ROWS = 100_000


class TimeCutIndex:
    """Transfers by ``account``; ``backward`` turns time around, so questions are always "from".

    ``steps`` has the columns ``__eid`` (order of the answers) and ``__ts``; rows without an
    account or a time answer no question.  ``reach`` tells from which column of ``steps`` and
    which table (see ``walk_bounds``) ``first`` learns what a transfer leads to.
    """

    def __init__(
        self, steps: DataFrame, account: str, backward: bool = False, chunk_bits: int = CHUNK_BITS, reach: tuple[str, DataFrame] | None = None
    ):
        self.account = account
        self.backward = backward
        self.chunk_bits = chunk_bits
        self.reach = reach
        self.fields = steps.columns
        self.steps = steps.withColumn("__at", self.time("__ts")).filter(F.col(account).isNotNull() & F.col("__at").isNotNull())
        self._tops: dict[int, DataFrame] = {}

    @cached_property
    def size(self) -> int:
        return self.steps.count()

    @cached_property
    def parts(self) -> int:
        return max(self._partitions(), -(-self.size // (256 << min(self.chunk_bits, CHUNK_BITS))))

    def _partitions(self) -> int:
        return int(self.steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _tasks(self, many: int) -> int:
        """Tasks for ``many`` questions: few where there is little to read, more where it is much."""
        rows = many + self.size
        return max(min(self._partitions(), -(-rows // TASK_ROWS)), -(-rows // (TASK_ROWS << 4)))

    @cached_property
    def large(self) -> DataFrame | None:
        """Accounts of more than one chunk, at most rows / chunk; None if there is none."""
        counted = self.steps.groupBy(F.col(self.account).alias("__acc")).agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(counted.filter(F.col("n") > (1 << self.chunk_bits)).select("__acc"))
        return large if large.take(1) else None

    @cached_property
    def stored(self) -> DataFrame:
        """``__acc, __at, __reach, __step``: the transfers as ``first`` reads them."""
        told = F.struct(*[c for c in self.fields if c != self.account]).alias("__step")
        rows = self.steps.filter("__eid IS NOT NULL")
        if self.reach is None:
            rows = rows.withColumn("__reach", F.lit(None).cast("array<bigint>"))
        else:
            tail, bounds = self.reach
            rows = rows.join(bounds.select(F.col("account_id").alias(tail), F.col("bounds").alias("__reach")), tail, "left")
        rows = rows.select(F.col(self.account).alias("__acc"), "__at", "__reach", told)
        # Small accounts stay where questions meet them; a large one must not fill one task.
        return cut_lineage(rows.repartition(self._tasks(0), "__acc") if self.large is None else rows)

    @cached_property
    def rows(self) -> DataFrame:
        account, chunk_bits, rows = self.account, self.chunk_bits, self.steps
        # Accounts of one chunk are not cut; at most rows / CHUNK_ROWS others exist.
        large = rows.groupBy(account).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > (1 << chunk_bits))
        rows = rows.join(large.select(account, F.lit(True).alias("__large")), account, "left")
        order = [account, "__at", "__eid"]
        place = F.shiftright(F.monotonically_increasing_id(), chunk_bits)
        return cut_lineage(
            rows.repartitionByRange(self.parts, *order)
            .sortWithinPartitions(*order)
            .withColumn("__chunk", F.when(F.col("__large"), place).otherwise(F.lit(0).cast("long")))
            .drop("__large")
        )

    @cached_property
    def spans(self) -> DataFrame:
        account = self.account
        spans = self.rows.groupBy(account, "__chunk").agg(F.max("__at").alias("__top"))
        mine = Window.partitionBy(account)
        spans = spans.withColumn("__low", F.lag("__top").over(mine.orderBy("__chunk")))
        spans = spans.withColumn("__first", F.min("__chunk").over(mine)).withColumn("__last", F.max("__chunk").over(mine))
        # Levels of the tree above which all chunks of the account share a node.
        apart = F.col("__first").bitwiseXOR(F.col("__last"))
        levels = F.when(apart == 0, 0).otherwise(F.ceil((F.floor(F.log2(apart)) + 1) / FANOUT_BITS)).cast("int")
        return cut_lineage(spans.withColumn("__levels", levels).drop("__first"))

    @cached_property
    def wide(self) -> bool:
        return bool(self.spans.filter("__levels > 0").take(1))

    def time(self, ts: str):
        at = micros(ts)
        return -at if self.backward else at

    def tops(self, m: int) -> DataFrame:
        """The first ``m`` transfers by id of every node; only accounts of several chunks have any.

        Widths go by powers of two, so that questions of different widths share them.
        """
        asked, m = m, max(32, 1 << (m - 1).bit_length())
        if m not in self._tops:
            account = self.account
            several = self.spans.filter("__levels > 0").select(account, "__chunk", "__levels")
            leaves = top_per_key(self.rows.join(several, [account, "__chunk"]), [account, "__chunk"], [F.asc("__eid")], m)
            nodes = leaves.withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__levels") - 1))).withColumn(
                "__node", F.expr(f"shiftright(__chunk, {FANOUT_BITS} * __level)")
            )
            order = Window.partitionBy(account, "__level", "__node").orderBy("__eid")
            kept = nodes.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= m)
            self._tops[m] = cut_lineage(kept.drop("__chunk", "__levels", "__at"))
        return self._tops[m].filter(F.col("__rn") <= asked).drop("__rn")

    def ask(self, questions: DataFrame, tip: str, since: str, m: int, few: bool = False) -> DataFrame:
        """Every question with transfers of ``tip`` from ``since`` on: the first ``m`` by id are among them.

        ``__whole`` says that the account is one chunk, so that all its fitting transfers are there.
        A ``few`` questions are sent to the transfers, which then stay where they are.
        """
        account, own = self.account, questions.columns
        sent = F.broadcast if few else lambda df: df
        questions = sent(questions)
        if not self.wide:
            mine = self.rows.withColumnRenamed(account, "__mine")
            whole = questions.join(mine, (F.col(tip) == F.col("__mine")) & (F.col("__at") >= F.col(since)))
            return whole.withColumn(account, F.col("__mine")).select(*own, *self.fields, F.lit(True).alias("__whole"))
        spans = self.spans.withColumnRenamed(account, "__account")
        routed = questions.join(
            spans,
            (F.col(tip) == F.col("__account"))
            & (F.col(since) <= F.col("__top"))
            & (F.col("__low").isNull() | (F.col(since) > F.col("__low"))),
        ).drop("__top", "__low")
        out = [*own, *self.fields, (F.col("__levels") == 0).alias("__whole")]
        near = sent(routed).join(
            self.rows.withColumnsRenamed({account: "__mine", "__chunk": "__own"}),
            (F.col("__account") == F.col("__mine")) & (F.col("__chunk") == F.col("__own")) & (F.col("__at") >= F.col(since)),
        ).withColumn(account, F.col("__mine")).select(*out)
        width = (1 << FANOUT_BITS) - 1
        later = F.expr(
            f"""flatten(transform(sequence(0, __levels - 1), l -> transform(
                  filter(sequence(1, {width}), i -> (shiftright(__chunk, {FANOUT_BITS} * l) & {width}) + i <= {width}
                    AND shiftright(__chunk, {FANOUT_BITS} * l) + i <= shiftright(__last, {FANOUT_BITS} * l)),
                  i -> struct(l AS level, shiftright(__chunk, {FANOUT_BITS} * l) + i AS node))))"""
        )
        tops = self.tops(m).withColumnsRenamed({account: "__mine"})
        asked = routed.filter("__levels > 0").withColumn("__n", F.explode(later))
        far = sent(asked).join(
            tops,
            (F.col("__account") == F.col("__mine")) & (F.col("__n.level") == F.col("__level")) & (F.col("__n.node") == F.col("__node")),
        ).withColumn(account, F.col("__mine")).select(*out)
        return near.unionByName(far)

    def first(self, questions: DataFrame, tip: str, since: str, left: str, used: str, keep: str, least: int, many: int) -> DataFrame:
        """The first ``keep`` transfers by id that ``tip`` sends from ``since`` on, without those in ``used``.

        Of a question with ``left`` hops to go only transfers count that lead to an account from
        which a walk of that length starts in time (``__reach``).  Adds the transfers' columns,
        ``__rank`` and ``__n``, the number of answers of the question.  ``least`` bounds from above
        what ``keep`` and ``used`` are together, ``many`` the number of questions.

        Transfers and questions of an account are put in order of time, latest first, and read
        once; the first ``least`` ids so far answer each question, so no question is joined with
        its account's transfers.  Accounts of several chunks are read chunk by chunk, each begun
        with the first ids of those before; accounts with many questions in several copies.
        """
        own = questions.columns
        asked = questions.select(
            F.col(tip).alias("__acc"), F.col(left).cast("int").alias("__left"), (-F.col(since)).alias("__nk"),
            F.struct(*own).alias("__q"), F.col(used).alias("__used"), F.col(keep).cast("int").alias("__keep"),
        ).filter("__acc IS NOT NULL AND __nk IS NOT NULL")
        wanted = asked.groupBy("__acc", "__left").agg(F.max("__nk").alias("__latest"))
        reach = F.get("__reach", F.col("__left") - 1)
        at = F.when(F.col("__left") <= 0, F.col("__at")).when(reach.isNotNull(), F.least("__at", reach))
        rows = self.stored.join(wanted, "__acc").withColumn("__nk", -at).filter("__nk <= __latest")
        rows = rows.select("__acc", "__left", "__nk", "__step")
        place = ["__acc", "__left", "__chunk"]
        if self.large is None:
            rows, asked = (df.withColumn("__chunk", F.lit(0).cast("long")) for df in (rows, asked))
            carried = None
        else:
            rows, asked, carried = self._cut(rows, asked, least)
        none = F.lit(None)
        rows = rows.select(*place, "__nk", F.lit(1).alias("__kind"), "__step")
        if carried is not None:
            rows = rows.unionByName(carried)
        copies = F.lit(0)
        if many > 1 << self.chunk_bits:
            busy = asked.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (1 << self.chunk_bits))
            # At most questions / chunk rows.
            busy = cut_lineage(busy.select(*place, F.shiftright("n", self.chunk_bits).cast("int").alias("__more")))
            if busy.take(1):
                several = F.coalesce("__more", F.lit(0))
                rows = rows.join(F.broadcast(busy), place, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), several))).drop("__more")
                asked = asked.join(F.broadcast(busy), place, "left")
                asked = asked.withColumn("__copy", F.pmod(F.xxhash64("__q"), several + 1).cast("int")).drop("__more")
                copies = F.col("__copy")
        slot = [*place, "__copy"]
        told, q = rows.schema["__step"].dataType, asked.schema["__q"].dataType
        rows = rows.withColumn("__copy", copies).select(
            *slot, "__nk", "__kind", "__step", none.cast(q).alias("__q"), none.cast(asked.schema["__used"].dataType).alias("__used"), F.lit(0).alias("__keep")
        )
        asked = asked.withColumn("__copy", copies).select(
            *slot, "__nk", F.lit(2).alias("__kind"), none.cast(told).alias("__step"), "__q", "__used", "__keep"
        )
        together = rows.unionByName(asked).repartition(self._tasks(many), *slot).sortWithinPartitions(*slot, "__nk", "__kind")
        out = T.StructType(
            [T.StructField("q", q), T.StructField("step", told), T.StructField("__rank", T.IntegerType()), T.StructField("__n", T.IntegerType())]
        )
        return together.mapInArrow(_answers(least), out).select("q.*", "step.*", "__rank", "__n")

    def _cut(self, rows: DataFrame, asked: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Transfers and questions of large accounts by chunk, and what each chunk begins with."""
        group = ["__acc", "__left"]
        large = F.broadcast(self.large)
        whole = F.lit(0).cast("long").alias("__chunk")
        order = [*group, "__nk"]
        # Chunks are numbered from 1: 0 is an account in one piece.
        chunk = F.shiftright(F.monotonically_increasing_id(), self.chunk_bits) + 1
        parts = self.parts
        big = rows.join(large, "__acc", "left_semi").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        big = cut_lineage(big.withColumn("__chunk", chunk))
        spans = big.groupBy(*group, "__chunk").agg(F.min("__nk").alias("__low"))
        spans = cut_lineage(spans.withColumn("__high", F.lead("__low").over(Window.partitionBy(*group).orderBy("__chunk"))))
        # At most transfers / chunk rows, and two for each task.
        ends = F.broadcast(spans.withColumnsRenamed({"__acc": "__a", "__left": "__l"}))
        fits = (F.col("__acc") == F.col("__a")) & (F.col("__left") == F.col("__l")) & (F.col("__nk") >= F.col("__low"))
        routed = asked.join(large, "__acc", "left_semi").join(ends, fits & (F.col("__high").isNull() | (F.col("__nk") < F.col("__high"))))
        eid = F.col("__step.__eid")
        mine = Window.partitionBy(*group, "__chunk").orderBy("__eid")
        first = big.withColumn("__eid", eid).withColumn("__d", F.dense_rank().over(mine)).filter(F.col("__d") <= least)
        alike = Window.partitionBy(*group, "__chunk", "__eid").orderBy("__nk")
        first = first.withColumn("__d", F.row_number().over(alike)).filter(F.col("__d") <= least)
        next_ = spans.select(*group, F.lit(None).cast(rows.schema["__step"].dataType).alias("__step"), "__chunk")
        # One row a chunk more, so that chunks without transfers to pass on are there too.
        passed = first.select(*group, "__step", "__chunk").unionByName(next_).groupBy(*group).applyInArrow(_passed_on(least), T.StructType([rows.schema[c] if c in rows.columns else T.StructField(c, T.LongType()) for c in (*group, "__chunk", "__step")]))
        carried = passed.select(*group, "__chunk", F.lit(-(1 << 63)).cast("long").alias("__nk"), F.lit(0).alias("__kind"), "__step")
        rows = rows.join(large, "__acc", "left_anti").select("*", whole).unionByName(big)
        asked = asked.join(large, "__acc", "left_anti").select("*", whole).unionByName(routed.select(*asked.columns, "__chunk"))
        return rows, asked, carried


class _First:
    """The transfers of the first ``least`` ids seen, each id ``least`` times at most."""

    def __init__(self, least: int):
        self.least = least
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.places: list[int] = []
        self.distinct = 0

    def add(self, eid, place: int) -> None:
        ids = self.ids
        if self.distinct >= self.least and eid > ids[-1]:
            return
        at = bisect_right(ids, eid)
        if at and ids[at - 1] == eid:
            if at - bisect_left(ids, eid) >= self.least:
                return
        else:
            self.distinct += 1
        ids.insert(at, eid)
        self.places.insert(at, place)
        if self.distinct > self.least:
            end = bisect_left(ids, ids[-1])
            del ids[end:], self.places[end:]
            self.distinct -= 1


def _answers(least: int):
    """Reads transfers (kind 0 and 1) and questions (2) in their order; see ``TimeCutIndex.first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, live, current = _First(least), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            steps = batch.column("__step")
            if live is not None:
                steps = pa.concat_arrays([live, steps])
            base = len(steps) - batch.num_rows
            kinds = batch.column("__kind").to_pylist()
            slots = list(zip(*(batch.column(c).to_pylist() for c in ("__acc", "__left", "__chunk", "__copy"))))
            eids = batch.column("__step").field("__eid").to_pylist()
            used, keeps, q = batch.column("__used").to_pylist(), batch.column("__keep").to_pylist(), batch.column("__q")
            whose, which, rank, count = [], [], [], []

            def flush():
                return pa.RecordBatch.from_arrays(
                    [q.take(pa.array(whose, pa.int64())), steps.take(pa.array(which, pa.int64())), pa.array(rank, pa.int32()), pa.array(count, pa.int32())],
                    ["q", "step", "__rank", "__n"],
                )

            for i, kind in enumerate(kinds):
                if slots[i] != current:
                    current = slots[i]
                    first.clear()
                if kind < 2:
                    first.add(eids[i], base + i)
                    continue
                before, keep, n = used[i], keeps[i], 0
                for eid, place in zip(first.ids, first.places):
                    if n == keep:
                        break
                    if eid not in before:
                        n += 1
                        which.append(place)
                whose += [i] * n
                rank += range(1, n + 1)
                count += [n] * n
                if len(whose) > 1 << 16:
                    yield flush()
                    whose, which, rank, count = [], [], [], []
            if whose:
                yield flush()
            live = steps.take(pa.array(first.places, pa.int64()))
            first.places = list(range(len(first.places)))

    return run


def _passed_on(least: int):
    """For each chunk of one account the first transfers of the chunks before it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__chunk").combine_chunks()
        eids = pc.struct_field(table.column("__step"), "__eid").to_pylist()
        first, now, take, target = _First(least), None, [], []
        for i, (chunk, eid) in enumerate(zip(table.column("__chunk").to_pylist(), eids)):
            if chunk != now:
                now = chunk
                take += first.places
                target += [chunk] * len(first.places)
            if eid is not None:
                first.add(eid, i)
        out = table.take(pa.array(take, pa.int64()))
        return pa.table({**{c: out.column(c) for c in ("__acc", "__left")}, "__chunk": pa.array(target, pa.int64()), "__step": out.column("__step")})

    return run
