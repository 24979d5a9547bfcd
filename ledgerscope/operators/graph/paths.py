"""Cycles and fund trails: iterative self joins that use each transfer at most once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.operators.graph.adjacency import TimeCutIndex
from ledgerscope.operators.graph.components import strong_components
from ledgerscope.scale import cut_lineage, micros, top_per_key

# Partial trails a repeated round may hold in all.
ROUND_ROWS = 20_000
# Candidates up to which all partial trails of a group of seeds are extended at once.
AT_ONCE_ROWS = 1_000_000
# Seeds of a level from which on it is held instead of worked out again.
HELD_ROWS = 100_000
# Transfers of an account, or questions on it, that one task reads (as a power of two).
PIECE_BITS = 18


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("__from"),
        F.col("dst").alias("__to"),
        F.col("amount").cast("double").alias("__amount"),
        F.col("ts").alias("__ts"),
        F.coalesce("channel", F.lit("UPI")).alias("__channel"),
        F.col("transaction_id").alias("__eid"),
    )


def _grow(paths: DataFrame, steps: DataFrame, tail: str, joint: Column, keep: list[str]) -> DataFrame:
    """Extend every path by one unused transfer."""
    unused = ~F.array_contains("edge_ids", F.col("__eid"))
    return paths.join(steps, joint & unused).select(
        *keep,
        F.concat("nodes", F.array(tail)).alias("nodes"),
        F.concat("edge_ids", F.array("__eid")).alias("edge_ids"),
        F.concat("amounts", F.array("__amount")).alias("amounts"),
        F.concat("times", F.array("__ts")).alias("times"),
        F.concat("channels", F.array("__channel")).alias("channels"),
        F.col(tail).alias("tip"),
    )


def cycles(
    edges: DataFrame, as_of: Column, days: int = 7, min_hops: int = 2, max_hops: int = 8, k: int = 5
) -> DataFrame:
    """The first ``k`` round trips of every account, by (hops, transfer ids).

    Every cycle lies inside one strong component, so other transfers are dropped
    first.  Shorter cycles sort first: each round closes paths before it grows
    them, and an account with ``k`` cycles stops growing - that loses nothing.
    From the middle on, backward hop distances of the accounts still searching tell
    which paths can close in the hops that are left; only those grow, so neither side
    goes further than half the hops.
    """
    recent = edges.filter(
        (F.col("ts").cast("timestamp") > as_of - F.expr(f"INTERVAL {days} DAYS"))
        & (F.col("src") != F.col("dst"))
    )
    recent = cut_lineage(recent)
    member = strong_components(recent)
    inside = recent.join(
        member.select(F.col("account_id").alias("src"), F.col("component").alias("__a")), "src"
    ).join(member.select(F.col("account_id").alias("dst"), F.col("component").alias("__b")), "dst")
    steps = cut_lineage(_steps(inside.filter("__a = __b")))
    paths = steps.select(
        F.col("__from").alias("start"),
        F.array("__from", "__to").alias("nodes"),
        F.array("__eid").alias("edge_ids"),
        F.array("__amount").alias("amounts"),
        F.array("__ts").alias("times"),
        F.array("__channel").alias("channels"),
        F.col("__to").alias("tip"),
    )
    columns = ["start", "nodes", "edge_ids", "amounts", "times", "channels"]
    found: DataFrame | None = None
    back: DataFrame | None = None
    for hops in range(2, max_hops + 1):
        closed = _grow(
            paths,
            steps,
            "__to",
            (F.col("tip") == F.col("__from")) & (F.col("start") == F.col("__to")),
            ["start"],
        ).select(*columns, F.lit(hops).alias("hops"))
        if hops >= min_hops:
            merged = closed if found is None else found.unionByName(closed)
            found = cut_lineage(top_per_key(merged, ["start"], [F.asc("hops"), F.asc("edge_ids")], k))
        if hops == max_hops:
            break
        open_paths = paths
        if found is not None:
            full = found.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            open_paths = paths.join(full.select("start"), "start", "left_anti")
        grown = _grow(open_paths, steps, "__to", F.col("tip") == F.col("__from"), ["start"])
        left = max_hops - hops
        if left <= max_hops // 2:
            if back is None:
                back = distances_to(open_paths.select("start").distinct(), steps, left)
            grown = grown.join(
                back.filter(F.col("distance") <= left).select("start", F.col("node").alias("tip")), ["start", "tip"], "left_semi"
            )
        paths = cut_lineage(grown)
        if not paths.take(1):
            break
    order = Window.partitionBy("start").orderBy("hops", "edge_ids")
    if found is None:
        return paths.select(*columns, F.lit(0).alias("hops"), F.lit(0).alias("rank")).limit(0)
    return found.withColumn("rank", F.row_number().over(order))


def distances_to(starts: DataFrame, steps: DataFrame, radius: int) -> DataFrame:
    """``start, node, distance``: accounts from which ``start`` is at most ``radius`` hops away."""
    links = cut_lineage(steps.select("__from", "__to").distinct())
    reached = cut_lineage(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")))
    frontier = reached
    for hop in range(1, radius + 1):
        into = frontier.join(links, F.col("node") == F.col("__to")).select("start", F.col("__from").alias("node")).distinct()
        frontier = cut_lineage(
            into.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(hop))
        )
        reached = reached.unionByName(frontier)
    return reached


def trails(
    seeds: DataFrame,
    edges: DataFrame,
    direction: str = "forward",
    max_hops: int = 10,
    k: int = 20,
    beam: int = 4,
    chunk_bits: int = PIECE_BITS,
) -> DataFrame:
    """The ``k`` longest trails of every seed ``(seed_id, account_id, seed_ts)``.

    Forward trails leave the account through transfers at or after the seed time;
    backward trails arrive through transfers at or before it.  Order: hops, longest
    first, then transfer ids from the seed outwards.

    For each account and number of hops one number tells from which time on a walk of
    that length still starts there.  It gives every seed the longest length it can hope
    for, and each partial trail whether it can still get there.

    A round keeps the ``beam`` first partial trails of a seed in that order (``k`` at the
    last hop; the first round one of them until the hop before that).  Any dropped partial
    trail sorts after every kept one of the same length, so once a seed has ``k`` trails of
    the longest length they are the right ones.  The first two rounds follow only partial
    trails that can still get there; seeds without ``k`` such trails (walks may use a
    transfer twice, trails may not) run again without that test, and with a wider beam as
    long as they lose partial trails.

    Partial trails travel with their transfer ids alone.  Each level stores what its last
    step adds and the place of the partial trail it extends; the kept trails are put
    together at the end, from the steps of a seed.

    What follows the first partial trail sorts before what follows the second, so partial
    trails are taken in order until a seed has enough, and each needs only its tip's first
    fitting transfers, which ``TimeCutIndex.first`` gives: rows grow with seeds times beam,
    not with the transfers of a hub.
    """
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    forward = direction == "forward"
    head, tail = ("__from", "__to") if forward else ("__to", "__from")
    steps = _steps(edges.filter(F.col("src") != F.col("dst")))
    bounds = walk_bounds(steps, head, tail, not forward, max_hops)
    index = TimeCutIndex(steps, head, not forward, chunk_bits, (tail, bounds))
    since = index.time("seed_ts")
    hopeful = seeds.filter("seed_id IS NOT NULL").select("seed_id", "account_id", since.alias("since"))
    # Equal seeds are followed once.
    hopeful = hopeful.groupBy(*hopeful.columns).agg(F.count(F.lit(1)).alias("copies")).join(bounds, "account_id")
    # Bounds fall with the length, so those that are met are the first ones.
    aimed = hopeful.withColumn("aim", F.size(F.filter("bounds", lambda at: at >= F.col("since")))).filter("aim > 0")
    aimed = aimed.select("seed_id", F.col("account_id").alias("origin"), "since", "aim", "copies")
    open_seeds = cut_lineage(aimed.withColumn("sid", F.monotonically_increasing_id()))
    # One id may come several times, also with several accounts or times.
    repeated = open_seeds.groupBy("seed_id").agg(F.sum("copies").alias("n"), F.max("copies").alias("copies")).filter("n > 1")
    repeated = cut_lineage(repeated.select("seed_id", "copies"))
    open_seeds = open_seeds.drop("copies")
    done: list[DataFrame] = []
    rounds = 0
    while open_seeds.take(1) or not done:
        # Walks may use a transfer twice, so even the second round may need the test.
        found, open_seeds = _trail_round(open_seeds, index, tail, max_hops, k, beam, rounds < 2, narrow=rounds == 0)
        done.append(found)
        # Few seeds may have wide beams from the start; every width gives the same trails.
        rounds, beam = rounds + 1, beam * 8 if rounds == 0 else max(beam * 8, ROUND_ROWS // max(1, open_seeds.count()))
    every = reduce(DataFrame.unionByName, done)
    order = [F.desc("hops"), F.asc("edge_ids")]
    # A transfer that comes twice has two places, so places do not give the order.
    if index.stored.groupBy("__step.__eid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy(*order)))
    if not repeated.take(1):
        return every
    # A seed that comes n times extends n partial trails n times: each trail stands n * n times.
    times = F.array_repeat(F.lit(0), (F.col("copies") * F.col("copies")).cast("int"))
    again = every.join(repeated, "seed_id").withColumn("__again", F.explode(times)).select(*every.columns)
    several = top_per_key(again, ["seed_id"], order, k)
    several = several.withColumn("rank", F.row_number().over(Window.partitionBy("seed_id").orderBy(*order)))
    return every.join(repeated, "seed_id", "left_anti").unionByName(several)


def walk_bounds(steps: DataFrame, head: str, tail: str, backward: bool, max_hops: int) -> DataFrame:
    """``account_id, bounds``: the latest time from which a walk of 1, 2, .. hops still starts.

    A walk of ``h`` hops over transfers from a time on exists if its first transfer is
    late enough and a walk of ``h - 1`` hops exists where that leads: the maximum over
    transfers of the minimum of both.  ``backward`` turns time around.
    """
    at = micros("__ts")
    links = steps.withColumn("__at", -at if backward else at).filter(F.col("__at").isNotNull())
    # Of parallel transfers only the latest matters.
    links = cut_lineage(links.groupBy(F.col(head).alias("a"), F.col(tail).alias("b")).agg(F.max("__at").alias("at")))
    first = links.groupBy("a").agg(F.max("at").alias("top"))
    # Longer walks go on over links into accounts that have links themselves, and only accounts
    # that links lead to are met on the way: the rounds need no others.
    on = links.join(first.select(F.col("a").alias("b")), "b", "left_semi")
    met = on.select(F.col("b").alias("a")).distinct()
    tops = cut_lineage(first.join(met, "a", "left_semi"))
    inner = cut_lineage(on.join(met, "a", "left_semi"))

    def longer(links, bounds, lengths):
        after = links.join(bounds.select(F.col("a").alias("b"), "bounds"), "b")
        best = [F.max(F.when(F.get("bounds", F.lit(i)).isNotNull(), F.least("at", F.get("bounds", F.lit(i))))) for i in range(lengths)]
        return after.groupBy("a").agg(F.array(*best).alias("more"))

    def told(tops, more):
        return tops.join(more, "a", "left").select("a", F.concat(F.array("top"), F.coalesce("more", F.array())).alias("bounds"))

    bounds = tops.select("a", F.array("top").alias("bounds"))
    for hops in range(2, max_hops):
        bounds = told(tops, longer(inner, bounds, hops - 1))
        if hops % 5 == 0:
            bounds = cut_lineage(bounds)
    if max_hops > 1:
        bounds = told(first, longer(on, bounds, max_hops - 1))
    else:
        bounds = first.select("a", F.array("top").alias("bounds"))
    return cut_lineage(bounds.withColumnRenamed("a", "account_id"))


def _trail_round(seeds, index, tail, max_hops, k, beam, pruned, narrow):
    """The trails of the settled seeds, and the seeds still open."""
    element = {f.name: f.dataType.simpleString() for f in index.steps.schema.fields}
    # Hops are counted in the rows: the plans of all levels are alike.
    paths = seeds.select(
        "sid",
        "since",
        "aim",
        F.lit(0).alias("hop"),
        F.array().cast(f"array<{element['__eid']}>").alias("edge_ids"),
        F.col("origin").alias("tip"),
        F.lit(1).alias("place"),
    )
    aims = {r["aim"]: r["n"] for r in seeds.groupBy("aim").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The last hop of a seed's trails keeps ``k``; the first two rounds keep one partial trail, or
    # an eighth, until the hop before that, as what follows the first ones sorts first.
    wide, last = beam if not pruned else 1 if narrow else -(-beam // 8), max(k, beam)
    left = (F.col("aim") if pruned else F.lit(max_hops)) - F.col("hop") - 1
    more = 0 if pruned else 1
    keep = F.when(left >= 2, wide + more).when(left == 1, beam + more).otherwise(last + more)
    levels, lost, full = [], [], []
    for hops in range(1, max_hops + 1):
        going = sum(n for a, n in aims.items() if a > hops or not pruned and hops < max_hops)
        ending = sum(n for a, n in aims.items() if a == hops) if pruned else sum(aims.values()) - going
        parts, held = [], []
        # Part of the seeds, its questions, the widest level, whether there is one question a seed.
        jobs = [(left > 0, going * (1 if hops == 1 else wide), max(wide, beam), hops == 1 or wide == 1)]
        jobs += [(left <= 0, ending * (1 if hops == 1 else beam), last, hops == 1 or beam == 1)]
        jobs = [job for job in jobs if job[1]] or jobs[:1]
        if len(jobs) == 2 and all(single or many * widest <= AT_ONCE_ROWS for _, many, widest, single in jobs):
            jobs = [(F.lit(True), sum(job[1] for job in jobs), last, all(job[3] for job in jobs))]
        for mine, many, widest, single in jobs:
            part = paths.filter(mine).withColumns({"left": left, "keep": keep})
            at_once = single or many * widest <= AT_ONCE_ROWS
            parts.append(_extend(part, index, tail, hops, widest + more, many, pruned, single, at_once, held))
        grown = reduce(DataFrame.unionByName, parts)
        # A checkpoint works out what follows the last shuffle twice.
        if len(held) or going + ending > HELD_ROWS:
            grown = grown.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(grown)
        grown = cut_lineage(grown)
        for df in held:
            df.unpersist()
        paths = grown
        if not pruned:
            keeps = last if hops == max_hops else beam
            lost.append(grown.filter(F.col("place") > keeps).select("sid"))
            paths = grown.filter(F.col("place") <= keeps)
        full.append(paths.filter((F.col("aim") == F.col("hop")) & (F.col("place") == k)).select("sid"))
        levels.append(paths.select("sid", "hop", "place", *_STEP))
        paths = paths.select("sid", "since", "aim", "hop", "edge_ids", F.col("node").alias("tip"), "place")
        if pruned:
            paths = paths.filter(F.col("aim") > F.col("hop"))
        if not (max(aims, default=0) > hops if pruned else paths.take(1)):
            break
    settled = reduce(DataFrame.union, full)
    if not pruned:
        # Who lost no partial trail has all trails.
        lossless = seeds.select("sid").join(reduce(DataFrame.union, lost).distinct(), "sid", "left_anti")
        settled = settled.union(lossless).distinct()
    settled = cut_lineage(settled)
    return _told(levels, seeds.join(settled, "sid", "left_semi"), k), cut_lineage(seeds.join(settled, "sid", "left_anti"))


# What each level adds to a partial trail, and the place of the one it extends.
_STEP = ["before", "node", "eid", "amount", "ts", "channel"]


def _told(levels: list[DataFrame], settled: DataFrame, k: int) -> DataFrame:
    """The first ``k`` trails of each settled seed, longest first, as rows with their ranks.

    A seed's steps are read in the order of hop and place.  Places of a level are 1, 2, .., so
    the row that a step extends is known by its number; places follow the transfer ids, so they
    give the order of trails of one length.
    """
    steps = reduce(DataFrame.unionByName, levels)
    kind = {f.name: f.dataType for f in steps.schema.fields}
    seed = settled.schema["seed_id"].dataType
    none = {c: F.lit(None).cast(kind[c]).alias(c) for c in ("eid", "amount", "ts", "channel")}
    zero = [F.lit(v).alias(c) for c, v in (("hop", 0), ("place", 1), ("before", 0))]
    roots = settled.select("sid", *zero, F.col("origin").alias("node"), *none.values(), "seed_id")
    rows = steps.withColumn("seed_id", F.lit(None).cast(seed)).unionByName(roots)
    lists = {"nodes": "node", "edge_ids": "eid", "amounts": "amount", "times": "ts", "channels": "channel"}
    out = T.StructType(
        [T.StructField("seed_id", seed)]
        + [T.StructField(name, T.ArrayType(kind[c])) for name, c in lists.items()]
        + [T.StructField(name, T.IntegerType()) for name in ("hops", "rank")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            sid = batch.column("sid").to_numpy()
            if not len(sid):
                continue
            # The last seed of a batch may go on in the next one.
            end = int(np.searchsorted(sid, sid[-1]))
            if end or (rest and rest[-1].column("sid")[-1].as_py() != sid[0]):
                yield from trails_of([*rest, batch.slice(0, end)])
                rest = []
            rest.append(batch.slice(end))
        if rest:
            yield from trails_of(rest)

    def trails_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        sid, hop, place, before = (table.column(c).to_numpy() for c in ("sid", "hop", "place", "before"))
        new = np.concatenate(([True], sid[1:] != sid[:-1]))
        seed_of = np.cumsum(new) - 1
        # Seeds that are not settled have no root.
        known = (hop == 0)[np.flatnonzero(new)][seed_of]
        run_start = np.flatnonzero(new | np.concatenate(([True], hop[1:] != hop[:-1])))
        run_of = np.searchsorted(run_start, np.arange(len(sid)), side="right") - 1
        parent = run_start[run_of - 1] + before - 1
        ends = np.flatnonzero(known & (hop > 0))
        ends = ends[np.lexsort((place[ends], -hop[ends], seed_of[ends]))]
        if not len(ends):
            return
        first = np.concatenate(([True], seed_of[ends][1:] != seed_of[ends][:-1]))
        rank = np.arange(len(ends)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        ends, rank = ends[rank < k], rank[rank < k]
        hops = hop[ends]
        at = np.zeros((len(ends), int(hops.max()) + 1), np.int64)
        now, rows_ = ends.copy(), np.arange(len(ends))
        while len(rows_):
            at[rows_, hop[now]] = now
            on = hop[now] > 0
            rows_, now = rows_[on], parent[now[on]]
        hold = np.arange(at.shape[1]) <= hops[:, None]
        node_at = pa.array(at[hold])
        hold[:, 0] = False
        step_at = pa.array(at[hold])
        ends_at = np.concatenate(([0], np.cumsum(hops))).astype(np.int32)
        columns = [table.column("seed_id").combine_chunks().take(pa.array(at[:, 0]))]
        for name, c in lists.items():
            values = table.column(c).combine_chunks().take(node_at if name == "nodes" else step_at)
            offsets = ends_at + np.arange(len(ends_at), dtype=np.int32) if name == "nodes" else ends_at
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
        columns += [pa.array(hops.astype(np.int32)), pa.array((rank + 1).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], out.names)

    return rows.repartition("sid").sortWithinPartitions("sid", "hop", "place").mapInArrow(run, out)


def _extend(paths, index, tail, hops, widest, many, pruned, single, at_once, held) -> DataFrame:
    """The first ``keep`` one-hop extensions of each seed, ranked in ``place``.

    Unless all are asked ``at_once``, first only the first partial trail of each seed is
    extended; the others follow for seeds that have not enough by then.  What is read more
    than once until the level is stored is put in ``held``.
    """

    def asked(some):
        questions = some if pruned else some.withColumn("ahead", F.lit(0))
        return index.first(questions, "tip", "since", "left" if pruned else "ahead", "edge_ids", "keep", widest + hops, many)

    def first_by_id(rows):
        order = Window.partitionBy("sid").orderBy("place", "__eid")
        return rows.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= F.col("keep"))

    if single:
        ranked = asked(paths).withColumn("__place", F.col("__rank"))
    elif at_once:
        ranked = first_by_id(asked(paths))
    else:
        first = asked(paths.filter("place = 1")).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(first)
        enough = F.col("__n") == F.col("keep")
        rest = paths.filter("place > 1").join(first.filter(enough & (F.col("__rank") == 1)).select("sid"), "sid", "left_anti")
        short = first_by_id(first.filter(~enough).unionByName(asked(rest)))
        ranked = first.filter(enough).withColumn("__place", F.col("__rank")).unionByName(short)
    return ranked.select(
        "sid",
        "since",
        "aim",
        (F.col("hop") + 1).alias("hop"),
        F.when(F.col("left") > 0, F.concat("edge_ids", F.array("__eid"))).alias("edge_ids"),
        F.col("__place").alias("place"),
        F.col("place").alias("before"),
        F.col(tail).alias("node"),
        F.col("__eid").alias("eid"),
        F.col("__amount").alias("amount"),
        F.col("__ts").alias("ts"),
        F.col("__channel").alias("channel"),
    )


def longest_paths(paths: DataFrame, key: str = "seed_id", k: int = 20) -> DataFrame:
    """The ``k`` longest paths per seed; ties by transfer ids."""
    return top_per_key(paths, [key], [F.desc("hops"), F.asc("edge_ids")], k)
