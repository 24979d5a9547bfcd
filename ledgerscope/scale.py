"""Building blocks that keep operators whole and balanced when one key is hot.

A plain ``Window.partitionBy(account)`` puts one account in one task.  An account
(or payee, terminal, fingerprint) may hold a third of all rows, so the operators
use these helpers instead: cold keys keep the one-shuffle window, hot keys are
cut into time buckets whose totals are combined by prefix sums.  Results are the
same on both routes; nothing is sampled, capped or dropped.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot above this many rows.  At most (rows / HOT_ROWS) keys can be hot,
# which bounds the broadcast of the hot-key list (10^12 rows -> 10^6 keys).
HOT_ROWS = 1_000_000
HOT_ROWS_CONF = "spark.ledgerscope.hotRows"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; set up on first use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            # A folder of this machine serves a local session only.
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="ledgerscope-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage and forget how it was made."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_estimates(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as :func:`cut_lineage` does, and let its real size replace the planner's estimate.

    A checkpoint keeps the estimate of its plan, and estimates of joins are products.  In a
    round that joins results of the round before several times, the number's length grows by a
    factor each round, until the driver does nothing but multiply it.  A stored table's size
    is known, so what is read from it starts anew.
    """
    stored = df.persist(StorageLevel.DISK_ONLY)
    stored.count()
    out = cut_lineage(stored)
    stored.unpersist()
    return out


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than ``HOT_ROWS`` rows; map-side combine makes this cheap."""
    limit = hot_rows(df.sparkSession)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counted.filter(F.col("__rows") > limit).select(*keys)


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cold keys and rows of hot keys (None when no key is hot).

    The check is one map-side-combined count over the key column.  Without hot keys
    the plan stays a single branch and keeps its partitioning for what follows.
    """
    found = hot_keys(df, keys).select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    if not found.take(1):
        return df, None
    # Size bound of the broadcast: rows / HOT_ROWS keys, see above.
    hot = F.broadcast(found)
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]
    )
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def trailing_stats(
    df: DataFrame,
    key: str,
    ts: str,
    measures: dict[str, tuple[int, str, str | None]],
    include_current: bool = False,
    bucket_seconds: int = 60,
) -> DataFrame:
    """Add trailing counts, sums and means per key at every row.

    ``measures`` maps an output name to ``(span_seconds, "count"|"sum"|"avg",
    column)``.  The span is open at its old end and, unless ``include_current``,
    ends strictly before the row, so ties and the row itself stay out.  Means are
    over values that are not null; rows without a time have an empty span, rows
    without a key form one group; repeated rows and ids are all kept.
    """
    cold, hot = split_hot(df, [key])
    windowed = _trailing_cold(cold, key, ts, measures, include_current)
    if hot is None:
        return windowed
    # Rows without a time have an empty span on either route.
    untimed = hot.filter(F.col(ts).isNull())
    return windowed.unionByName(
        _trailing_hot(hot.filter(F.col(ts).isNotNull()), key, ts, measures, include_current, bucket_seconds)
    ).unionByName(untimed.select(*df.columns, *_empty_spans(measures)))


def _empty_spans(measures):
    return [(F.lit(0).cast("long") if kind == "count" else F.lit(0.0)).alias(n) for n, (_, kind, _) in measures.items()]


def _trailing_cold(df, key, ts, measures, include_current):
    """Differences of running totals, one shuffle by key.

    A frame that starts at the beginning of the partition is updated as it grows,
    so each total costs one pass; a frame with two moving ends would be added up
    again at every row.  Sums run in decimals, where differences are exact.
    """
    order = Window.partitionBy(key).orderBy("__us")
    start = Window.unboundedPreceding
    out = df.withColumn("__us", micros(ts))
    end = 0 if include_current else -1
    cache: dict[tuple, str] = {}

    def running(out, how, column, upper):
        name = cache.get((how, column, upper))
        if name is None:
            name = f"__r{len(cache)}"
            cache[(how, column, upper)] = name
            value = F.lit(1) if column is None else F.col(column).cast("decimal(28,6)")
            total = F.count(value) if how == "count" else F.sum(value)
            out = out.withColumn(name, F.coalesce(total.over(order.rangeBetween(start, upper)), F.lit(0)))
        return out, F.col(name)

    results = {}
    timed = F.col("__us").isNotNull()
    for name, (span, kind, column) in measures.items():
        old = -span * 1_000_000
        # A mean is over the values that are there, as SQL's AVG.
        out, n_now = running(out, "count", column if kind == "avg" else None, end)
        out, n_old = running(out, "count", column if kind == "avg" else None, old)
        count = n_now - n_old
        if kind == "count":
            results[name] = F.when(timed, count).otherwise(F.lit(0).cast("long"))
            continue
        out, s_now = running(out, "sum", column, end)
        out, s_old = running(out, "sum", column, old)
        total = (s_now - s_old).cast("double")
        value = total if kind == "sum" else F.when(count > 0, total / count)
        results[name] = F.coalesce(F.when(timed, value), F.lit(0.0))
    return out.select(*df.columns, *[value.alias(name) for name, value in results.items()])


def _trailing_hot(df, key, ts, measures, include_current, bucket_seconds):
    """Prefix-sum route.

    Every row becomes one data event at its time t and one probe per distinct
    span at t - span.  Bucket totals give the prefix before a bucket (rows per
    key: the number of buckets, not the number of rows); a window inside one
    bucket gives the rest.  The answer is prefix(t) - prefix(t - span).
    """
    spans = sorted({span for span, _, _ in measures.values()})
    columns = sorted({c for _, kind, c in measures.values() if kind != "count"})
    bucket = bucket_seconds * 1_000_000
    exact = "decimal(38,6)"
    # Ids of the table may repeat: every row gets one of its own, fixed by the cut.
    df = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    kept = [c for c in df.columns if c != "__id"]
    base = df.select(
        F.struct(*kept).alias("__row"),
        F.col(key).alias("__key"),
        "__id",
        micros(ts).alias("__us"),
        *[F.col(c).cast(exact).alias(f"__m_{c}") for c in columns],
    )
    events = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("__us").alias("at")),
        *[
            F.struct(F.lit(s).alias("kind"), (F.col("__us") - s * 1_000_000).alias("at"))
            for s in spans
        ],
    )
    data = F.col("__e.kind") == 0
    exploded = base.withColumn("__e", F.explode(events)).select(
        F.when(data, F.col("__row")).alias("__row"),
        "__key",
        "__id",
        F.col("__e.kind").alias("kind"),
        F.col("__e.at").alias("at"),
        F.floor(F.col("__e.at") / bucket).alias("__b"),
        F.when(data, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n"),
        *[F.when(data, F.col(f"__m_{c}")).cast(exact).alias(f"s_{c}") for c in columns],
        *[F.when(data & F.col(f"__m_{c}").isNotNull(), 1).otherwise(0).cast("long").alias(f"k_{c}") for c in columns],
    )
    real = F.col("kind") == 0
    values = ["n"] + [f"{p}_{c}" for c in columns for p in ("s", "k")]
    totals = exploded.groupBy("__key", "__b").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        F.col("__key").alias("__pk"),
        F.col("__b").alias("__pb"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"p_{v}") for v in values],
    )
    inside = Window.partitionBy("__key", "__b").orderBy("at")
    up_to = inside.rangeBetween(Window.unboundedPreceding, 0)
    below = inside.rangeBetween(Window.unboundedPreceding, -1)
    own = up_to if include_current else below
    local = exploded
    for v in values:
        local = local.withColumn(
            f"c_{v}",
            F.coalesce(
                F.when(real, F.sum(v).over(own)).otherwise(F.sum(v).over(up_to)), F.lit(0)
            ),
        )
    joined = local.join(
        prefix,
        local["__key"].eqNullSafe(prefix["__pk"]) & (local["__b"] == prefix["__pb"]),
    )
    aggregates = [F.first("__row", ignorenulls=True).alias("__row")]
    for kind in [0, *spans]:
        for v in values:
            aggregates.append(
                F.max(F.when(F.col("kind") == kind, F.col(f"p_{v}") + F.col(f"c_{v}"))).alias(
                    f"v_{kind}_{v}"
                )
            )
    gathered = joined.groupBy("__id").agg(*aggregates)
    out = [F.col(f"__row.{c}").alias(c) for c in kept]
    for name, (span, kind, column) in measures.items():
        if kind == "count":
            out.append((F.col("v_0_n") - F.col(f"v_{span}_n")).cast("long").alias(name))
            continue
        total = (F.col(f"v_0_s_{column}") - F.col(f"v_{span}_s_{column}")).cast("double")
        count = F.col(f"v_0_k_{column}") - F.col(f"v_{span}_k_{column}")
        value = total if kind == "sum" else F.when(count > 0, total / count)
        out.append(F.coalesce(value, F.lit(0.0)).alias(name))
    return gathered.select(*out)


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    at: str,
    valid_from: str,
    take: Sequence[str],
    valid_until: str | None = None,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Each row of ``left`` with ``take`` of the version of its key in force at its time, or nulls.

    A version is in force from ``valid_from`` (inclusive) until the next one, and not from
    ``valid_until`` on, where that is given and not null.  Of versions with equal start the
    one with the largest ``take`` values counts.  Rows without key or time, and versions
    without start, match nothing; every row of ``left`` comes out once.

    Both sides meet in one shuffle by key.  Keys with very many rows are cut into buckets
    of time: the last version of each bucket is carried to later ones, so a row looks only
    within its own bucket.
    """
    version = F.struct(micros(valid_from).alias("from"), *[F.col(c).alias(c) for c in [*take, *([valid_until] if valid_until else [])]])
    versions = right.select(F.col(key).alias("__key"), micros(valid_from).alias("__us"), version.alias("__v"))
    versions = versions.filter(F.col("__key").isNotNull() & F.col("__us").isNotNull())
    versions = versions.groupBy("__key", "__us").agg(F.max("__v").alias("__v"))
    rows = left.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), micros(at).alias("__us"))
    placed = F.col("__key").isNotNull() & F.col("__us").isNotNull()
    timed, rest = rows.filter(placed), rows.filter(~placed)
    both = timed.withColumn("__v", F.lit(None).cast(versions.schema["__v"].dataType)).withColumn("__side", F.lit(1))
    empty = F.lit(None).cast(rows.schema["__row"].dataType)
    both = both.unionByName(versions.select(empty.alias("__row"), "__key", "__us", "__v", F.lit(0).alias("__side")))
    cold, hot = split_hot(both, ["__key"])
    last = F.last("__v", ignorenulls=True)
    before = Window.unboundedPreceding
    joined = cold.withColumn("__found", last.over(Window.partitionBy("__key").orderBy("__us", "__side").rowsBetween(before, 0)))
    if hot is not None:
        cut = hot.withColumn("__b", F.floor(F.col("__us") / (bucket_seconds * 1_000_000)))
        ends = cut.groupBy("__key", "__b").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__e"))
        earlier = Window.partitionBy("__key").orderBy("__b").rowsBetween(before, -1)
        ends = ends.select("__key", "__b", F.last("__e", ignorenulls=True).over(earlier).alias("__carried"))
        inside = last.over(Window.partitionBy("__key", "__b").orderBy("__us", "__side").rowsBetween(before, 0))
        looked = cut.withColumn("__found", inside).join(ends, ["__key", "__b"])
        joined = joined.unionByName(
            looked.withColumn("__found", F.coalesce("__found", "__carried")).select(*joined.columns)
        )
    joined = joined.filter("__side = 1").select("__row", "__us", "__found").unionByName(
        rest.select("__row", "__us", F.lit(None).cast(versions.schema["__v"].dataType).alias("__found"))
    )
    if valid_until:
        over = micros(F.col("__found").getField(valid_until)) <= F.col("__us")
        joined = joined.withColumn("__found", F.when(F.coalesce(over, F.lit(False)), None).otherwise(F.col("__found")))
    return joined.select("__row.*", *[F.col("__found").getField(c).alias(c) for c in take])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows per key.  Spark limits each key map-side before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")


# Rows of one range part: what one window task sorts.
PART_ROWS = 500_000


def range_parts(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Rows with ``__part``, ascending along ``order``; stored, as parts must not change between uses.

    Part borders come from Spark's own sample of the stored rows.  ``df`` itself is run once.
    """
    stored = cut_lineage(df)
    parts = parts or max(1, -(-stored.count() // PART_ROWS))
    return cut_lineage(stored.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: str | None = None,
    descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Running sums of ``values`` along ``order`` (inclusive), without one global task.

    ``df`` has one row per (``by``, ``order``).  Adds ``cum_<value>`` and ``tot_<value>``.
    """
    return _running(df, order, values, by, descending, parts, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def running_max(df: DataFrame, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Largest ``value`` so far along ``order`` (inclusive); adds ``cum_<value>``."""
    # greatest() skips nulls, so an empty start leaves the other side.
    return _running(df, order, [value], None, False, parts, F.max, F.greatest)


def _running(df, order, values, by, descending, parts, combine, join_parts):
    """Two passes over range parts: a window inside each, and the combined value of the parts before."""
    direction = F.desc if descending else F.asc
    keyed = df.withColumn("__by", F.col(by) if by else F.lit(0))
    placed = range_parts(keyed, [F.asc("__by"), direction(order)], parts)
    along = Window.partitionBy("__by").orderBy("__part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__by")
    totals = placed.groupBy("__by", "__part").agg(*[combine(v).alias(v) for v in values])
    offsets = totals.select(
        F.col("__by").alias("__of"),
        F.col("__part").alias("__at"),
        *[combine(v).over(earlier).alias(f"__off_{v}") for v in values],
        *[combine(v).over(whole).alias(f"tot_{v}") for v in values],
    )
    inside = (
        Window.partitionBy("__by", "__part").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    for v in values:
        placed = placed.withColumn(f"__in_{v}", combine(v).over(inside))
    # One row per part and per ``by`` value in it.
    joined = placed.join(offsets, (F.col("__part") == F.col("__at")) & F.col("__by").eqNullSafe(F.col("__of")))
    for v in values:
        joined = joined.withColumn(f"cum_{v}", join_parts(F.col(f"__in_{v}"), F.col(f"__off_{v}")))
    return joined.drop("__by", "__of", "__part", "__at", *[f"__in_{v}" for v in values], *[f"__off_{v}" for v in values])


def exact_quantiles(
    df: DataFrame, feature: str, value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Interpolated quantiles per feature of a long table: ``(feature, p, quantile)``.

    Counts per distinct value, then ranks by :func:`prefix_sums`; no feature's
    values are ever gathered in one task.
    """
    counted = df.groupBy(feature, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counted, value, ["n"], by=feature)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = ranked.withColumn("p", wanted).withColumn(
        "pos", F.col("p") * (F.col("tot_n") - 1)
    )
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    low, high = F.floor("pos"), F.ceil("pos")
    return (
        position.groupBy(feature, "p")
        .agg(
            F.max(F.when((low >= first) & (low <= last), F.col(value))).alias("lo"),
            F.max(F.when((high >= first) & (high <= last), F.col(value))).alias("hi"),
            F.max(F.col("pos") - low).alias("frac"),
        )
        .select(feature, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("quantile"))
    )
