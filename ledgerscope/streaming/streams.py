"""Structured Streaming twins of the batch operators.

The late-data rule is the watermark; a batch run over the stored payments gives the
exact figures for what arrived too late.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.operators.evidence import make_alerts
from ledgerscope.operators.novelty import escalation_events, route_discovery
from ledgerscope.operators.profile import sides
from ledgerscope.plans.scoring import score_payments
from ledgerscope.scale import micros
from ledgerscope.sources.sinks import audit_rows, patch_features
from ledgerscope.sources.tables import rejection_reasons


def stream_velocity(
    stream: DataFrame, window: str = "1 hour", slide: str = "5 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """Count and volume per account in sliding windows.

    Partial sums are combined before the shuffle, so a hot account costs one state
    row per window, not a group of rows.
    """
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window, slide), "account_id")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("txn_volume"))
        .select("account_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "txn_count", "txn_volume")
    )


def stream_flows(
    edges: DataFrame, window: str = "1 hour", slide: str = "5 minutes", watermark: str = "10 minutes"
) -> DataFrame:
    """Money in and out of each account in sliding windows."""
    flow = lambda side: F.sum(F.when(F.col("direction") == side, F.col("amount")).otherwise(0.0))
    return (
        sides(edges.withWatermark("ts", watermark))
        .groupBy(F.window("ts", window, slide), "account_id")
        .agg(flow("in").alias("inflow_1h"), flow("out").alias("outflow_1h"))
        .select("account_id", F.col("window.end").alias("end"), "inflow_1h", "outflow_1h")
    )


def patch_latest_flows(flows: DataFrame, features: DataFrame) -> DataFrame:
    """Features with the flows of each account's newest window in the batch."""
    newest = flows.groupBy("account_id").agg(
        F.max_by("inflow_1h", "end").alias("inflow_1h"), F.max_by("outflow_1h", "end").alias("outflow_1h")
    )
    return patch_features(features, newest, ["inflow_1h", "outflow_1h"])


def flow_patch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: the newest flows of the accounts of a batch, as a delta.

    Features are not rewritten; :func:`patched_features` reads what all batches left, so
    patches of earlier batches last until the next nightly table.  Every ``COMPACT_EVERY``
    batches the newest flows of all accounts are written together, and readers take only
    the last of those and the deltas after it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("account_id").agg(
            F.max_by(F.struct("inflow_1h", "outflow_1h"), "end").alias("f"), F.max("end").alias("end")
        )
        # The batch number names the output, so a repeated batch replaces itself.
        newest.select("account_id", "f.*", "end").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % COMPACT_EVERY == 0:
            held = left_by_batches(batch.sparkSession, path, batch_id + 1)
            latest = held.groupBy("account_id").agg(
                F.max_by(F.struct("inflow_1h", "outflow_1h"), "end").alias("f"), F.max("end").alias("end")
            )
            latest.select("account_id", "f.*", "end").write.mode("overwrite").parquet(f"{path}/upto={batch_id}")

    return write


# Batches between two compactions.
COMPACT_EVERY = 32
_PLACE = re.compile(r"/(batch|upto)=(\d+)/")


def left_by_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Rows that the batches below ``before`` left: the last compaction and the deltas after it.

    None before the first batch; any other failure to read is an error.
    """
    try:
        files = spark.read.parquet(f"{path}/*").inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    places = {(m[1], int(m[2])) for m in map(_PLACE.search, files) if m}
    places = {p for p in places if before is None or p[1] < before}
    upto = max((n for kind, n in places if kind == "upto"), default=-1)
    wanted = [f"{path}/batch={n}" for kind, n in sorted(places) if kind == "batch" and n > upto]
    if upto >= 0:
        wanted.append(f"{path}/upto={upto}")
    return spark.read.parquet(*wanted) if wanted else None


def patched_features(features: DataFrame, path: str) -> DataFrame:
    """Features with each account's newest flows of all batches written so far."""
    flows = left_by_batches(features.sparkSession, path)
    return features if flows is None else patch_latest_flows(flows, features)


def stream_dedupe(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """First arrival of each payment id within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def stream_fingerprints(novel: DataFrame, gap: str = "7 days", watermark: str = "10 minutes") -> DataFrame:
    """Hits per fingerprint in sessions closed by a gap; a counter renewed on each hit."""
    return (
        novel.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap), "fingerprint")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .select(
            "fingerprint",
            F.col("session_window.start").alias("start"),
            F.col("session_window.end").alias("end"),
            "occurrences",
        )
    )


def quarantine(stream: DataFrame, as_of: Column, channels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid payments, and broken ones with their reasons for a sink of their own."""
    checked = stream.withColumn("reasons", rejection_reasons(as_of, channels))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def quarantine_alarm(rejected: DataFrame, limit: int = 5) -> DataFrame:
    """Rejected rows per reason, marked when a reason exceeds the limit."""
    return (
        rejected.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("alarm", F.col("n") > limit)
    )


def score_batch_sink(
    enrich: Callable[[DataFrame], DataFrame],
    path: str,
    canaries: DataFrame | None = None,
    model_version: str = "v1.0",
    discover: Callable[[DataFrame], DataFrame] | None = None,
    registry: DataFrame | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: score payments, append scores, alerts and audit rows.

    ``enrich`` joins the static tables (context, gates, scorer outputs) and yields
    ``gate_fired`` and ``raw_score``.  ``discover`` turns cleared payments into
    novel rows, which are queued in the same batch.  Every output of a batch lies in
    a folder named by the batch number: a batch that is run again after a failure
    replaces its own rows instead of adding them twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

        scored = score_payments(enrich(batch), canaries=canaries)
        put(scored.withColumn("scored_at", F.col("ts")), "scores")
        # Later outputs read the stored scores; the plan is not run again.
        stored = batch.sparkSession.read.parquet(f"{path}/scores/batch={batch_id}")
        put(make_alerts(stored), "alerts")
        events = stored.withColumn("event_timestamp", F.col("scored_at"))
        put(audit_rows(events, "SCORE", model_version, ["score", "action", "gate_fired"]), "audit")
        if discover is not None:
            cleared = stored.filter(F.col("action") == "PASS")
            queue = continue_runs(route_discovery(discover(cleared), registry), f"{path}/fingerprint_runs", batch_id)
            put(queue, "novelty_queue")
            kept = batch.sparkSession.read.parquet(f"{path}/novelty_queue/batch={batch_id}")
            put(escalation_events(kept), "escalations")
            put(run_ends(kept), "fingerprint_runs")
            if (batch_id + 1) % COMPACT_EVERY == 0:
                runs = left_by_batches(batch.sparkSession, f"{path}/fingerprint_runs", batch_id + 1)
                put_runs = runs.groupBy("fingerprint").agg(F.max(F.struct("at", "hits")).alias("l")).select("fingerprint", "l.at", "l.hits")
                put_runs.write.mode("overwrite").parquet(f"{path}/fingerprint_runs/upto={batch_id}")

    return write


def run_ends(queue: DataFrame) -> DataFrame:
    """Last hit of each fingerprint of a batch, and its place in its run."""
    last = F.max(F.struct(F.col("created_at").alias("at"), F.col("fingerprint_occurrences").alias("hits"))).alias("l")
    return queue.groupBy(F.col("novelty_fingerprint").alias("fingerprint")).agg(last).select("fingerprint", "l.at", "l.hits")


def continue_runs(
    queue: DataFrame, path: str, batch_id: int, gap_days: int = C.FINGERPRINT_GAP_DAYS, escalate_at: int = C.ESCALATION_OCCURRENCES
) -> DataFrame:
    """Occurrences counted on from earlier batches.

    ``path`` has the last hit of each fingerprint per batch.  Hits of the batch's first
    run, that is before its first gap, continue the stored run if it is near enough.  A
    batch that is run again reads only the batches before it.
    """
    stored = left_by_batches(queue.sparkSession, path, batch_id)
    if stored is None:
        return queue
    newest = stored.groupBy(F.col("fingerprint").alias("novelty_fingerprint")).agg(F.max(F.struct("at", "hits")).alias("before"))
    order = Window.partitionBy("novelty_fingerprint").orderBy("created_at", "fingerprint_occurrences")
    # Occurrences start again at one after a gap.
    starts = F.sum((F.col("fingerprint_occurrences") == 1).cast("int")).over(order)
    first = F.min("created_at").over(Window.partitionBy("novelty_fingerprint"))
    joined = queue.withColumn("__run", starts).withColumn("__first", first).join(newest, "novelty_fingerprint", "left")
    near = micros("__first") - micros(F.col("before.at")) < gap_days * 86_400 * 1_000_000
    counted = F.col("fingerprint_occurrences") + F.when((F.col("__run") <= 1) & near, F.col("before.hits")).otherwise(0)
    out = joined.withColumn("fingerprint_occurrences", counted).withColumn(
        "requires_escalation", F.col("fingerprint_occurrences") >= escalate_at
    )
    return out.select(*queue.columns)
