"""Review queues: filtered, ordered pages and account sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def novelty_queue(
    df: DataFrame, status: str = "PENDING_REVIEW", escalation_only: bool = False, limit: int = 50
) -> DataFrame:
    """Escalated rows first, then newest; ties by transaction id."""
    chosen = df.filter(F.col("status") == status)
    if escalation_only:
        chosen = chosen.filter("requires_escalation")
    return chosen.orderBy(
        F.desc("requires_escalation"), F.desc("created_at"), F.asc("transaction_id")
    ).limit(min(limit, 200))


def candidate_page(
    df: DataFrame, status: str = "PENDING_REVIEW", page: int = 1, per_page: int = 20
) -> DataFrame:
    """One page, oldest first, each row with ``total`` and ``has_more``."""
    size = min(per_page, 100)
    skip = (page - 1) * size
    chosen = df.filter(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        chosen.orderBy(F.asc("submitted_at"), F.asc("transaction_id"))
        .offset(skip)
        .limit(size)
        .withColumn("total", total)
        .withColumn("has_more", F.lit(skip + size) < F.col("total"))
    )


def recent_shadow(shadow: DataFrame, n: int) -> DataFrame:
    return shadow.orderBy(F.desc("scored_at"), F.asc("transaction_id")).limit(n)


def recently_active(edges: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Senders and receivers of the last ``minutes``."""
    start = (as_of - F.expr(f"INTERVAL {minutes} MINUTES")).cast(edges.schema["ts"].dataType)
    return touched_accounts(edges.filter(F.col("ts") > start))


def touched_accounts(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.col("src").alias("account_id")).union(edges.select("dst")).distinct()
    )
