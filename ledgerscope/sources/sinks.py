"""Writers: append-only logs, feature tables with an expiry, replaceable lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp_account_features(df: DataFrame, computed_at: Column, key: str = "account_id") -> DataFrame:
    """Feature rows with at least one value, stamped with their computation time."""
    values = [c for c in df.columns if c != key]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in values])
    return df.filter(F.col(key).isNotNull() & some).withColumn("computed_at", computed_at)


def write_account_features(df: DataFrame, path: str, computed_at: Column) -> None:
    stamp_account_features(df, computed_at).write.mode("overwrite").parquet(path)


def fresh_features(df: DataFrame, as_of: Column, hours: int = 26) -> DataFrame:
    """Feature rows still valid at ``as_of``."""
    return df.filter(F.col("computed_at").cast("timestamp") > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def read_account_features(spark: SparkSession, path: str, as_of: Column, hours: int = 26) -> DataFrame:
    return fresh_features(spark.read.parquet(path), as_of, hours)


def patch_features(base: DataFrame, patch: DataFrame, columns: list[str], key: str = "account_id") -> DataFrame:
    """Overwrite ``columns`` where the patch has a value; keys only in the patch are ignored."""
    renamed = patch.select(F.col(key), *[F.col(c).alias(f"__patch_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[
            F.coalesce(f"__patch_{c}", c).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def append_scores(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_shadow(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_rows(df: DataFrame, event_type: str, model_version: str, payload: list[str]) -> DataFrame:
    """Audit events: one row per input row with the payload columns as JSON."""
    return df.select(
        F.lit(event_type).alias("event_type"),
        "transaction_id",
        F.lit(model_version).alias("model_version"),
        F.to_json(F.struct(*payload)).alias("event_data"),
        F.col("event_timestamp"),
    )


def replace_list(spark: SparkSession, path: str, df: DataFrame) -> str:
    """Swap a whole reference list; an empty input leaves the old list in place.

    The new list is written beside the old ones under a name nobody else has, and one
    pointer row then puts it in force: a reader sees one whole list or another, and two
    writers at once cannot mix theirs; the later pointer row wins (ties: the larger name).
    """
    if not df.take(1):
        raise ValueError("refusing to replace a list by an empty one")
    name = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/versions/{name}")
    pointer = spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/current")
    return name


def list_version(spark: SparkSession, path: str) -> str | None:
    """Name of the list in force, or None before the first write."""
    try:
        pointers = spark.read.schema("name string, at timestamp").parquet(f"{path}/current")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = pointers.agg(F.max(F.struct("at", "name")).alias("last")).first()["last"]
    return last["name"] if last else None


def read_list(spark: SparkSession, path: str) -> DataFrame:
    name = list_version(spark, path)
    if name is None:
        raise ValueError(f"no list was written to {path}")
    return spark.read.parquet(f"{path}/versions/{name}")
