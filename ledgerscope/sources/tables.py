"""Readers, ingest checks and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope import constants as C
from ledgerscope.functions.rules import vpa_age_days

ACCOUNTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("kyc_occupation", T.StringType()),
        T.StructField("kyc_declared_income_monthly", T.DecimalType(15, 2)),
        T.StructField("kyc_age", T.IntegerType()),
        T.StructField("kyc_home_state", T.StringType()),
        T.StructField("kyc_completeness_score", T.DoubleType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("is_merchant", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
TRANSACTIONS_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("payee_account_id", T.StringType()),
        T.StructField("amount", T.DecimalType(15, 2)),
        T.StructField("channel", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("payee_vpa", T.StringType()),
        T.StructField("payee_vpa_created_at", T.TimestampType()),
        T.StructField("merchant_terminal_id", T.StringType()),
        T.StructField("merchant_mcc", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("geo_city", T.StringType()),
        T.StructField("geo_state", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def read_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Accounts and transactions with their declared schemas (no inference pass)."""
    return (
        spark.read.schema(ACCOUNTS_SCHEMA).parquet(f"{directory}/accounts"),
        spark.read.schema(TRANSACTIONS_SCHEMA).parquet(f"{directory}/transactions"),
    )


def rejection_reasons(as_of: Column, channels: list[str] | None = None) -> Column:
    """Array of the ingest rules a row breaks; empty when the row is valid."""
    identifier = F.col("transaction_id").cast("string")
    amount = F.col("amount")
    ahead = F.col("ts").cast("timestamp") > as_of + F.expr(
        f"INTERVAL {C.FUTURE_TOLERANCE_MINUTES} MINUTES"
    )
    account = F.col("account_id").cast("string")
    rules = [
        (
            F.coalesce(identifier.rlike(C.ID_PATTERN) & (F.length(identifier) <= 36), F.lit(False)),
            "transaction_id",
        ),
        (F.coalesce(F.length(account).between(1, 20), F.lit(False)), "account_id"),
        (
            F.coalesce(F.length(F.col("payee_account_id").cast("string")) <= 20, F.lit(True)),
            "payee_account_id",
        ),
        (F.coalesce((amount > 0) & (amount < C.MAX_AMOUNT), F.lit(False)), "amount_range"),
        (F.coalesce(amount == F.round(amount, 2), F.lit(False)), "amount_precision"),
        (
            F.coalesce(F.col("channel").isin(channels or C.REQUEST_CHANNELS), F.lit(False)),
            "channel",
        ),
        (F.coalesce(~ahead, F.lit(False)), "timestamp"),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for ok, name in rules]))


def validate_transactions(
    df: DataFrame, as_of: Column, channels: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the ``reasons`` they broke."""
    checked = df.withColumn("reasons", rejection_reasons(as_of, channels))
    return (
        checked.filter(F.size("reasons") == 0).drop("reasons"),
        checked.filter(F.size("reasons") > 0),
    )


def upsert_transactions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows plus new ids.  Of several new rows with one id the earliest stays."""
    columns = [c for c in new.columns if c != "transaction_id"]
    first = new.groupBy("transaction_id").agg(
        F.min(F.struct("ts", *[c for c in columns if c != "ts"])).alias("__row")
    )
    first = first.select("transaction_id", *[F.col(f"__row.{c}").alias(c) for c in columns])
    unseen = first.join(existing.select("transaction_id"), "transaction_id", "left_anti")
    return existing.unionByName(unseen.select(*existing.columns))


def missing_accounts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Default account rows for senders and payees the account table does not know."""
    seen = (
        transactions.select(F.col("account_id").alias("id"))
        .union(transactions.select("payee_account_id"))
        .filter(F.col("id").isNotNull())
        .distinct()
    )
    return seen.join(accounts.select("id"), "id", "left_anti").select(
        "id",
        F.lit("SAVINGS").alias("account_type"),
        F.lit(0.5).alias("kyc_completeness_score"),
        F.lit(0).alias("account_age_days"),
    )


def edges(transactions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Transfers inside the window; a null channel reads as UPI."""
    start = as_of - F.expr(f"INTERVAL {days} DAYS")
    return transactions.filter(
        F.col("payee_account_id").isNotNull() & (F.col("ts").cast("timestamp") > start)
    ).select(
        F.col("account_id").alias("src"),
        F.col("payee_account_id").alias("dst"),
        F.col("amount").cast("double").alias("amount"),
        "ts",
        F.coalesce("channel", F.lit("UPI")).alias("channel"),
        "transaction_id",
    )


def vertices(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "id",
        F.coalesce("account_type", F.lit("SAVINGS")).alias("account_type"),
        "kyc_occupation",
        "kyc_age",
        F.coalesce("account_age_days", F.lit(0)).alias("account_age_days"),
        F.coalesce("kyc_completeness_score", F.lit(0.0)).alias("kyc_completeness_score"),
        F.coalesce("is_merchant", F.lit(False)).alias("is_merchant"),
    )


def device_edges(transactions: DataFrame) -> DataFrame:
    known = F.col("device_id").isNotNull() & (F.col("device_id").cast("string") != "")
    return (
        transactions.filter(known)
        .groupBy("account_id", "device_id")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )


def vpa_edges(transactions: DataFrame, as_of: Column) -> DataFrame:
    known = F.col("payee_vpa").isNotNull() & (F.col("payee_vpa").cast("string") != "")
    return (
        transactions.filter(known)
        .select("account_id", "payee_vpa", "payee_vpa_created_at")
        .distinct()
        .withColumn("age_days", F.coalesce(vpa_age_days(as_of, F.col("payee_vpa_created_at")), F.lit(0)))
    )


def _require(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_labelled_csv(
    spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None
) -> DataFrame:
    """CSV with a header and a declared schema; fails when the header lacks a required column."""
    header = spark.read.option("header", True).csv(path)
    _require(header, required or schema.fieldNames())
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_transactions_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Transactions from JSON lines, or from documents holding a ``transactions`` array."""
    wrapped = T.StructType(
        [*schema.fields, T.StructField("transactions", T.ArrayType(schema))]
    )
    raw = spark.read.option("multiLine", False).schema(wrapped).json(path)
    row = F.struct(*schema.fieldNames())
    return raw.select(
        F.explode(F.coalesce("transactions", F.array(row))).alias("t")
    ).select("t.*")


def merge_labelled_sets(
    base: DataFrame, others: dict[str, DataFrame], label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Append the sets whose feature columns equal the base's; report what was done.

    The report has one row per set: appended or skipped, rows, positives.
    """
    expected = set(base.columns)
    merged = base
    report = None
    for name, frame in others.items():
        fits = set(frame.columns) == expected
        if fits:
            merged = merged.unionByName(frame)
        counted = frame.agg(
            F.lit(name).alias("set_name"),
            F.lit(fits).alias("appended"),
            F.count(F.lit(1)).alias("row_count"),
            (F.sum(F.col(label).cast("long")) if label in frame.columns else F.lit(None).cast("long")).alias(
                "positives"
            ),
        )
        report = counted if report is None else report.unionByName(counted)
    return merged, report


def stream_transactions(
    spark: SparkSession, directory: str, schema: T.StructType = TRANSACTIONS_SCHEMA
) -> DataFrame:
    """Transactions as they land in a directory of Parquet files."""
    return spark.readStream.schema(schema).parquet(directory)
