"""Payment context as one plan: what is known about a payment when it is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.rules import vpa_age_days
from ledgerscope.operators import context as X
from ledgerscope.operators.profile import festival_history


def payment_context(
    txn: DataFrame,
    accounts: DataFrame,
    as_of: Column,
    include_current: bool = False,
) -> DataFrame:
    """Sliding measures first (one shuffle by account), then lookups by id.

    Account and payee lookups have one row per id on the small side; AQE splits
    the payments side when an account is hot.
    """
    timed = X.point_in_time(txn, include_current)
    known = X.with_known_contact(timed, include_current, history=txn)
    sender = X.with_account_context(known, accounts)
    payee = X.with_payee_age(sender, accounts)
    gifts = festival_history(txn, as_of).select(
        F.col("account_id").alias("__g"), "has_festival_gifting_history"
    )
    joined = payee.join(gifts, payee["account_id"] == gifts["__g"], "left").drop("__g")
    return joined.withColumn(
        "has_festival_gifting_history", F.coalesce("has_festival_gifting_history", F.lit(False))
    ).withColumn("payee_vpa_age_days", vpa_age_days(F.col("ts"), F.col("payee_vpa_created_at")))
