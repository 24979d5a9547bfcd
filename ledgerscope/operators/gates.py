"""Hard pattern gates: one table per gate, ``(key, fired, gate, evidence)``; the first that fires wins.

Gate tables are computed once per account or terminal and joined to payments, so
missing inputs leave a gate silent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.functions.rules import occupation_in
from ledgerscope.operators.profile import days_since, degrees, inflow_retention, sink_scores, window_flows
from ledgerscope.scale import top_per_key


def _gate(df: DataFrame, key: str, test: Column, name: Column | str, evidence: list) -> DataFrame:
    label = F.lit(name) if isinstance(name, str) else name
    fired = F.coalesce(test, F.lit(False))
    return df.select(
        F.col(key),
        fired.alias("fired"),
        F.when(fired, label).alias("gate"),
        F.struct(*evidence).alias("evidence"),
    )


def rapid_relay(edges: DataFrame, as_of: Column, live: bool = False) -> DataFrame:
    """Most of what came in went out again within the hour, to several receivers.

    When under 5000 came in during the hour, the six-hour sums are used.  While the
    gate is a pilot (``live=False``) it detects but never fires.
    """
    flows = window_flows(edges, as_of)
    at = F.col("ts").cast("timestamp")
    recent = edges.filter((at > as_of - F.expr("INTERVAL 1 HOUR")) & (at <= as_of))
    sent = recent.groupBy(F.col("src").alias("account_id")).agg(F.count(F.lit(1)).alias("outgoing"))
    joined = flows.join(sent, "account_id", "left")
    cold = F.col("inflow_1h") < C.RELAY_MIN_INFLOW
    joined = joined.select(
        "account_id",
        F.when(cold, F.col("inflow_6h")).otherwise(F.col("inflow_1h")).alias("inflow"),
        F.when(cold, F.col("outflow_6h")).otherwise(F.col("outflow_1h")).alias("outflow"),
        F.coalesce("outgoing", F.lit(0)).alias("outgoing_txn_count_1h"),
    )
    ratio = F.when(F.col("inflow") > 0, F.col("outflow") / F.col("inflow"))
    joined = joined.withColumn("conservation_ratio", ratio)
    detected = (
        (F.col("inflow") >= C.RELAY_MIN_INFLOW)
        & (F.col("conservation_ratio") >= C.RELAY_CONSERVATION)
        & (F.col("outgoing_txn_count_1h") >= C.RELAY_MIN_OUTGOING)
    )
    out = _gate(
        joined,
        "account_id",
        detected & F.lit(live),
        "rapid_relay",
        ["inflow", "outflow", "conservation_ratio", "outgoing_txn_count_1h"],
    )
    return out.join(
        joined.select("account_id", F.coalesce(detected, F.lit(False)).alias("detected")), "account_id"
    )


def relay_pilot_report(edges: DataFrame, as_of: Column) -> DataFrame:
    """What the relay gate would fire on if it were live."""
    return rapid_relay(edges, as_of, live=False).filter("detected").select("account_id", "evidence.*")


def cycle_legitimacy(
    cycles: DataFrame, accounts: DataFrame, relations: DataFrame, strict_self: bool = False
) -> DataFrame:
    """Why a cycle is innocent, or null: the first matching filter in fixed order.

    internal_transfer, known_relationship, salary_advance_return,
    merchant_settlement_cycle, fee_or_partial_repayment.  A cycle ends where it
    starts, so the relationship filter compares the origin with every other
    account on it; ``strict_self`` compares the origin with itself.
    """
    info = accounts.select(
        F.col("id").alias("__id"), "account_type", "kyc_occupation", "is_merchant",
        "kyc_completeness_score", "account_age_days",
    )
    rows = cycles.withColumn("cycle_key", F.xxhash64("start", "edge_ids"))
    members = rows.select("cycle_key", "start", F.explode(F.array_distinct("nodes")).alias("node"))
    detailed = members.join(info, members["node"] == info["__id"], "left")
    shell = (F.coalesce("kyc_completeness_score", F.lit(0.0)) < 0.30) | (
        F.coalesce("account_age_days", F.lit(0)) < 90
    )
    merchants = detailed.filter(F.col("__id").isNotNull()).groupBy("cycle_key").agg(
        F.min(F.coalesce("is_merchant", F.lit(False))).alias("all_merchants"),
        F.max(shell).alias("has_shell"),
    )
    pairs = members.select("cycle_key", F.col("start").alias("a"), F.col("node").alias("b"))
    pairs = pairs.filter("a = b") if strict_self else pairs.filter("a != b")
    declared = relations.select(
        F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")
    ).distinct()
    related = (
        pairs.join(
            declared,
            (F.least("a", "b") == F.col("__lo")) & (F.greatest("a", "b") == F.col("__hi")),
            "left_semi",
        )
        .select("cycle_key")
        .distinct()
        .withColumn("related", F.lit(True))
    )
    origin = info.select(
        F.col("__id").alias("start"),
        F.coalesce("account_type", F.lit("SAVINGS")).alias("__type"),
        F.col("kyc_occupation").alias("__occupation"),
    )
    joined = (
        rows.join(origin, "start", "left").join(merchants, "cycle_key", "left").join(related, "cycle_key", "left")
    )
    entry, exit_ = F.element_at("amounts", 1), F.element_at("amounts", -1)
    begun, ended = F.element_at("times", 1), F.element_at("times", -1)
    days = F.abs(
        F.floor(
            (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(begun.cast("timestamp")))
            / 86_400_000_000.0
        )
    )
    joined = (
        joined.withColumn("entry_amount", entry)
        .withColumn("exit_amount", exit_)
        .withColumn("cycle_duration_days", days)
    )
    reason = F.coalesce(
        F.when(F.col("__type").isin(C.INTERNAL_ACCOUNT_TYPES), "internal_transfer"),
        F.when(F.col("related"), "known_relationship"),
        F.when(
            occupation_in(F.col("__occupation"), C.PAYROLL_OCCUPATIONS)
            & (F.col("cycle_duration_days") <= 30)
            & (F.col("exit_amount") <= F.col("entry_amount")),
            "salary_advance_return",
        ),
        F.when(F.col("all_merchants") & ~F.col("has_shell"), "merchant_settlement_cycle"),
        F.when(
            (F.col("entry_amount") > 0)
            & (F.col("exit_amount") / F.col("entry_amount") < C.LEGIT_RETURN_RATIO),
            "fee_or_partial_repayment",
        ),
    )
    return joined.withColumn("reason", reason).drop(
        "__type", "__occupation", "all_merchants", "has_shell", "related", "cycle_key"
    )


def confirmed_cycle(judged: DataFrame) -> DataFrame:
    """Accounts with a cycle no filter explains; evidence is the first such cycle."""
    open_cycles = judged.filter(F.col("reason").isNull())
    first = top_per_key(open_cycles, ["start"], [F.asc("hops"), F.asc("edge_ids")], 1)
    return _gate(
        first.withColumnRenamed("start", "account_id"),
        "account_id",
        F.lit(True),
        "confirmed_cycle",
        ["hops", "nodes", "amounts", "entry_amount", "exit_amount", "cycle_duration_days"],
    )


def sink_features(edges: DataFrame, as_of: Column, long_days: int = 90) -> DataFrame:
    """Columns both sink gates read.

    The two-path gate wants accounts silent for over 30 days, whose 30-day inflow
    is zero, so it reads the retention over the longer window.
    """
    rows = sink_scores(degrees(edges)).select("account_id", "sink_score")
    longer = inflow_retention(edges, as_of, long_days).select(
        "account_id", F.col("retention_ratio").alias("retention_ratio_long")
    )
    for part in (
        days_since(edges, as_of, "receive"),
        days_since(edges, as_of, "send"),
        inflow_retention(edges, as_of),
        longer,
    ):
        rows = rows.join(part, "account_id", "full")
    # An account without transfers in a window moved nothing in it.
    return rows.fillna(
        0.0, ["inflow_last_30d", "outflow_last_30d", "retention_ratio", "retention_ratio_long"]
    )


def abandoned_sink_two_path(features: DataFrame) -> DataFrame:
    """Silent on both sides for over 30 days with the money kept."""
    test = (
        (F.col("days_since_last_receive") > 30)
        & (F.col("days_since_last_send") > 30)
        & (F.col("sink_score") > 0.5)
        & (F.col("retention_ratio_long") > 0.60)
    )
    return _gate(
        features,
        "account_id",
        test,
        "abandoned_sink_d01",
        ["days_since_last_receive", "sink_score", "retention_ratio_long"],
    )


def abandoned_sink(features: DataFrame, accounts: DataFrame) -> DataFrame:
    """Young account, large inflow kept, no send for 30 days, retention not expected of its kind."""
    info = accounts.select(
        F.col("id").alias("account_id"), "account_age_days", "account_type", "kyc_occupation"
    )
    joined = features.join(info, "account_id")
    exempt = F.coalesce(F.col("account_type").isin(C.SINK_EXEMPT_TYPES), F.lit(False)) | occupation_in(
        F.col("kyc_occupation"), C.MERCHANT_OCCUPATIONS
    )
    test = (
        (F.col("inflow_last_30d") > 50_000)
        & (F.col("retention_ratio") > 0.80)
        & (F.col("days_since_last_send") > 30)
        & (F.col("account_age_days") < 180)
        & ~exempt
    )
    return _gate(
        joined,
        "account_id",
        test,
        "abandoned_sink",
        ["inflow_last_30d", "retention_ratio", "days_since_last_send", "account_age_days"],
    )


def bipartite_core(edges: DataFrame, accounts: DataFrame, merchant_density: float = 0.85) -> DataFrame:
    """Receivers of at least five distinct senders with transfers per sender above 0.7."""
    pairs = edges.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.groupBy("dst").agg(
        F.count(F.lit(1)).alias("sender_count"), F.sum("n").alias("edge_count")
    )
    # The ten smallest sender ids, limited before they are brought together.
    few = top_per_key(pairs.select("dst", "src"), ["dst"], [F.asc("src")], 10)
    listed = few.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("sender_ids"))
    info = accounts.select(F.col("id").alias("dst"), "kyc_occupation", "is_merchant")
    joined = counted.join(listed, "dst").join(info, "dst", "left")
    joined = joined.withColumn("density", F.col("edge_count") / F.col("sender_count"))
    legit = occupation_in(F.col("kyc_occupation"), C.LEGIT_AGGREGATOR_OCCUPATIONS)
    spread = F.coalesce(F.col("is_merchant") & (F.col("density") < merchant_density), F.lit(False))
    test = (F.col("sender_count") >= 5) & (F.col("density") > 0.7) & ~legit & ~spread
    return _gate(
        joined.withColumnRenamed("dst", "account_id"),
        "account_id",
        test,
        "bipartite_core",
        ["sender_count", "density", F.col("density").alias("edges_per_sender"), "sender_ids"],
    )


def cash_mule_sink(txn: DataFrame, accounts: DataFrame, as_of: Column) -> DataFrame:
    """Young account: large inflow, taken out in cash, then digital silence."""
    at = F.col("ts").cast("timestamp")

    def since(text):
        return (at > as_of - F.expr(f"INTERVAL {text}")) & (at <= as_of)

    inflow = (
        txn.filter(since("7 DAYS") & F.col("payee_account_id").isNotNull())
        .groupBy(F.col("payee_account_id").alias("account_id"))
        .agg(F.sum("amount").alias("inflow_7d"))
    )
    atm = F.col("channel") == "ATM"
    cash = txn.filter(atm).groupBy("account_id").agg(
        F.coalesce(F.sum(F.when(since("48 HOURS"), F.col("amount"))), F.lit(0.0)).alias("cash_withdrawn_48h"),
        F.max("ts").alias("__last_atm"),
    )
    # The newest cash withdrawal of each account, joined to its other payments.
    last = cash.select(F.col("account_id").alias("__a"), "__last_atm")
    digital = txn.filter(~atm)
    after = (
        digital.join(last, (digital["account_id"] == last["__a"]) & (digital["ts"] > last["__last_atm"]))
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("__after"))
    )
    info = accounts.select(
        F.col("id").alias("account_id"), "account_age_days", "account_type", "kyc_occupation"
    )
    joined = (
        inflow.join(info, "account_id").join(cash, "account_id", "left").join(after, "account_id", "left")
    )
    joined = (
        joined.withColumn("cash_withdrawn_48h", F.coalesce("cash_withdrawn_48h", F.lit(0.0)))
        .withColumn("digital_sends_after_withdrawal", F.coalesce("__after", F.lit(0)))
        .withColumn(
            "cash_ratio", F.when(F.col("inflow_7d") > 0, F.col("cash_withdrawn_48h") / F.col("inflow_7d"))
        )
    )
    exempt = F.coalesce(F.col("account_type").isin(C.CASH_EXEMPT_TYPES), F.lit(False)) | occupation_in(
        F.col("kyc_occupation"), C.CASH_EXEMPT_OCCUPATIONS
    )
    test = (
        (F.col("account_age_days") <= 180)
        & (F.col("inflow_7d") >= 50_000)
        & (F.col("cash_ratio") >= 0.80)
        & (F.col("digital_sends_after_withdrawal") <= 2)
        & ~exempt
    )
    return _gate(
        joined,
        "account_id",
        test,
        "cash_mule_sink",
        [
            "account_age_days",
            "inflow_7d",
            "cash_withdrawn_48h",
            "cash_ratio",
            "digital_sends_after_withdrawal",
        ],
    )


def merchant_terminal(txn: DataFrame, as_of: Column, min_receipts: int = 5, min_oversized: int = 3) -> DataFrame:
    """Terminals with uniform receipts, receipts too large for their category, or a sudden rush."""
    at = F.col("ts").cast("timestamp")
    used = txn.filter(F.col("merchant_terminal_id").isNotNull())
    month = used.filter((at > as_of - F.expr("INTERVAL 30 DAYS")) & (at <= as_of))
    # Any one category of the terminal is looked up; the smallest makes it repeatable.
    kind = used.groupBy("merchant_terminal_id").agg(F.min("merchant_mcc").alias("mcc"))
    today = month.filter(at > as_of - F.expr("INTERVAL 24 HOURS"))
    mean = today.groupBy("merchant_terminal_id").agg(
        F.count(F.lit(1)).alias("receipt_count_24h"), F.avg("amount").alias("mean_amount")
    )
    daily = (
        month.groupBy("merchant_terminal_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("merchant_terminal_id")
        .agg(F.avg("c").alias("normal_daily_avg"))
    )
    limits = F.create_map(*[F.lit(x) for pair in C.MCC_EXPECTED_MAX.items() for x in pair])
    terminals = (
        mean.join(kind, "merchant_terminal_id")
        .join(daily, "merchant_terminal_id")
        .withColumn(
            "expected_max_amount",
            F.coalesce(F.try_element_at(limits, F.col("mcc")), F.lit(C.DEFAULT_EXPECTED_MAX)),
        )
    )
    # One row per terminal on the small side: a busy terminal is not gathered.
    spread = (
        today.select("merchant_terminal_id", "amount")
        .join(terminals.select("merchant_terminal_id", "mean_amount", "expected_max_amount"), "merchant_terminal_id")
        .groupBy("merchant_terminal_id")
        .agg(
            F.sum(F.abs(F.col("amount") - F.col("mean_amount"))).alias("__dev"),
            F.count(F.when(F.col("amount") > F.col("expected_max_amount") * 3, 1)).alias("oversized_count"),
        )
    )
    joined = terminals.join(spread, "merchant_terminal_id")
    joined = joined.withColumn(
        "uniformity_score",
        F.when(F.col("mean_amount") > 0, F.col("__dev") / (F.col("mean_amount") * F.col("receipt_count_24h"))),
    ).withColumn(
        "velocity_ratio",
        F.when(F.col("normal_daily_avg") > 0, F.col("receipt_count_24h") / F.col("normal_daily_avg")),
    )
    name = (
        F.when(
            (F.col("receipt_count_24h") >= min_receipts) & (F.col("uniformity_score") < 0.05),
            "merchant_terminal_amount_uniformity",
        )
        .when(F.col("oversized_count") >= min_oversized, "merchant_terminal_mcc_mismatch")
        .when(F.col("velocity_ratio") > 50.0, "merchant_terminal_velocity_spike")
    )
    return _gate(
        joined.withColumn("__name", name),
        "merchant_terminal_id",
        F.col("__name").isNotNull(),
        F.col("__name"),
        [
            "mcc",
            "receipt_count_24h",
            "mean_amount",
            "uniformity_score",
            "expected_max_amount",
            "oversized_count",
            "normal_daily_avg",
            "velocity_ratio",
        ],
    )


# ── Priority ────────────────────────────────────────────────────────────────

GateJob = Callable[..., DataFrame]
_EXTRA: list[tuple[int, str, GateJob]] = []


def register_gate(name: str, priority: int, job: GateJob) -> None:
    """Add a gate: ``job(**tables)`` returns ``(account_id, fired, gate)``.

    Built-in gates have priorities 0, 10, 20, ...; lower runs first.
    """
    _EXTRA[:] = [g for g in _EXTRA if g[1] != name] + [(priority, name, job)]


def run_gates(
    txn: DataFrame,
    account_gates: list[DataFrame],
    terminal_gate: DataFrame | None = None,
    extra_tables: dict | None = None,
) -> DataFrame:
    """First fired gate of every payment, in the order given; the terminal gate is last."""
    ranked = [(10 * i, df) for i, df in enumerate(account_gates)]
    ranked += [(priority, job(**(extra_tables or {}))) for priority, _, job in _EXTRA]
    fired = None
    for priority, table in ranked:
        hits = table.filter("fired").select(
            F.col("account_id").alias("__key"),
            F.lit(priority).alias("__priority"),
            "gate",
            F.to_json("evidence").alias("evidence") if "evidence" in table.columns else F.lit(None).cast("string").alias("evidence"),
        )
        fired = hits if fired is None else fired.unionByName(hits)
    # One small table of fired accounts: the best gate of each, joined once.
    best = fired.groupBy("__key").agg(F.min(F.struct("__priority", "gate", "evidence")).alias("__best"))
    out = txn.join(best, txn["account_id"] == best["__key"], "left").drop("__key")
    gate, evidence = F.col("__best.gate"), F.col("__best.evidence")
    if terminal_gate is not None:
        terminal = terminal_gate.filter("fired").select(
            F.col("merchant_terminal_id").alias("__terminal"),
            F.col("gate").alias("__tgate"),
            F.to_json("evidence").alias("__tevidence"),
        )
        terminal = terminal.filter(F.col("__terminal").isNotNull())
        # Payments without a terminal match nothing; their own ids keep them from meeting in one task.
        used, kind = F.col("merchant_terminal_id"), out.schema["merchant_terminal_id"].dataType
        own = [F.when(used.isNull(), F.col(c)) for c in ("transaction_id", "ts") if c in out.columns]
        out = out.withColumn("__spread", F.xxhash64(used, *own))
        terminal = terminal.withColumn("__tspread", F.xxhash64(F.col("__terminal").cast(kind)))
        same = (out["merchant_terminal_id"] == terminal["__terminal"]) & (out["__spread"] == terminal["__tspread"])
        out = out.join(terminal, same, "left")
        evidence = F.when(gate.isNotNull(), evidence).otherwise(F.col("__tevidence"))
        gate = F.coalesce(gate, F.col("__tgate"))
    return (
        out.withColumn("gate_fired", gate)
        .withColumn("gate_evidence", evidence)
        .drop("__best", "__terminal", "__tgate", "__tevidence", "__spread", "__tspread")
    )
