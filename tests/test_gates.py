"""Each gate on a fixture that fires it, one that just misses, and its exemptions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import gates as G

NOW = dt.datetime(2024, 3, 1)
H, D = dt.timedelta(hours=1), dt.timedelta(days=1)
EDGE = "src string, dst string, amount double, ts timestamp, channel string, transaction_id long"
ACCT = (
    "id string, account_type string, kyc_occupation string, is_merchant boolean, "
    "kyc_completeness_score double, account_age_days int"
)


@pytest.fixture
def as_of(spark):
    return F.lit(NOW)


@pytest.fixture
def edges(frame):
    return lambda rows: frame([(s, d, float(a), t, "UPI", i) for i, (s, d, a, t) in enumerate(rows)], EDGE)


def accounts(frame, **over):
    base = {"account_type": "SAVINGS", "kyc_occupation": None, "is_merchant": False, "kyc_completeness_score": 0.9, "account_age_days": 100}
    rows = []
    for name in over:
        v = {**base, **over[name]}
        rows.append((name, v["account_type"], v["kyc_occupation"], v["is_merchant"], v["kyc_completeness_score"], v["account_age_days"]))
    return frame(rows, ACCT)


def fired(df, key="account_id"):
    return {r[key] for r in df.filter("fired").collect()}


def test_relay_fires_only_when_live(edges, as_of):
    rows = [("x", "r", 6000, NOW - H / 2)] + [("r", f"y{i}", 1700, NOW - H / 4) for i in range(3)]
    e = edges(rows)
    assert fired(G.rapid_relay(e, as_of, live=True)) == {"r"}
    assert fired(G.rapid_relay(e, as_of)) == set()
    assert [r["account_id"] for r in G.relay_pilot_report(e, as_of).collect()] == ["r"]
    assert fired(G.rapid_relay(edges(rows[:3]), as_of, live=True)) == set()


def test_relay_falls_back_to_six_hours(edges, as_of):
    rows = [("x", "r", 9000, NOW - 5 * H)] + [("r", f"y{i}", 2600, NOW - H / 4) for i in range(3)]
    row = G.rapid_relay(edges(rows), as_of, live=True).filter("account_id = 'r'").first()
    assert row["fired"] and row["evidence"]["inflow"] == 9000


def test_two_path_sink_needs_both_silences(edges, as_of):
    rows = [("a", "s", 5000, NOW - 40 * D), ("b", "s", 5000, NOW - 41 * D), ("s", "c", 100, NOW - 50 * D)]
    assert fired(G.abandoned_sink_two_path(G.sink_features(edges(rows), as_of))) == {"s"}
    never_sent = G.sink_features(edges(rows[:2]), as_of)
    assert fired(G.abandoned_sink_two_path(never_sent)) == set()


def test_abandoned_sink_and_exemptions(frame, edges, as_of):
    rows = []
    for name in ("plain", "dhan", "shop", "old"):
        rows += [("a", name, 60_000, NOW - 5 * D), (name, "z", 10, NOW - 40 * D)]
    accts = accounts(frame, plain={}, dhan={"account_type": "JAN_DHAN"}, shop={"kyc_occupation": "Retailer"}, old={"account_age_days": 180})
    assert fired(G.abandoned_sink(G.sink_features(edges(rows), as_of), accts)) == {"plain"}


def test_bipartite_core_counts_senders(frame, edges):
    rows = [(f"s{i}", "hub", 10, NOW - D) for i in range(12)] + [(f"s{i}", "few", 10, NOW - D) for i in range(4)]
    rows += [(f"s{i}", "tax", 10, NOW - D) for i in range(6)]
    gate = G.bipartite_core(edges(rows), accounts(frame, hub={}, few={}, tax={"kyc_occupation": "tax_collector"}))
    assert fired(gate) == {"hub"}
    ev = gate.filter("account_id = 'hub'").first()["evidence"]
    assert ev["sender_count"] == 12 and len(ev["sender_ids"]) == 10 and ev["sender_ids"] == sorted(ev["sender_ids"])


def _cash(frame, sends_after=0, cash=45_000.0):
    rows = [(0, "x", "m", 50_000.0, "UPI", NOW - 3 * D), (1, "m", "atm", cash, "ATM", NOW - 20 * H), (2, "m", "y", 1.0, "UPI", NOW - 30 * H)]
    rows += [(10 + i, "m", "y", 1.0, "UPI", NOW - 10 * H) for i in range(sends_after)]
    return frame(rows, "transaction_id long, account_id string, payee_account_id string, amount double, channel string, ts timestamp")


def test_cash_mule_sink(frame, as_of):
    young = accounts(frame, m={})
    assert fired(G.cash_mule_sink(_cash(frame), young, as_of)) == {"m"}
    assert fired(G.cash_mule_sink(_cash(frame, 2), young, as_of)) == {"m"}
    assert fired(G.cash_mule_sink(_cash(frame, 3), young, as_of)) == set()
    assert fired(G.cash_mule_sink(_cash(frame, 0, 39_000.0), young, as_of)) == set()
    for exempt in ({"account_type": "JAN_DHAN"}, {"kyc_occupation": "daily_wage"}, {"account_age_days": 181}):
        assert fired(G.cash_mule_sink(_cash(frame), accounts(frame, m=exempt), as_of)) == set()


def test_merchant_terminal_patterns(frame, as_of):
    rows, i = [], 0
    for k in range(5):
        rows.append((i + k, "u", "5411", 100.0 + k * 0.1, NOW - H))
    rows += [(100 + k, "o", "5812", 9_001.0 + 500 * k, NOW - H) for k in range(3)]
    rows += [(1000 + k, "v", "9999", 10.0 * (k % 7 + 1), NOW - H) for k in range(120)]
    rows += [(5000 + k, "v", "9999", 5.0, NOW - (k + 2) * D) for k in range(25)]
    rows += [(9000, "q", "5411", 50.0, NOW - H)]
    df = frame(rows, "transaction_id long, merchant_terminal_id string, merchant_mcc string, amount double, ts timestamp")
    gates = {r["merchant_terminal_id"]: r["gate"] for r in G.merchant_terminal(df, as_of).collect()}
    assert gates["u"] == "merchant_terminal_amount_uniformity"
    assert gates["o"] == "merchant_terminal_mcc_mismatch"
    assert gates["q"] is None
    # 120 receipts against a mean of about 5.6 per active day: not fifty times.
    assert gates["v"] is None


CYCLE = "start string, nodes array<string>, edge_ids array<long>, amounts array<double>, times array<timestamp>, hops int"


def _cycle(start="a", amounts=(100.0, 90.0), nodes=("a", "b", "a"), key=1):
    return (start, list(nodes), [key, key + 1], list(amounts), [NOW - 2 * D, NOW - D], 2)


@pytest.mark.parametrize(
    "acct,related,amounts,reason",
    [
        ({"a": {"account_type": "TREASURY"}, "b": {}}, False, (100.0, 90.0), "internal_transfer"),
        ({"a": {}, "b": {}}, True, (100.0, 90.0), "known_relationship"),
        ({"a": {"kyc_occupation": "Employer"}, "b": {}}, False, (100.0, 90.0), "salary_advance_return"),
        ({"a": {"kyc_occupation": "employer"}, "b": {}}, False, (100.0, 101.0), None),
        ({"a": {"is_merchant": True}, "b": {"is_merchant": True}}, False, (100.0, 90.0), "merchant_settlement_cycle"),
        ({"a": {"is_merchant": True}, "b": {"is_merchant": True, "account_age_days": 89}}, False, (100.0, 90.0), None),
        ({"a": {"is_merchant": True}, "b": {"is_merchant": True, "kyc_completeness_score": 0.2}}, False, (100.0, 90.0), None),
        ({"a": {}, "b": {}}, False, (100.0, 69.0), "fee_or_partial_repayment"),
        ({"a": {}, "b": {}}, False, (100.0, 70.0), None),
        ({"a": {"account_type": "NOSTRO", "is_merchant": True}, "b": {"is_merchant": True}}, True, (100.0, 1.0), "internal_transfer"),
    ],
)
def test_cycle_filters_in_order(frame, acct, related, amounts, reason):
    relations = frame([("b", "a")] if related else [], "a string, b string")
    judged = G.cycle_legitimacy(frame([_cycle(amounts=amounts)], CYCLE), accounts(frame, **acct), relations)
    assert judged.first()["reason"] == reason
    assert fired(G.confirmed_cycle(judged)) == (set() if reason else {"a"})


def test_strict_self_compares_the_origin_with_itself(frame):
    cycles = frame([_cycle()], CYCLE)
    accts = accounts(frame, a={}, b={})
    relations = frame([("b", "a")], "a string, b string")
    assert G.cycle_legitimacy(cycles, accts, relations, strict_self=True).first()["reason"] is None


def test_first_gate_in_order_and_nulls_never_fire(frame):
    t = frame([(1, "a", None), (2, "b", "T"), (3, None, "T"), (4, "c", None)], "transaction_id int, account_id string, merchant_terminal_id string")

    def table(rows, key="account_id"):
        df = frame(rows, f"{key} string, fired boolean, gate string")
        return df.withColumn("evidence", F.struct(F.lit(1).alias("x")))

    first, second = table([("a", True, "g1"), ("b", None, "g1")]), table([("a", True, "g2"), ("b", False, None)])
    terminal = table([("T", True, "term")], "merchant_terminal_id")
    got = {r["transaction_id"]: r["gate_fired"] for r in G.run_gates(t, [first, second], terminal).collect()}
    assert got == {1: "g1", 2: "term", 3: "term", 4: None}


def test_registered_gate_takes_its_priority(frame):
    t = frame([(1, "a")], "transaction_id int, account_id string")
    base = frame([("a", True, "base")], "account_id string, fired boolean, gate string")
    G.register_gate("mine", -5, lambda **_: frame([("a", True, "mine")], "account_id string, fired boolean, gate string"))
    try:
        assert G.run_gates(t, [base]).first()["gate_fired"] == "mine"
    finally:
        G._EXTRA.clear()


def test_payments_without_a_terminal_do_not_meet_in_one_task(spark, frame):
    rows = [(i, "a", NOW, f"T{i % 10}" if i % 5 == 0 else None) for i in range(2_000)]
    t = frame(rows, "transaction_id int, account_id string, ts timestamp, merchant_terminal_id string")
    gate = lambda key, rows: frame(rows, f"{key} string, fired boolean, gate string").withColumn("evidence", F.lit(1))
    first = gate("account_id", [("b", True, "g1")]).withColumn("evidence", F.struct("evidence"))
    terminal = gate("merchant_terminal_id", [("T5", True, "term"), (None, True, "none")]).withColumn("evidence", F.struct("evidence"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = G.run_gates(t, [first], terminal).select("transaction_id", "gate_fired", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["transaction_id"] for r in out if r["gate_fired"] == "term"} == set(range(5, 2_000, 10))
    assert len(out) == 2_000 and {r["gate_fired"] for r in out} == {"term", None}
    parts = [r["part"] for r in out]
    assert max(map(parts.count, set(parts))) < 1_000
