"""Thresholds, word lists, weights and feature names the results depend on."""

# ── Fixed values: feature registry ──────────────────────────────────────────
# The order is append-only: models assign features by position.
GRAPH_FEATURES = [
    "degree_centrality", "betweenness_centrality", "clustering_coefficient",
    "pagerank_fraud_seeded", "community_id", "community_fraud_ratio",
    "community_size", "shortest_path_to_fraud", "cycle_membership", "sink_score",
    "bipartite_score", "fan_out_ratio", "temporal_acceleration",
    "cash_mule_sink_score", "bridge_node_probability",
    "dormancy_reactivation_flag", "account_age_days", "kyc_completeness_score",
    "txn_count_30d", "txn_count_90d", "txn_count_all", "avg_txn_amount_30d",
    "distinct_counterparties_30d", "channel_entropy", "night_txn_ratio",
    "weekend_txn_ratio", "return_ratio", "amount_zscore",
    "counterparty_novelty", "hour_deviation", "channel_switch",
    "amount_series_score", "burst_score", "velocity_ratio", "dormancy_break",
    "geography_switch",
]
REALTIME_FEATURES = [
    "txn_amount", "txn_amount_log", "txn_amount_rounded", "channel_upi",
    "channel_imps", "channel_rtgs", "channel_neft", "hour_of_day",
    "day_of_week", "is_weekend", "is_night", "is_festival_period",
    "amount_vs_threshold_50000", "amount_vs_threshold_100000",
    "amount_vs_threshold_1000000", "payee_vpa_age_days", "txn_count_last_1h",
    "txn_count_last_24h", "txn_count_last_7d", "txn_volume_last_1h",
    "txn_volume_last_24h", "distinct_payees_24h", "payee_in_alert_log",
    "payee_shared_alert_count",
]
WINDOW_FEATURES = [
    "inflow_1h", "inflow_6h", "inflow_24h", "inflow_7d", "outflow_1h",
    "outflow_6h", "outflow_24h", "outflow_7d", "days_since_last_receive",
    "graph_staleness_hours",
]
EMBEDDING_FEATURES = [f"emb_{i}" for i in range(32)]
LATE_FEATURES = ["micro_test_payment", "benford_deviation", "fan_in_sender_zscore"]
SESSION_FEATURES = [
    "upi_collect_request", "upi_intent_flag", "payee_vpa_verified",
    "upi_app_type", "upi_deregistration_flag", "upi_pin_attempts_session",
    "upi_session_id_hash", "session_amount_ratio",
]
_V2 = GRAPH_FEATURES + REALTIME_FEATURES + WINDOW_FEATURES
FEATURE_VERSIONS = {
    "V1": GRAPH_FEATURES[:35] + REALTIME_FEATURES,
    "V2": _V2,
    "V3": _V2 + EMBEDDING_FEATURES,
    "V4": _V2 + EMBEDDING_FEATURES + LATE_FEATURES,
    "V5": _V2 + EMBEDDING_FEATURES + LATE_FEATURES + SESSION_FEATURES,
}
# The labelled-set bridges emit every V1 feature plus geography_switch, minus
# community_size; order is alphabetical.
BRIDGE_FEATURES = sorted(
    (set(GRAPH_FEATURES) | set(REALTIME_FEATURES)) - {"community_size"}
)
STRUCTURAL_FEATURES = [
    "pagerank_fraud_seeded", "community_fraud_ratio", "sink_score",
    "bipartite_score", "betweenness_centrality", "burst_score",
    "clustering_coefficient", "temporal_acceleration",
]
NOVELTY_FEATURES = [
    "pagerank_fraud_seeded", "betweenness_centrality", "clustering_coefficient",
    "degree_centrality", "fan_out_ratio", "sink_score", "bipartite_score",
    "community_fraud_ratio", "shortest_path_to_fraud", "return_ratio",
    "burst_score", "velocity_ratio", "channel_entropy", "counterparty_novelty",
    "bridge_node_probability", "temporal_acceleration",
    "dormancy_reactivation_flag",
]
SET_FEATURES = [
    "count_of_night_txns", "count_of_new_vpa_txns", "count_of_high_amount_txns",
    "count_of_channel_switches", "has_any_micro_test_payment",
    "has_any_round_amount_burst", "distinct_fraud_proximate_action_types",
]

# ── Fixed values: ingest ────────────────────────────────────────────────────
REQUEST_CHANNELS = ["UPI", "IMPS", "RTGS", "NEFT"]
ID_PATTERN = "^[a-zA-Z0-9_-]+$"
MAX_AMOUNT = 100_000_000
FUTURE_TOLERANCE_MINUTES = 5

# ── Fixed values: tier 1 rules ──────────────────────────────────────────────
THRESHOLD_BANDS = [(49_000, 50_000), (99_000, 100_000), (990_000, 1_000_000)]
REPORTING_THRESHOLDS = [50_000, 100_000, 1_000_000]
HIGH_FREQUENCY_OCCUPATIONS = ["gig_worker", "freelancer", "delivery", "merchant", "retailer"]

# ── Fixed values: score to action ───────────────────────────────────────────
THRESHOLD_LOG = 0.38
THRESHOLD_REVIEW = 0.62
THRESHOLD_HIGH_RISK = 0.83
JITTER_RANGE = 0.01
CANARY_SCORE, CANARY_ACTION = 0.50, "LOG"
FAST_CLEAN_SCORE, UNCERTAIN_SCORE, GATE_SCORE = 0.05, 0.10, 1.0
LARGE_VALUE = 1_000_000.0

# ── Fixed values: context adjustment ────────────────────────────────────────
GIG_OCCUPATIONS = ["gig_worker", "freelancer", "delivery"]
MERCHANT_OCCUPATIONS = ["merchant", "retailer", "shopkeeper"]
STALE_AFTER_HOURS = 26
STALE_SPAN_HOURS = 72
STALE_MAX_REGRESSION = 0.30

# ── Fixed values: gates ─────────────────────────────────────────────────────
RELAY_MIN_INFLOW = 5_000.0
RELAY_CONSERVATION = 0.80
RELAY_MIN_OUTGOING = 3
LEGIT_AGGREGATOR_OCCUPATIONS = [
    "salary_processor", "payroll_processor", "insurance_company",
    "tax_collector", "utility_provider",
]
SINK_EXEMPT_TYPES = ["JAN_DHAN"]
CASH_EXEMPT_TYPES = ["JAN_DHAN"]
CASH_EXEMPT_OCCUPATIONS = [
    "vegetable_vendor", "daily_wage", "agricultural_worker", "street_vendor",
]
INTERNAL_ACCOUNT_TYPES = ["INTERNAL", "TREASURY", "NOSTRO", "VOSTRO"]
PAYROLL_OCCUPATIONS = ["employer", "corporate", "payroll_processor"]
LEGIT_RETURN_RATIO = 0.70
MCC_EXPECTED_MAX = {
    "5411": 5_000.0, "5812": 3_000.0, "5912": 2_000.0, "7011": 10_000.0, "5999": 5_000.0,
}
DEFAULT_EXPECTED_MAX = 50_000.0
GATE_ORDER = [
    "rapid_relay", "confirmed_cycle", "abandoned_sink_d01", "abandoned_sink",
    "bipartite_core", "cash_mule_sink", "merchant_terminal",
]

# ── Fixed values: committee ─────────────────────────────────────────────────
SCORER_IDS = ["A", "B", "C", "D", "F"]
SCORER_WEIGHTS = {"A": 0.40, "B": 0.20, "C": 0.20, "D": 0.10, "F": 0.10}
SPECIALIST_THRESHOLDS = {"A": 0.92, "B": 0.90, "C": 0.88, "D": 0.90, "F": 0.85}
ACCOUNT_TYPE_CODES = {"SAVINGS": 0.0, "CURRENT": 0.33, "SALARY": 0.67, "NRI": 1.0}
KYC_AGE_CAP = 80.0
DAILY_COUNT_CAP = 50.0
PROTOTYPE_K = 5
PROTOTYPE_CAP = 512
NULL_FRACTION_LIMIT = 0.30

# ── Fixed values: novelty and drift ─────────────────────────────────────────
NOVELTY_THRESHOLD = -0.20
CONTAMINATION = 0.001
ESCALATION_OCCURRENCES = 10
FINGERPRINT_GAP_DAYS = 7
REVIEW_STATUSES = ["REVIEWED_NORMAL", "REVIEWED_NEW_FRAUD", "NEW_GATE_ADDED"]
PSI_ALERT = 0.2
PSI_MIN_ROWS = 100

# ── Fixed values: evidence ──────────────────────────────────────────────────
GATE_NARRATIVES = {
    "confirmed_cycle": "A confirmed circular fund transfer cycle was detected.",
    "abandoned_sink": "Funds flowed into an account showing abandoned sink behavior (high inflow, no outflow, new account).",
    "bipartite_core": "Account sits at the center of a many-to-one aggregation network consistent with mule coordination.",
    "cash_mule_sink": "Account received high-value transfers and converted them to cash with no subsequent digital activity.",
    "merchant_terminal": "Merchant terminal shows transaction patterns inconsistent with declared business category.",
}
NARRATIVE_CLOSE = "Recommend STR filing under PMLA Section 12 within 7 days."
ERASABLE_ACCOUNT_COLUMNS = ["kyc_occupation", "kyc_home_state"]
ERASABLE_TXN_COLUMNS = ["device_id", "ip_address"]
PROTECTED_COLUMNS = [
    "account_id", "transaction_id", "amount", "timestamp", "channel",
    "payee_account_id", "payee_vpa",
]
SANCTIONS_PRIORITY = {"OFAC": 1, "UN": 2, "MHA_INDIA": 3}
LATENCY_BUCKETS_MS = [5, 10, 20, 30, 50, 75, 90, 100, 150, 200, 500]
