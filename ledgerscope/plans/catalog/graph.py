"""Graph metrics, traversals and snapshot scoring."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerscope.operators.graph import basic as B
from ledgerscope.operators.graph import components as S
from ledgerscope.operators.graph import paths as H
from ledgerscope.operators.graph.betweenness import betweenness
from ledgerscope.operators.graph.community import communities, modularity
from ledgerscope.operators.graph.pagerank import personalized_pagerank
from ledgerscope.operators.graph.snapshot import flagged_accounts, score_graphs
from ledgerscope.operators.graph.walks import walk_embeddings
from ledgerscope.plans.catalog import Registry
from ledgerscope.plans.catalog.profile import r
from ledgerscope.scale import cut_lineage
from ledgerscope.sources import views as V
from ledgerscope.sources.views import as_of, with_views

QUERIES = q = Registry()

SIMPLE_SQL = """, sg AS MATERIALIZED (SELECT src, dst, sum(amount) AS weight FROM edges GROUP BY src, dst),
  nodes AS MATERIALIZED (SELECT src AS id FROM sg UNION SELECT dst FROM sg)"""
UNDIRECTED_SQL = """, ug AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM sg WHERE src <> dst GROUP BY ALL),
  bw AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM ug UNION ALL SELECT b, a, weight FROM ug)"""


def graph(spark, d):
    return B.simple_graph(V.edges(spark, d))


@q(
    "g1_simple_graph",
    with_views(
        "edges",
        """SELECT src, dst, round(sum(amount), 4) AS total, arg_max(amount, ts) AS last FROM edges GROUP BY src, dst""",
    ),
)
def _(spark, d):
    e = V.edges(spark, d)
    total = B.simple_graph(e).withColumnRenamed("weight", "total")
    last = B.simple_graph(e, "last").withColumnRenamed("weight", "last")
    return r(total.join(last, ["src", "dst"]), "total")


@q("g2_undirected", with_views("edges", SIMPLE_SQL + UNDIRECTED_SQL + " SELECT a, b, round(weight, 4) AS weight FROM ug"))
def _(spark, d):
    return r(B.undirected(graph(spark, d)), "weight")


# The operator's own rounds and tolerance: the first round that changes less counts.
_ROUNDS, _TOLERANCE = 100, 1e-6
PAGERANK_SQL = (
    SIMPLE_SQL
    + """, seeded AS MATERIALIZED (SELECT id FROM nodes WHERE id IN (SELECT account_id FROM seeds)),
  outw AS MATERIALIZED (SELECT src, sum(weight) AS w FROM sg GROUP BY src),
  tr AS MATERIALIZED (SELECT sg.src, sg.dst, sg.weight / o.w AS share FROM sg JOIN outw o USING (src)),
  base AS MATERIALIZED (SELECT id, CASE WHEN (SELECT count(*) FROM seeded) = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM nodes)
      WHEN id IN (SELECT id FROM seeded) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeded) ELSE 0.0 END AS p,
    id NOT IN (SELECT src FROM outw) AS dead FROM nodes),
  r0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rk FROM base)"""
    + "".join(
        f""", r{i} AS MATERIALIZED (SELECT b.id, b.p, b.dead, 0.85::DOUBLE * coalesce(c.s, 0) + (0.85::DOUBLE * coalesce((SELECT sum(rk) FROM r{i - 1} WHERE dead), 0) + 0.15) * b.p AS rk
    FROM base b LEFT JOIN (SELECT tr.dst, sum(r.rk * tr.share) AS s FROM tr JOIN r{i - 1} r ON tr.src = r.id GROUP BY tr.dst) c ON b.id = c.dst)"""
        for i in range(1, _ROUNDS + 1)
    )
    + ", changes AS ("
    + " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rk - b.rk)) AS change FROM r{i} a JOIN r{i - 1} b USING (id)" for i in range(1, _ROUNDS + 1))
    + f"""), settled AS MATERIALIZED (SELECT coalesce(min(i) FILTER (change < {_TOLERANCE} * (SELECT count(*) FROM nodes)), {_ROUNDS}) AS i FROM changes),
  ranks AS ("""
    + " UNION ALL ".join(f"SELECT id, rk FROM r{i} WHERE {i} = (SELECT i FROM settled)" for i in range(1, _ROUNDS + 1))
    + ")"
)


@q(
    "g3_pagerank",
    with_views("edges seeds", PAGERANK_SQL + " SELECT id AS account_id, round(rk, 8) AS pagerank_fraud_seeded FROM ranks"),
)
def _(spark, d):
    ranks = personalized_pagerank(graph(spark, d), V.seeds(spark, d))
    return r(ranks, "pagerank_fraud_seeded", places=8)


@q(
    "g8_fraud_distance_proxy",
    with_views(
        "edges seeds",
        PAGERANK_SQL
        + " SELECT id AS account_id, round(CASE WHEN rk <= 0 THEN 10.0 ELSE greatest(10 * (1 - least(rk * 100, 1.0::DOUBLE)), 1.0::DOUBLE) END, 6) AS shortest_path_to_fraud FROM ranks",
    ),
)
def _(spark, d):
    ranks = personalized_pagerank(graph(spark, d), V.seeds(spark, d))
    rows = B.fraud_distance_proxy(ranks).select("account_id", "shortest_path_to_fraud")
    return r(rows, "shortest_path_to_fraud", places=6)


@q("g4_communities")
def _(spark, d):
    return communities(graph(spark, d))


@q("g4_modularity")
def _(spark, d):
    g = cut_lineage(graph(spark, d))
    return modularity(g, communities(g))


@q(
    "g5_clustering",
    with_views(
        "edges",
        SIMPLE_SQL
        + UNDIRECTED_SQL
        + """, dg AS (SELECT src AS id, count(*) AS d FROM bw GROUP BY src),
        tri AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM ug x JOIN ug y ON x.b = y.a JOIN ug z ON z.a = x.a AND z.b = y.b),
        tc AS (SELECT id, count(*) AS t FROM (SELECT u AS id FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY id)
        SELECT dg.id AS account_id, coalesce(t, 0) AS triangles, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 6) AS clustering_coefficient
        FROM dg LEFT JOIN tc USING (id)""",
    ),
)
def _(spark, d):
    return r(B.clustering_coefficient(graph(spark, d)), "clustering_coefficient", places=6)


# Shortest-path counts over all sources: level by level in SQL, as the job does it.
_LEVELS = 6
BETWEENNESS_SQL = (
    SIMPLE_SQL
    + """, lk AS MATERIALIZED (SELECT DISTINCT src, dst FROM sg WHERE src <> dst),
  l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS sigma FROM nodes)"""
    + "".join(
        f""", l{i} AS MATERIALIZED (SELECT l.s, k.dst AS v, sum(l.sigma) AS sigma FROM l{i - 1} l JOIN lk k ON l.v = k.src
    WHERE NOT EXISTS (SELECT 1 FROM ({" UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in range(i))}) p WHERE p.s = l.s AND p.v = k.dst) GROUP BY ALL)"""
        for i in range(1, _LEVELS + 1)
    )
    + f", d{_LEVELS} AS MATERIALIZED (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM l{_LEVELS})"
    + "".join(
        f""", d{i} AS MATERIALIZED (SELECT l.s, l.v, l.sigma, l.sigma * coalesce(x.sh, 0) AS delta FROM l{i} l LEFT JOIN
    (SELECT d.s, k.src AS v, sum((1 + d.delta) / d.sigma) AS sh FROM d{i + 1} d JOIN lk k ON d.v = k.dst GROUP BY ALL) x ON l.s = x.s AND l.v = x.v)"""
        for i in range(_LEVELS - 1, -1, -1)
    )
    + ", alld AS ("
    + " UNION ALL ".join(f"SELECT s, v, delta FROM d{i}" for i in range(_LEVELS + 1))
    + """), bt AS (SELECT v, sum(delta) AS t FROM alld WHERE s <> v GROUP BY v),
  bc AS (SELECT id AS account_id, coalesce(t, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS betweenness_centrality FROM nodes LEFT JOIN bt ON id = v)"""
)


@q("g6_betweenness_sampled")
def _(spark, d):
    return betweenness(graph(spark, d))


@q(
    "g6_betweenness_exact",
    with_views(
        "edges",
        BETWEENNESS_SQL
        + " SELECT account_id, round(betweenness_centrality, 6) AS betweenness_centrality, round(betweenness_centrality / (SELECT max(betweenness_centrality) FROM bc), 5) AS bridge_node_probability FROM bc",
    ),
)
def _(spark, d):
    rows = r(betweenness(graph(spark, d), k=1_000_000), "betweenness_centrality", places=9)
    rows = r(B.bridge_probability(rows), "bridge_node_probability", places=5)
    return r(rows, "betweenness_centrality", places=6)


def cycles_sql(max_hops: int = 8, k: int = 5) -> str:
    """Round trips level by level: closed before grown, and grown only where they can still close."""
    half = max_hops // 2
    sql = f""", be AS MATERIALIZED (SELECT * FROM edges WHERE ts > TIMESTAMP '2024-01-24 00:00:00'),
 bl AS MATERIALIZED (SELECT DISTINCT src, dst FROM be),
 rd AS (SELECT DISTINCT src AS start, src AS node, 0 AS d FROM bl
   UNION SELECT rd.start, bl.src, rd.d + 1 FROM rd JOIN bl ON bl.dst = rd.node WHERE rd.d < {half}),
 near AS MATERIALIZED (SELECT start, node, min(d) AS d FROM rd GROUP BY ALL),
 p1 AS MATERIALIZED (SELECT src AS start, dst AS tip, [transaction_id] AS ids, [src, dst] AS nodes FROM be)"""
    for h in range(2, max_hops + 1):
        sql += f""",
 c{h} AS MATERIALIZED (SELECT w.start, list_append(w.ids, e.transaction_id) AS ids, list_append(w.nodes, e.dst) AS nodes, {h} AS hops
   FROM p{h - 1} w JOIN be e ON w.tip = e.src AND w.start = e.dst WHERE NOT list_contains(w.ids, e.transaction_id)
   QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY list_append(w.ids, e.transaction_id)) <= {k})"""
        if h < max_hops:
            so_far = " UNION ALL ".join(f"SELECT start FROM c{i}" for i in range(2, h + 1))
            closing = f" AND EXISTS (SELECT 1 FROM near n WHERE n.start = w.start AND n.node = e.dst AND n.d <= {max_hops - h})" if max_hops - h <= half else ""
            sql += f""",
 f{h} AS MATERIALIZED (SELECT start FROM ({so_far}) GROUP BY start HAVING count(*) >= {k}),
 p{h} AS MATERIALIZED (SELECT w.start, e.dst AS tip, list_append(w.ids, e.transaction_id) AS ids, list_append(w.nodes, e.dst) AS nodes
   FROM p{h - 1} w JOIN be e ON w.tip = e.src WHERE NOT EXISTS (SELECT 1 FROM f{h} f WHERE f.start = w.start)
     AND NOT list_contains(w.ids, e.transaction_id){closing})"""
    closed = " UNION ALL ".join(f"SELECT * FROM c{h}" for h in range(2, max_hops + 1))
    return sql + f""",
 cyc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, ids) AS rank FROM ({closed}))"""


CYCLES_SQL = cycles_sql()


@q(
    "g9_cycles",
    with_views(
        "edges",
        CYCLES_SQL
        + """ SELECT start, CAST(hops AS INTEGER) AS hops, CAST(rank AS INTEGER) AS rank, array_to_string(nodes, '>') AS nodes, array_to_string(ids, ',') AS edge_ids
        FROM cyc WHERE rank <= 5""",
        recursive=True,
    ),
)
def _(spark, d):
    found = H.cycles(V.edges(spark, d), as_of())
    return _path_text(found, "start")


def _path_text(df, key):
    return df.select(
        key,
        "hops",
        "rank",
        F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"),
        F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edge_ids"),
    )


def trail_seeds(spark, d):
    """Every alert starts a trail."""
    return V.alerts(spark, d).select(
        F.col("alert_id").alias("seed_id"), "account_id", F.col("created_at").alias("seed_ts")
    )


def all_trails(spark, d, direction):
    return H.trails(trail_seeds(spark, d), V.edges(spark, d), direction)


# Ten hops over all transfers cannot be listed in SQL; the operator is compared with
# enumeration in the tests, and the full result with the two checks below.
@q("g10_trails_forward")
def _(spark, d):
    return _path_text(all_trails(spark, d, "forward"), "seed_id")


@q("g10_trails_backward")
def _(spark, d):
    return _path_text(all_trails(spark, d, "backward"), "seed_id")


def _trail_checks(spark, d, direction):
    """Seeds with a trail, and whether all of their trails are made of fitting transfers in order."""
    found = all_trails(spark, d, direction)
    forward = direction == "forward"
    seeds = trail_seeds(spark, d).select("seed_id", "account_id", "seed_ts")
    in_time = F.forall("times", lambda t: (t >= F.col("seed_ts")) if forward else (t <= F.col("seed_ts")))
    shaped = found.join(seeds, "seed_id").withColumn(
        "good",
        (F.size("edge_ids") == F.col("hops"))
        & (F.size("nodes") == F.col("hops") + 1)
        & F.col("hops").between(1, 10)
        & (F.size(F.array_distinct("edge_ids")) == F.col("hops"))
        & (F.col("nodes")[0] == F.col("account_id"))
        & in_time,
    )
    order = Window.partitionBy("seed_id").orderBy("rank")
    sorted_ = shaped.withColumn("before", F.lag("hops").over(order)).withColumn(
        "good", F.col("good") & (F.col("before").isNull() | (F.col("before") >= F.col("hops")))
    )
    per_seed = sorted_.groupBy("seed_id").agg(
        (F.min("good") & (F.max("rank") == F.count(F.lit(1))) & (F.max("rank") <= 20)).alias("valid")
    )
    steps = found.select("seed_id", "nodes", F.posexplode("edge_ids").alias("i", "transaction_id")).select(
        "seed_id", "transaction_id", F.col("nodes")[F.col("i")].alias("a"), F.col("nodes")[F.col("i") + 1].alias("b")
    )
    # Trails of a seed share most of their steps.
    steps = steps.distinct()
    known = V.edges(spark, d).select(
        "transaction_id", F.col("src" if forward else "dst").alias("a"), F.col("dst" if forward else "src").alias("b")
    )
    wrong = steps.join(known, ["transaction_id", "a", "b"], "left_anti").select("seed_id").distinct().withColumn("wrong", F.lit(True))
    return per_seed.join(wrong, "seed_id", "left").select(
        "seed_id", (F.col("valid") & F.col("wrong").isNull()).alias("valid")
    )


_CHECK_SQL = """SELECT alert_id AS seed_id, TRUE AS valid FROM alerts a
  WHERE EXISTS (SELECT 1 FROM edges e WHERE e.{end} = a.account_id AND e.ts {cmp} a.created_at)"""


@q("g10_trail_checks_forward", with_views("edges alerts", _CHECK_SQL.format(end="src", cmp=">=")))
def _(spark, d):
    return _trail_checks(spark, d, "forward")


@q("g10_trail_checks_backward", with_views("edges alerts", _CHECK_SQL.format(end="dst", cmp="<=")))
def _(spark, d):
    return _trail_checks(spark, d, "backward")


@q(
    "g11_hops_to_fraud",
    with_views(
        "edges seeds",
        """, lk AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
        bfs AS (SELECT account_id AS id, 0 AS hops FROM seeds WHERE account_id IN (SELECT src FROM lk)
          UNION SELECT lk.dst, b.hops + 1 FROM bfs b JOIN lk ON b.id = lk.src WHERE b.hops < 50)
        SELECT id AS account_id, CAST(min(hops) AS INTEGER) AS hops FROM bfs GROUP BY id""",
        recursive=True,
    ),
)
def _(spark, d):
    g = B.simple_graph(V.edges(spark, d))
    return B.hops_to_fraud(g, V.seeds(spark, d))


_CLOSURE_SQL = """, lk AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
  rc AS (SELECT src AS a, dst AS b FROM lk UNION SELECT rc.a, lk.dst FROM rc JOIN lk ON rc.b = lk.src)"""


@q(
    "g12_cycle_membership",
    with_views(
        "edges",
        _CLOSURE_SQL
        + """ SELECT id AS account_id, CASE WHEN EXISTS (SELECT 1 FROM rc WHERE a = id AND b = id) THEN 1.0::DOUBLE ELSE 0.0 END AS cycle_membership
        FROM (SELECT src AS id FROM lk UNION SELECT dst FROM lk)""",
        recursive=True,
    ),
)
def _(spark, d):
    return S.cycle_membership(B.simple_graph(V.edges(spark, d)))


@q(
    "g12_strong_components",
    with_views(
        "edges",
        _CLOSURE_SQL
        + """ SELECT x.a AS account_id, max(x.b) AS component FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
        recursive=True,
    ),
)
def _(spark, d):
    return S.strong_components(B.simple_graph(V.edges(spark, d)))


@q("g13_walk_embeddings")
def _(spark, d):
    return walk_embeddings(graph(spark, d))


@q("g13_walk_projection")
def _(spark, d):
    return walk_embeddings(graph(spark, d), window=2, method="projection")


@q(
    "g14_hyperedges",
    with_views(
        "acct",
        """, m AS (SELECT id AS account_id, account_age_days * 7 % 900 AS community_id FROM acct)
        SELECT account_id AS node, community_id AS hyperedge FROM m WHERE community_id IN (SELECT community_id FROM m GROUP BY 1 HAVING count(*) >= 2)""",
    ),
)
def _(spark, d):
    membership = V.acct(spark, d).select(
        F.col("id").alias("account_id"), (F.col("account_age_days") * 7 % 900).alias("community_id")
    )
    return B.hyperedges(membership)


# One graph per three hours: some have cycles, some chains.
def short_graphs(spark, d):
    return V.edges(spark, d).select(
        (F.dayofmonth("ts") * 100 + F.expr("hour(ts) div 3").cast("int")).alias("graph_id"), "src", "dst", "amount", "ts", "transaction_id"
    )


GRAPHS_SQL = """, ge AS MATERIALIZED (SELECT CAST(day(ts) * 100 + hour(ts) // 3 AS INTEGER) AS graph_id, src, dst, amount, ts, transaction_id FROM edges),
  gp AS MATERIALIZED (SELECT graph_id, src, dst, arg_max(amount, ts) AS amount FROM ge GROUP BY ALL),
  gr AS (SELECT graph_id, src AS a, dst AS b FROM gp UNION SELECT gr.graph_id, gr.a, gp.dst FROM gr JOIN gp ON gr.graph_id = gp.graph_id AND gr.b = gp.src),
  gc AS MATERIALIZED (SELECT g.graph_id, EXISTS (SELECT 1 FROM gr WHERE gr.graph_id = g.graph_id AND gr.a = gr.b) AS cyclic FROM (SELECT DISTINCT graph_id FROM gp) g),
  gl AS (SELECT p.graph_id, p.dst AS tip, 1 AS hops FROM gp p JOIN gc USING (graph_id) WHERE NOT cyclic
    UNION SELECT gl.graph_id, p.dst, gl.hops + 1 FROM gl JOIN gp p ON gl.graph_id = p.graph_id AND gl.tip = p.src),
  gd AS MATERIALIZED (SELECT gc.graph_id, gc.cyclic, max(gl.hops) AS depth FROM gc LEFT JOIN gl USING (graph_id) GROUP BY ALL)"""


@q(
    "g17_longest_chain",
    with_views("edges", GRAPHS_SQL + " SELECT graph_id, cyclic, cyclic AS not_acyclic, CAST(depth AS DOUBLE) AS depth FROM gd", recursive=True),
)
def _(spark, d):
    chains = S.longest_chain(short_graphs(spark, d))
    return chains.withColumn("depth", F.col("depth").cast("double"))


SNAPSHOT_SQL = (
    GRAPHS_SQL
    + """, gn AS (SELECT graph_id, node, count(*) FILTER (WHERE side = 'out') AS n_out, count(*) FILTER (WHERE side = 'in') AS n_in,
    sum(amount) FILTER (WHERE side = 'out') AS outflow, sum(amount) FILTER (WHERE side = 'in') AS inflow
    FROM (SELECT graph_id, src AS node, 'out' AS side, amount FROM gp UNION ALL SELECT graph_id, dst, 'in', amount FROM gp) GROUP BY ALL),
  gs AS (SELECT graph_id, count(*) AS n_nodes, bool_or(n_out >= 4) AS fan_out, arg_min(n_in, node) FILTER (WHERE n_in >= 4) AS collect_n,
    max(least(0.78 + (outflow / inflow - 0.8::DOUBLE) * 0.5, 0.95::DOUBLE)) FILTER (WHERE n_in >= 2 AND n_out >= 1 AND outflow / inflow >= 0.8) AS relay FROM gn GROUP BY graph_id),
  gm AS (SELECT graph_id, count(*) FILTER (WHERE (amount >= 47500 AND amount < 50000) OR (amount >= 95000 AND amount < 100000) OR (amount >= 950000 AND amount < 1000000)) AS near,
    max(amount) AS top, sum(amount) AS total, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM ge GROUP BY graph_id),
  gx AS (SELECT DISTINCT graph_id FROM (SELECT graph_id, round(amount, 2) AS a FROM ge GROUP BY ALL HAVING count(*) >= 3 AND a > 1000)),
  gb AS (SELECT DISTINCT graph_id FROM (SELECT graph_id, epoch_us(ts) - epoch_us(lag(ts, 2) OVER (PARTITION BY graph_id ORDER BY ts)) AS w FROM ge) WHERE w <= 1800000000),
  gw AS (SELECT gs.*, gd.cyclic, gd.depth, gm.near, gm.top, gm.total, gm.n, gm.span, gx.graph_id IS NOT NULL AS rep, gb.graph_id IS NOT NULL AS burst,
    (SELECT count(*) FROM gp WHERE gp.graph_id = gs.graph_id) AS scored
    FROM gs JOIN gd USING (graph_id) JOIN gm USING (graph_id) LEFT JOIN gx USING (graph_id) LEFT JOIN gb USING (graph_id)),
  gv AS (SELECT *, round(coalesce(greatest(CASE WHEN cyclic THEN 0.97::DOUBLE END, CASE WHEN fan_out THEN 0.85::DOUBLE END,
    CASE WHEN collect_n IS NOT NULL THEN least(0.82 + (collect_n - 4) * 0.02::DOUBLE, 0.92::DOUBLE) END, relay,
    CASE WHEN depth > 3 THEN 0.75 + least((depth - 3) * 0.04::DOUBLE, 0.1::DOUBLE) END, CASE WHEN cyclic AND n_nodes > 4 THEN 0.78::DOUBLE END,
    CASE WHEN near >= 2 THEN least(0.72 + (near - 2) * 0.08::DOUBLE, 0.88::DOUBLE) WHEN rep THEN 0.72::DOUBLE END, CASE WHEN burst THEN 0.65::DOUBLE END,
    CASE WHEN n >= 2 AND span < 600 AND total > 200000 THEN 0.6::DOUBLE END, CASE WHEN top >= 500000 THEN 0.45::DOUBLE END), 0), 4) AS score FROM gw)"""
)


@q(
    "r9_score_graphs",
    with_views(
        "edges",
        SNAPSHOT_SQL
        + """ SELECT graph_id, score, CASE WHEN score >= 0.83 THEN 'FRAUD' WHEN score >= 0.62 THEN 'SUSPICIOUS' WHEN score >= 0.38 THEN 'LOGGED' ELSE 'CLEAN' END AS verdict,
        CASE WHEN cyclic THEN 'circular_transfer_fraud' WHEN fan_out THEN 'smurfing_fan_out' WHEN collect_n IS NOT NULL THEN 'mule_network_aggregation'
          WHEN relay IS NOT NULL THEN 'rapid_relay_mule' WHEN depth > 3 THEN 'layering_chain' WHEN near >= 2 OR rep THEN 'structuring_below_threshold'
          WHEN burst OR (n >= 2 AND span < 600 AND total > 200000) THEN 'rapid_transfer_burst' WHEN top >= 500000 THEN 'large_value_transfer'
          WHEN score < 0.38 THEN 'none' ELSE 'unknown_pattern' END AS fraud_type,
        concat_ws(',', CASE WHEN cyclic THEN 'circular_path_detected' END, CASE WHEN fan_out THEN 'fan_out_detected' END, CASE WHEN collect_n IS NOT NULL THEN 'bipartite_collector' END,
          CASE WHEN relay IS NOT NULL THEN 'relay_conservation' END, CASE WHEN depth > 3 THEN 'chain_depth_exceeded' END, CASE WHEN near >= 2 THEN 'near_threshold_clustering' END,
          CASE WHEN near < 2 AND rep THEN 'repeated_amount_structuring' END, CASE WHEN burst THEN 'burst_30min_window' END,
          CASE WHEN n >= 2 AND span < 600 AND total > 200000 THEN 'high_velocity_transfer' END) AS signals,
        score >= 0.62 AS flagged, scored AS transactions_scored FROM gv""",
        recursive=True,
    ),
)
def _(spark, d):
    return score_graphs(short_graphs(spark, d)).withColumn("signals", F.concat_ws(",", "signals"))


@q(
    "r9_flagged_accounts",
    with_views(
        "edges",
        SNAPSHOT_SQL
        + """, fo AS (SELECT graph_id, min(node) AS c FROM gn WHERE n_out >= 4 GROUP BY 1), fi AS (SELECT graph_id, min(node) AS c FROM gn WHERE n_in >= 4 GROUP BY 1),
        rl AS (SELECT graph_id, node AS c FROM gn WHERE n_in >= 2 AND n_out >= 1 AND outflow / inflow >= 0.8),
        ro AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id, src ORDER BY dst) AS rn FROM gp),
        ri AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id, dst ORDER BY src) AS rn FROM gp),
        ne AS (SELECT * FROM ge WHERE (amount >= 47500 AND amount < 50000) OR (amount >= 95000 AND amount < 100000) OR (amount >= 950000 AND amount < 1000000)),
        ns AS (SELECT graph_id FROM ne GROUP BY 1 HAVING count(*) >= 2),
        rp AS (SELECT graph_id, round(amount, 2) AS a FROM ge GROUP BY ALL HAVING count(*) >= 3 AND a > 1000),
        ht AS (SELECT p.graph_id, p.src AS node, 1 AS h FROM gp p JOIN gd USING (graph_id) WHERE depth > 3
          UNION SELECT p.graph_id, p.src, ht.h + 1 FROM ht JOIN gp p ON p.graph_id = ht.graph_id AND p.dst = ht.node),
        hh AS MATERIALIZED (SELECT graph_id, node, max(h) AS h FROM ht GROUP BY ALL),
        nx AS MATERIALIZED (SELECT p.graph_id, p.src, hh.h, min(p.dst) AS dst FROM gp p JOIN hh ON p.graph_id = hh.graph_id AND p.src = hh.node
          LEFT JOIN hh d ON p.graph_id = d.graph_id AND p.dst = d.node WHERE coalesce(d.h, 0) = hh.h - 1 GROUP BY ALL),
        ch AS (SELECT graph_id, min(node) AS node, 1 AS step FROM hh JOIN gd USING (graph_id) WHERE hh.h = gd.depth GROUP BY graph_id
          UNION ALL SELECT nx.graph_id, nx.dst, step + 1 FROM ch JOIN nx ON ch.graph_id = nx.graph_id AND ch.node = nx.src WHERE step < 6)
        SELECT graph_id, a AS account_id, 'circular_path' AS reason FROM gr WHERE a = b
        UNION SELECT graph_id, c, 'fan_out' FROM fo UNION SELECT ro.graph_id, ro.dst, 'fan_out' FROM ro JOIN fo ON ro.graph_id = fo.graph_id AND ro.src = fo.c WHERE rn <= 6
        UNION SELECT graph_id, c, 'fan_in' FROM fi UNION SELECT ri.graph_id, ri.src, 'fan_in' FROM ri JOIN fi ON ri.graph_id = fi.graph_id AND ri.dst = fi.c WHERE rn <= 6
        UNION SELECT graph_id, c, 'relay' FROM rl UNION SELECT ro.graph_id, ro.dst, 'relay' FROM ro JOIN rl ON ro.graph_id = rl.graph_id AND ro.src = rl.c WHERE rn <= 4
        UNION SELECT ri.graph_id, ri.src, 'relay' FROM ri JOIN rl ON ri.graph_id = rl.graph_id AND ri.dst = rl.c WHERE rn <= 4
        UNION SELECT ne.graph_id, unnest([src, dst]), 'structuring' FROM ne JOIN ns USING (graph_id)
        UNION SELECT graph_id, node, 'layering_chain' FROM ch
        UNION SELECT e.graph_id, unnest([src, dst]), 'repeated_amount' FROM ge e JOIN rp ON e.graph_id = rp.graph_id AND round(e.amount, 2) = rp.a
          WHERE e.graph_id NOT IN (SELECT graph_id FROM ns)""",
        recursive=True,
    ),
)
def _(spark, d):
    return flagged_accounts(short_graphs(spark, d))
