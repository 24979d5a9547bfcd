"""Graph operators against brute force on small graphs."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.graph import basic as B
from ledgerscope.operators.graph import components as S
from ledgerscope.operators.graph import paths as H
from ledgerscope.operators.graph.adjacency import TimeCutIndex
from ledgerscope.operators.graph.betweenness import betweenness
from ledgerscope.operators.graph.community import _merge, _split_disconnected, communities, label_propagation, modularity
from ledgerscope.operators.graph.pagerank import personalized_pagerank
from ledgerscope.operators.graph.snapshot import flagged_accounts, score_graphs
from ledgerscope.operators.graph.walks import random_walks, walk_embeddings
from ledgerscope.scale import cut_lineage

T0 = dt.datetime(2024, 1, 1)
M = dt.timedelta(minutes=1)
GRAPH = "src string, dst string, weight double"
EDGE = "src string, dst string, amount double, ts timestamp, channel string, transaction_id long"


def test_pagerank_sums_to_one_and_follows_the_seed(frame):
    g = frame([("s", "a", 3.0), ("s", "b", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)], GRAPH)
    got = {r[0]: r[1] for r in personalized_pagerank(g, frame([("s",)], "account_id string")).collect()}
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-4)
    # Dead-end mass returns to the seed: closed form of the fixed point.
    s = got["s"]
    assert got["a"] == pytest.approx(0.85 * 0.75 * s, abs=1e-4)
    assert got["b"] == pytest.approx(0.85 * 0.25 * s, abs=1e-4)
    assert got["c"] == pytest.approx(0.85 * got["a"], abs=1e-4)
    assert got["x"] == pytest.approx(0.0, abs=1e-4)


def test_pagerank_without_seeds_is_uniform_on_a_ring(frame):
    g = frame([("a", "b", 1.0), ("b", "c", 5.0), ("c", "a", 2.0)], GRAPH)
    got = [r[1] for r in personalized_pagerank(g, None).collect()]
    assert got == pytest.approx([1 / 3] * 3)


def _planted(groups=4, size=6):
    rows = []
    for g in range(groups):
        names = [f"g{g}n{i}" for i in range(size)]
        rows += [(a, b, 10.0) for a, b in itertools.combinations(names, 2)]
        rows.append((names[0], f"g{(g + 1) % groups}n1", 1.0))
    return rows


def test_communities_recover_planted_groups(frame):
    g = frame(_planted(), GRAPH)
    member = communities(g)
    found = {}
    for r in member.collect():
        found.setdefault(r["community_id"], set()).add(r["account_id"][:2])
    assert len(found) == 4 and all(len(v) == 1 for v in found.values())
    assert member.count() == 24
    plain = modularity(g, label_propagation(g)).first()[0]
    assert modularity(g, member).first()[0] >= plain - 1e-12
    assert communities(g).exceptAll(member).count() == 0


def _estimate_digits(df, capsys):
    """Digits of the planner's largest size estimate for ``df``."""
    capsys.readouterr()
    df.explain("cost")
    shown = re.findall(r"sizeInBytes=[0-9.]+(?:E\+(\d+))?", capsys.readouterr().out)
    assert shown
    return max(int(e or 0) for e in shown)


def test_rounds_of_communities_do_not_multiply_size_estimates(frame, capsys):
    # One label along a path of 12 accounts; accounts o and p hold it too and stand apart.
    names = "abcdefghijkl"
    pairs = [(x, y, 1.0) for x, y in itertools.pairwise(names)] + [("o", "p", 1.0)]
    pairs = cut_lineage(frame(pairs, "a string, b string, weight double"))
    links = cut_lineage(B.both_ways(pairs))
    labels = cut_lineage(B.node_ids(links).withColumn("label", F.lit("z")))
    split = _split_disconnected(links, labels)
    assert {r["id"]: r["label"] for r in split.collect()} == {**dict.fromkeys(names, "a"), "o": "o", "p": "o"}
    assert _estimate_digits(split, capsys) < 2_000
    # Merging single accounts; a and o stay apart, as no link joins them.
    single = cut_lineage(B.node_ids(links).withColumn("label", F.col("id")))
    merged = _merge(pairs, links, single, 10)
    got = {r["id"]: r["label"] for r in merged.collect()}
    assert got["o"] == got["p"] == "o" and set(got) == {*names, "o", "p"}
    assert all(got[got[x]] == got[x] for x in got) and len(set(got.values())) < 8
    assert _estimate_digits(merged, capsys) < 2_000


def test_null_weights_and_null_accounts_keep_their_labels(frame):
    g = frame([("a", "b", None), ("b", "c", 2.0), (None, "d", 1.0), ("e", "e", 1.0), ("c", "d", 1.0)], GRAPH)
    got = {r[0]: r[1] for r in label_propagation(g).collect()}
    # The link without a weight is the least vote of a and b: neither moves.
    assert got["a"] == "a" and got["b"] == "b" and got["e"] == "e" and got[None] is None
    assert got["c"] == got["b"] or got["c"] == got["d"]


def test_every_community_is_connected(frame):
    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}", float(rnd.randrange(1, 9))) for _ in range(60)]
    g = frame(rows, GRAPH)
    member = {r[0]: r[1] for r in communities(g).collect()}
    near = {}
    for a, b, _ in rows:
        if a != b and member[a] == member[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(member.values()):
        group = {n for n, m in member.items() if m == c}
        seen, todo = set(), [min(group)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        assert seen == group


def _random_links(seed, n=14, m=30):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)})


def _reach(links):
    nodes = {x for e in links for x in e}
    reach = {n: {b for a, b in links if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(*[reach[x] for x in reach[n]]) if reach[n] else set()
            if not more <= reach[n]:
                reach[n] |= more
                changed = True
    return nodes, reach


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components(frame, seed):
    links = [e for e in _random_links(seed) if e[0] != e[1]]
    nodes, reach = _reach(links)
    expected = {}
    for n in nodes:
        group = {m for m in nodes if m in reach[n] and n in reach[m]}
        if n in reach[n] and len(group | {n}) > 1:
            expected[n] = max(group | {n})
    g = frame([(a, b, 1.0) for a, b in links], GRAPH)
    assert {r["account_id"]: r["component"] for r in S.strong_components(g).collect()} == expected
    member = {r[0]: r[1] for r in S.cycle_membership(g).collect()}
    assert member == {n: 1.0 if n in expected else 0.0 for n in nodes}


def _bfs_counts(links, source):
    dist, sigma, order, frontier = {source: 0}, {source: 1}, [source], [source]
    while frontier:
        nxt = []
        for v in frontier:
            for a, b in links:
                if a == v and b not in dist:
                    dist[b], sigma[b] = dist[v] + 1, 0
                    nxt.append(b)
                    order.append(b)
        for v in frontier:
            for a, b in links:
                if a == v and dist.get(b) == dist[v] + 1:
                    sigma[b] += sigma[v]
        frontier = nxt
    return dist, sigma, order


def test_betweenness_matches_brute_force(frame):
    links = [e for e in _random_links(7, 12, 34) if e[0] != e[1]]
    nodes = sorted({x for e in links for x in e})
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order = _bfs_counts(links, s)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for a, b in links:
                if b == w and dist.get(a) == dist[w] - 1:
                    delta[a] += sigma[a] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(nodes)
    got = {r[0]: r[1] for r in betweenness(frame([(a, b, 1.0) for a, b in links], GRAPH), batch=5).collect()}
    assert got == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in total.items()})


def test_betweenness_stores_blocks_and_not_one_row_per_source_and_account(frame, monkeypatch):
    """Small tiles, blocks and packs: the same as networks of one block, in few rows; a null account counts as one."""
    from ledgerscope.operators.graph import betweenness as module

    stored = []

    def spy(df):
        kept = cut_lineage(df)
        stored.append(kept.count())
        return kept

    links = [e for e in _random_links(11, 40, 300) if e[0] != e[1]]
    rows = frame([(a, b, 1.0) for a, b in links] + [(None, links[0][0], 1.0)], GRAPH)
    whole = {r[0]: r[1] for r in betweenness(rows).collect()}
    for name, value in {"TILE": 4, "BLOCK_NODES": 8, "WIDTH": 10, "PACK_LINKS": 3}.items():
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(module, "cut_lineage", spy)
    got = {r[0]: r[1] for r in betweenness(rows).collect()}
    assert got == pytest.approx(whole) and got[None] == 0.0 and max(got.values()) > 0
    assert max(stored) <= len(set(links)) < len(got) ** 2 / 2


def test_clustering(frame):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "a"), ("e", "e")]
    got = {r["account_id"]: r["clustering_coefficient"] for r in B.clustering_coefficient(frame([(a, b, 1.0) for a, b in rows], GRAPH)).collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": 1.0, "c": 1.0, "d": 0.0})


def test_clustering_parts_grow_with_wedges(frame, spark, monkeypatch):
    """Twelve accounts in all pairs: 220 wedges, each closed, ten a part at most."""
    monkeypatch.setattr(B, "WEDGE_ROWS", 10)
    rows = [(f"n{a}", f"n{b}", 1.0) for a, b in itertools.combinations(range(12), 2)]
    found = B.clustering_coefficient(frame(rows, GRAPH))
    assert {(r["triangles"], r["clustering_coefficient"]) for r in found.collect()} == {(55, 1.0)}
    plan = found._jdf.queryExecution().toString()
    assert "RepartitionByExpression [v" in plan and ", 22" in plan.split("RepartitionByExpression [v")[1].split("\n")[0]


def test_walk_steps_shuffle_once(frame, spark):
    """A step is grouped as its join is dealt: walks are never dealt by their own id."""
    g = frame([(f"n{i}", f"n{(i * j + 1) % 40}", 1.0 + j) for i in range(40) for j in (1, 2, 3) if i != (i * j + 1) % 40], GRAPH)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = random_walks(g, length=4, walks=2)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(tip" in plan and "hashpartitioning(walk" not in plan


def test_hops_to_fraud(frame):
    g = frame([("f", "a", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], GRAPH)
    got = {r[0]: r[1] for r in B.hops_to_fraud(g, frame([("f",)], "account_id string")).collect()}
    assert got == {"f": 0, "a": 1, "b": 2, "c": 3}


def _transfers(seed, n=7, m=16):
    rnd = random.Random(seed)
    out = []
    for i in range(m):
        a, b = rnd.sample(range(n), 2)
        out.append((f"n{a}", f"n{b}", float(i + 1), T0 + rnd.randrange(100) * M, "UPI", i))
    return out


def _walks(rows, start, allowed, hops):
    found, stack = [], [(start, ())]
    while stack:
        tip, used = stack.pop()
        for r in rows:
            if r[0] == tip and r[5] not in used and allowed(r):
                path = used + (r[5],)
                found.append((path, r[1]))
                if len(path) < hops:
                    stack.append((r[1], path))
    return found


@pytest.mark.parametrize("seed", [1, 4])
def test_cycles_match_enumeration(frame, seed):
    rows = _transfers(seed)
    as_of = F.lit(T0 + dt.timedelta(days=1))
    got = {}
    for r in H.cycles(frame(rows, EDGE), as_of, max_hops=5, k=3).collect():
        got.setdefault(r["start"], []).append((r["rank"], tuple(r["edge_ids"])))
    expected = {}
    for start in {r[0] for r in rows}:
        closed = sorted((len(p), p) for p, tip in _walks(rows, start, lambda r: True, 5) if tip == start and len(p) > 1)
        if closed:
            expected[start] = [(i + 1, p) for i, (_, p) in enumerate(closed[:3])]
    assert {k: sorted(v) for k, v in got.items()} == expected


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("beam, chunk_bits", [(1, 0), (4, 10), (48, 1)])
def test_trails_are_the_longest_whatever_the_beam(frame, direction, beam, chunk_bits):
    rows = _transfers(9, n=6, m=18)
    seeds = [("s1", "n0", T0 + 30 * M), ("s2", "n3", T0 + 60 * M), ("s3", "nobody", T0)]
    got = {}
    found = H.trails(
        frame(seeds, "seed_id string, account_id string, seed_ts timestamp"), frame(rows, EDGE), direction, max_hops=4, k=4, beam=beam, chunk_bits=chunk_bits
    )
    for r in found.collect():
        got.setdefault(r["seed_id"], []).append((r["rank"], tuple(r["edge_ids"])))
        assert len(r["nodes"]) == r["hops"] + 1 and r["nodes"][0] == dict((s[0], s[1]) for s in seeds)[r["seed_id"]]
    expected = {}
    for sid, account, at in seeds:
        flipped = rows if direction == "forward" else [(r[1], r[0], *r[2:]) for r in rows]
        ok = (lambda r: r[3] >= at) if direction == "forward" else (lambda r: r[3] <= at)
        ranked = sorted((-len(p), p) for p, _ in _walks(flipped, account, ok, 4))
        if ranked:
            expected[sid] = [(i + 1, p) for i, (_, p) in enumerate(ranked[:4])]
    assert {k: sorted(v) for k, v in got.items()} == expected


@pytest.mark.parametrize("backward", [False, True])
def test_time_cut_index_answers_like_a_scan(frame, backward):
    """A hub of many chunks, equal times at their borders, and questions at every time."""
    rnd = random.Random(3)
    at = [T0 + rnd.randrange(25) * M for _ in range(400)]
    rows = [("hub" if i < 300 else f"c{i % 9}", i * 7919 % 1009, t) for i, t in enumerate(at)]
    steps = frame([*rows, ("hub", 5_000, None), (None, 5_001, T0)], "__from string, __eid long, __ts timestamp")
    index = TimeCutIndex(steps, "__from", backward, chunk_bits=2)
    asked = [(f"{a}{j}", a, T0 + (j - 1) * M) for a in ("hub", "c1", "none") for j in range(27)]
    table = frame(asked, "q string, tip string, at timestamp").withColumn("since", index.time("at"))
    m, got, size = 3, {}, {}
    for r in index.ask(table, "tip", "since", m).collect():
        got.setdefault(r["q"], []).append(r["__eid"])
        size[r["q"]] = size.get(r["q"], 0) + 1
    for q, tip, t in asked:
        fit = sorted(e for a, e, ts in rows if a == tip and (ts <= t if backward else ts >= t))
        assert sorted(got.get(q, []))[:m] == fit[:m]
        assert set(got.get(q, [])) <= set(fit) and len(got.get(q, [])) == len(set(got.get(q, [])))
    # Far fewer rows than the hub has transfers: one chunk, and m rows a later sibling.
    assert max(size.values()) < 4 + 7 * 4 * m


def test_trails_of_a_hub_read_little(frame):
    """Every partial trail ends at a hub with thousands of transfers; rows stay with seeds and beam."""
    rows = [("hub", f"x{i % 50}", 1.0, T0 + i * M, "UPI", 2 * i) for i in range(3_000)]
    rows += [(f"x{i % 50}", "hub", 1.0, T0 + i * M, "UPI", 2 * i + 1) for i in range(3_000)]
    seeds = [(f"s{i}", "hub", T0 + i * 100 * M) for i in range(5)]
    found = H.trails(frame(seeds, "seed_id string, account_id string, seed_ts timestamp"), frame(rows, EDGE), "forward", max_hops=4, k=3)
    got = {}
    for r in found.orderBy("seed_id", "rank").collect():
        got.setdefault(r["seed_id"], []).append(tuple(r["edge_ids"]))
    for i in range(5):
        first = 200 * i
        out = [e for e in range(first, first + 400, 2)]

        def walk(path):
            if len(path) == 4:
                yield path
                return
            tip = "hub" if len(path) % 2 == 0 else f"x{path[-1] // 2 % 50}"
            for e in (out if tip == "hub" else [e for e in range(first + 1, first + 400, 2) if f"x{e // 2 % 50}" == tip]):
                if e not in path:
                    yield from walk((*path, e))

        walks = walk(())
        assert got[f"s{i}"] == [next(walks) for _ in range(3)]


def _loop(n=40):
    """Three accounts in a ring with ``n`` transfers a side; every walk goes on."""
    return [(f"n{i % 3}", f"n{(i + 1) % 3}", 1.0, T0 + i * M, "UPI", i) for i in range(3 * n)]


def test_trail_rounds_keep_little(frame, monkeypatch):
    """Until the last two hops one partial trail a seed, and no copies of what its steps hold."""
    kept = []

    def spy(df):
        out = cut_lineage(df)
        kept.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(H, "cut_lineage", spy)
    seeds = [(f"s{i}", f"n{i % 3}", T0) for i in range(12)]
    found = H.trails(frame(seeds, "seed_id string, account_id string, seed_ts timestamp"), frame(_loop(), EDGE), "forward", max_hops=6, k=5)
    assert found.count() == 12 * 5
    grown = [n for names, n in kept if "edge_ids" in names]
    assert grown == [12, 12, 12, 12, 48, 60]
    assert not any({"nodes", "amounts", "times", "channels"} & names for names, _ in kept)


def test_large_accounts_keep_the_walk_bounds(frame, monkeypatch):
    """A hub of many chunks whose first transfers lead nowhere takes no second round."""
    rows = [("hub", f"d{i}", 1.0, T0 + i * M, "UPI", i) for i in range(40)]
    rows += [("hub", "x", 1.0, T0 + i * M, "UPI", 100 + i) for i in range(10)]
    rows += [("x", "hub", 1.0, T0 + i * M, "UPI", 200 + i) for i in range(10)]
    own, rounds = H._trail_round, []

    def spy(*args, **options):
        rounds.append(1)
        return own(*args, **options)

    monkeypatch.setattr(H, "_trail_round", spy)
    seeds = frame([("s", "hub", T0)], "seed_id string, account_id string, seed_ts timestamp")
    got = H.trails(seeds, frame(rows, EDGE), "forward", max_hops=4, k=3, chunk_bits=2).orderBy("rank").collect()
    assert [tuple(r["edge_ids"]) for r in got] == [(100, 200, 101, e) for e in (201, 202, 203)]
    assert len(rounds) == 1


def test_trails_of_a_repeated_seed(frame):
    """A seed that comes twice has each trail four times; an id with several accounts its ``k`` longest over all."""
    names = "seed_id string, account_id string, seed_ts timestamp"
    seeds = [("s", "n0", T0), ("s", "n0", T0), ("t", "n1", T0), ("t", "n2", T0), (None, "n1", T0)]
    got = {}
    for r in H.trails(frame(seeds, names), frame(_loop(), EDGE), "forward", max_hops=4, k=5).collect():
        got.setdefault(r["seed_id"], []).append((r["rank"], tuple(r["edge_ids"]), tuple(r["nodes"]), len(r["amounts"]), r["times"][0]))

    assert set(got) == {"s", "t"} and all([p[0] for p in sorted(rows)] == [1, 2, 3, 4, 5] for rows in got.values())
    assert [p[1] for p in sorted(got["s"])] == [(0, 1, 2, e) for e in (3, 3, 3, 3, 6)]
    assert [p[1] for p in sorted(got["t"])] == [(1, 2, 0, e) for e in range(4, 19, 3)]
    assert all(p[2] == ("n0", "n1", "n2", "n0", "n1") and p[3] == 4 and p[4] == T0 for p in got["s"])


def test_chain_and_repeat_accounts_are_flagged(frame):
    schema = "graph_id string, src string, dst string, amount double, ts timestamp, transaction_id long"
    line = [("line", f"n{i}", f"n{i + 1}", 10.0 + i) for i in range(7)] + [("line", "n0", "n2", 3.0), ("line", "a", "n1", 4.0)]
    same = [("same", "a", "b", 2_000.004), ("same", "c", "b", 2_000.0), ("same", "d", "e", 2_000.0), ("same", "f", "g", 5.0)]
    rows = [(*r, T0 + i * M * 60, i) for i, r in enumerate(line + same)]
    got = {(r["graph_id"], r["reason"], r["account_id"]) for r in flagged_accounts(frame(rows, schema)).collect()}
    assert {a for g, why, a in got if why == "layering_chain"} == {"a", "n1", "n2", "n3", "n4", "n5"}
    assert {a for g, why, a in got if why == "repeated_amount"} == {"a", "b", "c", "d", "e"}


def test_longest_chain(frame):
    rows = [("line", "a", "b"), ("line", "b", "c"), ("line", "a", "c"), ("line", "c", "d"), ("ring", "a", "b"), ("ring", "b", "a"), ("ring", "z", "a"), ("loop", "a", "a"), ("loop", "a", "b"), ("one", "p", "q")]
    got = {r["graph_id"]: (r["cyclic"], r["not_acyclic"], r["depth"]) for r in S.longest_chain(frame(rows, "graph_id string, src string, dst string")).collect()}
    assert got == {"line": (False, False, 3), "ring": (True, True, None), "loop": (False, True, None), "one": (False, False, 1)}


def _snapshot(frame, edges, gap=60 * M):
    rows = [("g", s, d, float(a), T0 + i * gap, i) for i, (s, d, a) in enumerate(edges)]
    df = frame(rows, "graph_id string, src string, dst string, amount double, ts timestamp, transaction_id long")
    return score_graphs(df).first()


@pytest.mark.parametrize(
    "edges,score,verdict,kind",
    [
        ([("a", "b", 10)], 0.0, "CLEAN", "none"),
        ([("a", "b", -5)], 0.0, "CLEAN", "none"),
        ([("a", "b", 10), ("b", "a", 10)], 0.97, "FRAUD", "circular_transfer_fraud"),
        ([("a", f"r{i}", 10 + i) for i in range(4)], 0.85, "FRAUD", "smurfing_fan_out"),
        ([(f"s{i}", "z", 10 + i) for i in range(6)], 0.86, "FRAUD", "mule_network_aggregation"),
        ([("a", "m", 100), ("b", "m", 100), ("m", "z", 158)], 0.0, "CLEAN", "none"),
        ([("a", "m", 100), ("b", "m", 100), ("m", "z", 160)], 0.78, "SUSPICIOUS", "rapid_relay_mule"),
        ([("a", "b", 1), ("b", "c", 2), ("c", "d", 3)], 0.0, "CLEAN", "none"),
        ([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("d", "e", 4)], 0.79, "SUSPICIOUS", "layering_chain"),
        ([("a", "b", 49_500), ("c", "d", 98_000)], 0.72, "SUSPICIOUS", "structuring_below_threshold"),
        ([("a", "b", 2_000), ("c", "d", 2_000), ("e", "f", 2_000)], 0.72, "SUSPICIOUS", "structuring_below_threshold"),
        ([("a", "b", 500_000)], 0.45, "LOGGED", "large_value_transfer"),
    ],
)
def test_snapshot_gates(frame, edges, score, verdict, kind):
    r = _snapshot(frame, edges)
    assert (r["score"], r["verdict"], r["fraud_type"]) == (pytest.approx(score), verdict, kind)


def test_snapshot_bursts(frame):
    three = [("a", "b", 10), ("c", "d", 20), ("e", "f", 30)]
    assert _snapshot(frame, three, 15 * M)["score"] == 0.65
    assert _snapshot(frame, three, 15.1 * M)["score"] == 0.0
    assert _snapshot(frame, [("a", "b", 120_000), ("c", "d", 120_000)], 5 * M)["fraud_type"] == "rapid_transfer_burst"


def test_walks_follow_links_and_prefer_heavy_ones(frame):
    rows = [("hub", f"x{i}", 1.0) for i in range(8)] + [("hub", "heavy", 92.0)]
    walks = random_walks(frame(rows, GRAPH), length=4, walks=60).collect()
    pairs = {(a, b) for a, b, _ in rows} | {(b, a) for a, b, _ in rows}
    assert len(walks) == 60 * 10
    for w in walks:
        assert len(w["path"]) == 4 and w["path"][0] == w["start"]
        assert all(step in pairs for step in zip(w["path"], w["path"][1:]))
    from_hub = [w["path"][1] for w in walks if w["start"] == "hub"]
    assert from_hub.count("heavy") / len(from_hub) > 0.75


@pytest.mark.parametrize("method", ["word2vec", "projection"])
def test_embeddings_cover_every_account(frame, method):
    g = frame(_planted(3, 5), GRAPH)
    got = walk_embeddings(g, dim=8, length=6, walks=4, method=method).collect()
    assert len(got) == 15 and all(len(r["embedding"]) == 8 for r in got)
    assert walk_embeddings(frame([("a", "b", 1.0)], GRAPH), dim=8, length=3, walks=1).count() == 0


def test_hyperedges_skip_singletons(frame):
    df = frame([("a", 1), ("b", 1), ("c", 2), ("d", -1), ("e", -1)], "account_id string, community_id int")
    assert sorted(tuple(r) for r in B.hyperedges(df).collect()) == [("a", 1), ("b", 1)]


def test_registered_graph_queries_run_the_whole_operators(spark, monkeypatch):
    """The sampled betweenness and the nightly features take the defaults of their operators."""
    from ledgerscope.plans.catalog import evidence, graph, load

    seen = {}

    def spy(name):
        def call(*args, **kwargs):
            seen[name] = set(kwargs)
            return spark.range(1)

        return call

    monkeypatch.setattr(graph, "betweenness", spy("g6"))
    monkeypatch.setattr(evidence, "account_graph_features", spy("g7"))
    for name in ("g6_betweenness_sampled", "g7_account_features"):
        load()[name][0](spark, "/root/testdata/sf0.001")
    assert not seen["g6"] & {"k"} and not seen["g7"] & {"k", "pagerank_iters"}
