import random
import re

import numpy as np
import xxhash

from ledgerscope.llm import simhash as s
from ledgerscope.llm.components import connected
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_classes(prints):
    """Smallest position reachable over pairs at four bits or fewer."""
    values = np.array(sorted(set(prints)), np.uint64)
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= s.MAX_BITS):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return {int(v): find(i) for i, v in enumerate(values)}


def test_fingerprint_rule():
    rng = random.Random(0)
    for _ in range(100):
        text = "".join(rng.choices("aBéZ\x1f\x0b \n\xa0", k=rng.randint(0, 60)))
        assert s.fingerprint(s.shingle_hashes(text.encode())) == plain_print(text)


def test_trie_against_all_pairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        values = centre[rng.integers(0, 3, n)]
        for _ in range(5):
            flip = rng.random(n) < 0.7
            values = np.where(flip, values ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)), values)
        values = np.unique(values)
        links = s.trie_links(values, np.zeros(len(values), int))
        assert all(bin(int(values[a] ^ values[b])).count("1") <= s.MAX_BITS for a, b in links)
        forest = s._Forest(len(values))
        for a, b in links:
            forest.join(a, b)
        assert len(forest.links) == len(links)
        want = plain_classes(values.tolist())
        assert {int(v): forest.find(i) for i, v in enumerate(values)} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (500, 501), (501, 500)]
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in connected(links, "a", "b").collect()}
    want = dict.fromkeys(range(41), 0) | {100: 100, 200: 100, 300: 100, 500: 500, 501: 500}
    assert got == want
    assert connected(links.filter("false"), "a", "b").count() == 0


def test_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [(5, base, "x"), (3, base, None), (None, base, "y"), (9, None, "z"), (8, "", "z"), (7, "other text here", "z"), (7, "other text here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = s.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (3, 5, None)} == {3}
    assert {(r.component_id, r.fingerprint) for r in got if r.doc_id in (8, 9)} == {(8, "0" * 16)}
    left = s.keep_first(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 7, 8]
    assert s.near_duplicates(docs.filter("false")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r.doc_id: plain_print(r.text) for r in docs}
    label = plain_classes(prints.values())
    least = {}
    for i, fp in prints.items():
        least[label[fp]] = min(i, least.get(label[fp], i))
    got = QUERIES["op5_simhash"][0](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == least[label[prints[r.doc_id]]]
