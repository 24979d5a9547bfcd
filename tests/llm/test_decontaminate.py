import hashlib
import random
import re

import pytest

from ledgerscope.llm import decontaminate as d
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=d.WINDOW):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(name) if name is not None else "null")
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("window", [1, 3, 5])
def test_automaton_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(150):
        items = [(str(i), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        text = " ".join(rng.choices("abcd", k=rng.randint(0, 30)))
        spans, found = d.Automaton([(n, t.encode()) for n, t in items], window).scan(d.words_of(text.encode()))
        n, hit, names = brute(text, items, window)
        assert (sum(b - a for a, b in spans), sorted(found)) == (hit, names)


def test_odd_rows_and_blocks(spark):
    items = [(1, "one two three"), (1, "four Five"), (None, "six"), (2, None), (3, "..."), (10, "one two three")]
    docs = [
        (1, "zero ONE two-three four", "x"), (2, None, "x"), (3, "", None), (None, "six six", "y"),
        (None, "six six", "y"), (4, "é" * 10 + " five " * 50_000 + "four five", "z"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, result string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (d.BLOCK_BYTES, 5):
        done = d.scan_documents(table, bench, carry=["doc_id", "text", "result"], block_bytes=size).collect()
        assert len(done) == len(docs)
        for r in done:
            if r.row.doc_id != 4:
                assert (r.result.n_words, r.result.n_hit, r.result["items"]) == brute(r.row.text, items)
            else:
                assert (r.result.n_words, r.result.n_hit) == (50_003, 2)
    assert d.contamination(table.filter("false"), bench).count() == 0
    assert {r.contaminated for r in d.contamination(table, bench.filter("false")).collect()} == {False}


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [
        (1, f"start here, {passage}. End " + "tail " * 30, "a"), (2, "clean text stays.", "b"),
        (3, passage, "c"), (4, None, None), (5, passage + " filler" * 1000, "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    left = {r.doc_id: r for r in d.remove_contamination(docs, bench).collect()}
    assert sorted(left) == [1, 2, 4, 5]
    assert left[1].text.startswith("start here, . End tail") and left[1]["row"] == "a"
    assert (left[2].text, left[4].text, left[5].text) == (rows[1][1], None, rows[4][1])


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - d.WINDOW, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + d.WINDOW]), set()).add(str(name))
    assert all(len(k) == d.WINDOW for k in windows)
    got = {r.doc_id: r for r in QUERIES["op2_decontaminate"][0](spark, SF).collect()}
    assert len(got) == len(docs)
    for row in docs:
        w, hit, found = words(row.text), set(), set()
        for i in range(len(w) - d.WINDOW + 1):
            names = windows.get(tuple(w[i : i + d.WINDOW]))
            if names:
                hit.update(range(i, i + d.WINDOW))
                found |= names
        r = got[row.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert any(r.contaminated for r in got.values())
