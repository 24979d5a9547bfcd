import random

from ledgerscope.llm import line_dedup as d
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fold(line):
    return b" ".join(line.encode().translate(d._LOWER).split())


def lines(text):
    return [x for x in map(fold, (text or "").split("\n")) if x]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = set(a) & set(b)
        own, other = ({i: h for i, h in enumerate(x) if h in shared} for x in (a, b))
        got = d.align(own, other)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        single = [h for h in shared if a.count(h) == 1 == b.count(h)]
        if single:
            assert got
    same = [3, 1, 4, 1, 5, 9, 2, 6]
    whole = dict(enumerate(same))
    assert d.align(whole, whole) == [(i, i) for i in range(len(same))]
    moved = dict(enumerate([7, 7, *same, 8]))
    assert d.align(whole, {i: h for i, h in moved.items() if h in same}) == [(i, i + 2) for i in range(len(same))]


def test_odd_rows(spark):
    shared = "one two three four five six\nseven eight nine ten eleven"
    rows = [
        (1, f"start of the first one\n{shared}\nend", "x"), (2, f"other\n\n{shared.upper()}\nown end", "x"), (3, None, "x"), (4, "", None),
        (5, "a b\na b", "x"), (6, "a b", "x"), (7, shared, "x"), (7, shared, "x"), (None, "one  two three four five six ", "x"),
        (8, "\n".join(f"line number {i} of this long text" for i in range(20_000)), "x"),
        (9, "\n".join(f"line number {i} of this long text" for i in range(19_000)) + "\nlast line is its own here", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n` string")
    got = {r.doc_id: r for r in d.report(docs).collect()}
    assert {i: r.n_deleted for i, r in got.items()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 2, None: 1, 8: 0, 9: 19_000}
    assert d.report(docs).count() == len(rows)
    left = d.remove_duplicate_lines(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert set(texts) == {1, 2, 3, 4, 5, 6, 8, 9}
    assert texts[2] == "other\n\nown end" and texts[3] is None and texts[9] == "last line is its own here"
    assert d.report(docs.filter("false")).count() == 0


def brute(docs, least=5):
    """Lines in a run of ``least`` words or more that stands in any earlier document."""
    seen, out = set(), {}
    for key, text in docs:
        own = lines(text)
        count = [len(x.split()) for x in own]
        runs = set()
        gone = set()
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += count[b]
                if total >= least:
                    run = tuple(own[a : b + 1])
                    runs.add(run)
                    if run in seen:
                        gone.update(range(a, b + 1))
                    elif b > a + 10:
                        break
        seen |= runs
        out[key] = (len(own), sorted(gone))
    return out


def test_links_beyond_the_first_holder(spark):
    licence = "this line is a licence of many words"
    cases = [
        # Twice in the first holder, once in the others.
        [f"{licence}\nown text\n{licence}", f"b\n{licence}", f"c c\n{licence}\nc", licence],
        # Short lines that only together make a block; each has another first holder.
        ["one two\nx", "three four\ny", "z\nfive six", "one two\nthree four\nfive six", "a\none two\nthree four\nfive six\nb"],
        # Another order in the first holder.
        [f"{licence}\nand a second line of five", f"and a second line of five\n{licence}", f"and a second line of five\n{licence}\nown"],
        # A short line at either end of a block, and repeated short lines.
        ["a b\nc d e f g\nh\nq", "x\na b\nc d e f g\nh\ny", "o k\no k\no k\no k", "n\no k\no k\no k"],
    ]
    for texts in cases:
        docs = list(enumerate(texts))
        got = {r.doc_id: r.deleted for r in d.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        want = {i: ",".join(map(str, gone)) for i, (_, gone) in brute(docs).items()}
        assert got == want and any(want.values())


def test_random_documents(spark):
    rng = random.Random(8)
    pool = ["a", "b", "c c", "d d d", "e e e e", "f f f f f", "g g g g g g", ""]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(250)]
    got = {r.doc_id: (r.n_lines, r.deleted) for r in d.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (n, ",".join(map(str, gone))) for i, (n, gone) in brute(docs).items()}


def test_query_against_brute_force(spark):
    """Every document against all earlier ones."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.n_lines, r.deleted) for r in QUERIES["op1_line_dedup"][0](spark, SF).collect()}
    want = {i: (n, ",".join(map(str, gone))) for i, (n, gone) in brute(docs).items()}
    assert got == want
    assert sum(bool(gone) for _, gone in want.values()) > 50
