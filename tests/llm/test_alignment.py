import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerscope.llm import alignment
from ledgerscope.llm.queries import QUERIES, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Sides(alignment.read(A), alignment.read(B))


def plain(tools, text):
    """Tokens with their byte ranges, or none."""
    a, b, sides = tools
    if not text:
        return [], []
    out = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, sides.bytes_a), (b.encode(text), sides.bytes_b)):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != b" " + text.encode():
            return [], []
        out.append(side)
    return tuple(out)


def brute(tools, rows):
    """Every pair of tokens compared by its byte ranges."""
    found, counts = [], Counter()
    for i, text in rows:
        a, b = plain(tools, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            side = [",".join(str(t) for t, _, e in s if low < e <= cut) for s in (a, b)]
            groups.append("|".join(side))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        counts.update(links)
        found.append((i, len(a), len(b), len(cuts), links, digest))
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(c, top.get(b, 0))
    return sorted(
        (
            (i, n_a, n_b, n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), d)
            for i, n_a, n_b, n, links, d in found
        ),
        key=str,
    )


def result(frame):
    return sorted(
        ((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()), key=str
    )


def test_query_against_ranges(spark, tools):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = result(QUERIES["op13_alignment"][0](spark, folder))
    short = [r for r in rows if len(r[1] or "") < 3_000]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    # Counts need all texts: links by the merge of ends, checked above range by range.
    counts = Counter()
    for _, text in rows:
        a, b = plain(tools, text)
        counts.update(merge(a, b))
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(c, top.get(b, 0))
    for i, text in rows:
        links = list(merge(*plain(tools, text)))
        assert by[i][4:7] == (len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links))
    alone = {r[0]: r for r in brute(tools, short)}
    assert all(alone[i][1:5] + alone[i][7:] == by[i][1:5] + by[i][7:] for i, _ in short)


def merge(a, b):
    i = j = 0
    while i < len(a) and j < len(b):
        yield a[i][0], b[j][0]
        end = min(a[i][2], b[j][2])
        i, j = i + (a[i][2] == end), j + (b[j][2] == end)


def test_odd_texts_over_several_containers(spark, tools, monkeypatch):
    rng = random.Random(3)
    pool = ["the ", "Straße", "日本", "\U0001f600", "  ", "\n", "\t", "▁", "é", "é", "<|endoftext|>", "</s>", "<0x41>", "\x00", "ﬁ", "aaa", "don't", "123"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "<s>"), (3, "the the the"), (3, "the the the"), (None, "word"), (204, "▁"), (205, "x" * 3_000)]
    monkeypatch.setattr(alignment, "CONTAINER_POSTINGS", 40)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, low int, container int").repartition(3)
    from ledgerscope.llm import frames

    monkeypatch.setattr(frames, "BATCH_ROWS", 7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = result(alignment.alignment(table, A, B))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(tools, rows)
    assert {r[1:] for r in got if r[0] in (200, 201)} == {(0, 0, 0, 0, 0, 0, "")}


def test_hot_pair_uses_dense_bitmaps(spark, tools):
    rows = [(i, "again " * (i % 5 + 1) + "and") for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert result(alignment.alignment(table, A, B)) == brute(tools, rows)


def test_ranks_encode_like_the_library(tools):
    """Every settled code point in several places, random words, and all sample documents."""
    import pyarrow.parquet as pq

    a, _, sides = tools
    assert sides.fast is not None
    settled = [c for c in map(chr, range(1, 0x3000)) if alignment._SETTLED.fullmatch(c)]
    texts = [t for c in settled for t in (c, f"a{c}b {c}1", f"{c}{c} x  {c}\n{c}", f"1{c}'s{c}'ll")]
    rng = random.Random(5)
    texts += ["".join(rng.choices(settled, k=rng.randint(1, 60))) for _ in range(3_000)]
    texts += ["".join(rng.choices("etaoinshrdlu aabbcc''..  \n", k=rng.randint(1, 80))) for _ in range(3_000)]
    texts += [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    texts = [" " + t for t in texts]
    assert sides.encode_a(texts) == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(table, A, B).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 3_000, 4_096):
        at = np.sort(rng.choice(4_096, size, replace=False))
        bitmap = alignment.packed(at)
        assert alignment.unpacked(bitmap).tolist() == at.tolist()
        assert alignment.popcount(bitmap) == size
        other = np.sort(rng.choice(4_096, 200, replace=False))
        both = alignment.merged([bitmap, alignment.packed(other)])
        assert alignment.unpacked(both).tolist() == sorted({*at.tolist(), *other.tolist()})


def test_pair_table(spark, tools):
    rows = [(1, "the cat the cat the"), (2, "the dog"), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = alignment.inverted(table, A, B, ["doc_id"]).checkpoint()
    got = {r.pair: (r.n_docs, r.n_links, r.best) for r in alignment.pair_scores(made).collect()}
    per = [Counter(merge(*plain(tools, t))) for _, t in rows]
    links, docs = sum(per, Counter()), Counter(x for c in per for x in c)
    assert {(p >> alignment.ID_BITS, p & (1 << alignment.ID_BITS) - 1): v[:2] for p, v in got.items()} == {
        x: (docs[x], links[x]) for x in links
    }
