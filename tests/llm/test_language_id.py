import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerscope.llm import language_id as li
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def phrases(text, reference):
    """Greedy longest matches, by substring search."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i : i + size + 1] in reference:
            size += 1
        if text[i : i + 1] not in reference:
            size = 1
        n, i = n + 1, i + size
    return n


def normal(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def test_parse_against_substring_search(monkeypatch):
    monkeypatch.setattr(li, "PIECE", 1 << 20)
    rng = random.Random(3)
    samples = {k: ["".join(rng.choices(alphabet, k=200))] for k, alphabet in (("x", "aab c"), ("y", "bccd e"))}
    model = li.train(samples)
    parser = li.Parser(model)
    texts = ["".join(rng.choices("abcdeZ  .", k=rng.randint(1, 60))) for _ in range(200)]
    shown = parser(pa.array(texts))
    for text, got in zip(texts, shown):
        own = normal(text)
        if not any(c.isalpha() for c in own):
            assert got["lang_pred"] == "und"
            continue
        cost = [phrases(own, normal(samples[k][0])) * b for k, b in zip("xy", model.phrase_bits)]
        want = "x" if cost[0] <= cost[1] else "y"
        assert got["lang_pred"] == want, (text, cost, got)


def test_odd_rows(spark):
    rows = [
        (1, "the cat and the hat", "en", 1), (2, None, "en", 2), (3, "", "en", 3), (4, "123 ...", None, 4),
        (5, "le chat et le chapeau", "fr", 5), (5, "le chat et le chapeau", "fr", 5), (None, "漢字", None, 6),
        (6, "the " * 60_000, "en", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = li.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2].score == 0.0
    assert all(0 <= r.score <= 1 for r in got)
    assert by[None].held_out is False
    assert li.identify(docs.filter("false")).count() == 0
    left = li.keep_identified(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 5, 5, 6]
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} <= {"und"}


def test_query_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"][0](spark, SF).collect()
    assert len(got) == len(docs)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and docs[r.doc_id].lang:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 200 and right / total > 0.97


def test_every_learned_letter_of_large_scripts_counts():
    """More letters than the tables have columns: equal results to full tables, all known."""
    import random

    import pyarrow as pa

    from ledgerscope.llm import language_id as d

    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(1_500)]
    hangul = [chr(0xAC00 + i) for i in range(900)]

    words = {id(x): ["".join(x[i : i + 3]) for i in range(0, len(x), 3)] for x in (han, hangul)}

    def text(letters, n):
        return " ".join(rng.choices(words[id(letters)], k=n // 4))

    english = " ".join("".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(1_800))
    samples = {"zh": [text(han, 9_000)], "ko": [text(hangul, 9_000)], "en": [f"the dog and the fox {english}"]}
    probes = [samples["zh"][0][500:700], text(han, 300), text(hangul, 300), samples["ko"][0][:99], "the dog and the fox", "ωψ", text(han, 600) + text(hangul, 600)]
    got = d.Parser(d.train(samples))(pa.array(probes))
    assert [g["lang_pred"] for g in got[:5]] == ["zh", "zh", "ko", "ko", "en"]
    assert all(g["known"] > 0.95 for g in got[:5]) and got[5]["known"] == 0
    dense, d.DENSE_LETTERS = d.DENSE_LETTERS, 10_000
    try:
        assert d.Parser(d.train(samples))(pa.array(probes)) == got
    finally:
        d.DENSE_LETTERS = dense
