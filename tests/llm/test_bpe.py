import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm import bpe
from ledgerscope.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    return Tokenizer.from_file(vocabulary()), bpe.Codec(bpe.read_spec(vocabulary()))


def same(pair, text):
    library, codec = pair
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == decoded
    assert codec.summary(text) == (len(ids), " ".join(map(str, ids)), decoded)


def test_random_texts(pair):
    rng = random.Random(1)
    pool = "abcXYZ 'stΣσßéÉ\x1c\x1f́̈İKſ<|endoftext|>12½²_-.,!?\n\t\xa0日本\U0001f600"
    for _ in range(2_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        same(pair, text if rng.random() < 0.7 else text + "<|endoftext|>" + text)


def test_code_points(pair):
    for code in [*range(1, 0x500), *range(0x1E00, 0x3100), *range(0x1F300, 0x1F700)]:
        if unicodedata.category(chr(code)) != "Cn":
            same(pair, f"a{chr(code)}b {chr(code)}1")


def test_long_and_odd_texts(pair):
    for text in ["", " ", "a" * 500, "abcdefghij" * 400, "it's we'll 'S", "x" * 63 + " " + "x" * 64, "!" * 1000]:
        same(pair, text)


def test_cache_bound_keeps_results(pair):
    small = pair[0], bpe.Codec(bpe.read_spec(vocabulary()), 2)
    for text in ["one two three four", "four three two one two", "", "!"]:
        same(small, text)


def test_cuts_are_certain(pair):
    _, codec = pair
    symbols = [*"the;quick", "x</w>"]
    pieces = codec.fragments(symbols)
    assert [s for p in pieces for s in p] == symbols
    for left, right in zip(pieces, pieces[1:]):
        assert not any((left[-1] + right[0]) in t for t in codec.vocab)


def test_frames(spark, pair):
    rows = [(1, "Hello there", "a"), (2, None, "b"), (2, "", None), (None, "x x", "c"), (None, "x x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string")
    out = bpe.encode(docs, vocabulary())
    assert sorted(len(r.result.ids) for r in out.collect()) == [0, 0, 2, 2, 2]
    back = bpe.decode(out.select("row.doc_id", "result.ids"), vocabulary())
    assert {r.result.text for r in back.collect()} == {"", "x</w> x</w>", pair[0].decode(pair[1].encode("Hello there"))}
    assert bpe.round_trip(docs, vocabulary()).count() == 5
    whole = bpe.tokenised(docs, vocabulary()).collect()
    assert sorted((r.result.n_tokens, len(r.result.ids)) for r in whole) == [(0, 0), (0, 0), (2, 2), (2, 2), (2, 2)]
    assert bpe.round_trip(docs.filter("false"), vocabulary()).count() == 0


def test_query_against_library(spark, pair):
    library, _ = pair
    got = {r.doc_id: r for r in QUERIES["op6_bpe"][0](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for row in docs.collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        want = got.pop(row.doc_id)
        assert want.n_tokens == len(ids)
        assert want.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert want.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert not got
