import hashlib
import re

import pytest

import corpus_pipeline as cp
from ledgerscope.llm import bpe, decontaminate, language_id, line_dedup
from ledgerscope.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage kept, by name."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {"": None}
    out[""] = docs
    for n, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out[name] = docs
    return out


def test_columns_and_order(kept):
    names = list(kept)
    assert names[1:] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    for name in names[1:-1]:
        assert kept[name].columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in kept[name].collect())
    counts = [kept[n].count() for n in names]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_each_stage_against_plain_python(kept):
    from test_line_dedup import brute
    from test_simhash import plain_classes, plain_print

    raw = {r.doc_id: r for r in kept[""].collect()}
    stage1 = {r.doc_id: r for r in kept["language ID"].collect()}
    model = language_id.learn(kept[""])
    import pyarrow as pa

    judged = language_id.Parser(model)(pa.array([r.text for r in raw.values()]))
    assert set(stage1) == {i for i, j in zip(raw, judged) if j["lang_pred"] != "und" and j["known"] >= 0.5}

    texts = {}
    for i, (n, gone) in brute([(i, r.text) for i, r in sorted(stage1.items())]).items():
        if not gone or len(gone) < n:
            texts[i] = line_dedup.cut_lines(stage1[i].text, gone)
    assert {r.doc_id: r.text for r in kept["line dedup"].collect()} == texts

    label = plain_classes([plain_print(t) for t in texts.values()])
    best = {}
    for i, t in sorted(texts.items()):
        best.setdefault(label[plain_print(t)], i)
    stage3 = {r.doc_id: r.text for r in kept["SimHash near-dedup"].collect()}
    assert stage3 == {i: texts[i] for i in best.values()}

    items = [(str(r.item_id), r.text.encode()) for r in kept[""].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton, want = decontaminate.Automaton(items), {}
    for i, t in stage3.items():
        words = decontaminate.words_of(t.encode())
        spans, _ = automaton.scan(words)
        hit = sum(b - a for a, b in spans)
        if not hit or 20 * hit < len(words):
            want[i] = t
        elif hit < 0.5 * len(words):
            want[i] = decontaminate.cut_words(t, [x for s in spans for x in s])
    stage4 = {r.doc_id: r.text for r in kept["benchmark decontamination"].collect()}
    assert stage4 == want
    for t in stage4.values():
        words = decontaminate.words_of(t.encode())
        hit = sum(b - a for a, b in automaton.scan(words)[0])
        assert 20 * hit < max(1, len(words))

    codec = bpe.Codec(bpe.read_spec(vocabulary()))
    for r in kept["BPE encoding and decoding"].collect():
        ids = codec.encode(stage4[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(codec.decode(ids).encode()).hexdigest()


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "the cat sat on the mat today", "en", "a", 28), (3, "the cat sat on the mat today", "en", "a", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, (name, stage) in enumerate(cp.STAGES):
        assert stage(spark, docs.filter("false"), SF).count() == 0
        got = stage(spark, docs, SF)
        assert got.count() <= len(rows)
        assert n == len(cp.STAGES) - 1 or got.columns == COLUMNS


def test_run(spark, kept):
    got = {r.doc_id: r.n_tokens for r in cp.run(spark, SF).collect()}
    assert got == {r.doc_id: r.n_tokens for r in kept["BPE encoding and decoding"].collect()}
    assert cp.ORACLE_SQL is None and not re.search("localCheckpoint", open(cp.__file__).read())
