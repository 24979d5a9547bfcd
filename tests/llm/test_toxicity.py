import numpy as np

from ledgerscope.llm import toxicity as t
from ledgerscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_fit_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    # Feature 0 marks grades above 0, feature 1 the highest, feature 2 nothing.
    rows = [[i for i, on in enumerate((g >= 1, g == 2, rng.random() < 0.5)) if on] for g in grades]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    model = t.fit(grades, starts, np.array([i for r in rows for i in r]), np.ones(starts[-1]), [b"a", b"b", b"c"])
    assert (np.diff(model.thresholds) > 0).all()
    assert model.weights[b"a"] > 1 and model.weights[b"b"] > 1 and abs(model.weights[b"c"]) < 1
    expected = model.above(np.array([sum(model.weights.get(w, 0) for w in x) for x in ([], [b"a"], [b"a", b"b"])])).sum(axis=1)
    assert expected[0] < 0.5 < expected[1] < 1.5 < expected[2]


def test_gradient():
    """One step of the fit moves the thresholds to the grades' frequencies."""
    grades = np.array([0] * 70 + [1] * 20 + [2] * 10)
    model = t.fit(grades, np.zeros(101, np.int64), np.zeros(0, np.int64), np.zeros(0), [])
    above = model.above(np.zeros(1))[0]
    assert np.allclose(above, [0.3, 0.1], atol=0.01)


def test_odd_rows(spark):
    docs = [(i, "nice words here" if i % 2 else "you awful fool", "x") for i in range(40)]
    docs += [(100, None, "x"), (101, "", None), (None, "awful", "x"), (1, "nice words here", "x"), (102, "fool " * 200_000, "x")]
    labels = [(i, 1, 1 - i % 2) for i in range(40)] + [(0, None, None), (500, 1, 1), (None, 0, 1), (1, 0, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, grade string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = t.grade_documents(table, marks).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[2].toxic and by[102].toxic and not by[3].toxic and 0 <= by[100].expected_severity <= 2
    assert by[100].expected_severity == by[101].expected_severity
    assert t.grade_documents(table.filter("false"), marks).count() == 0
    assert {r.grade for r in t.grade_documents(table, marks.filter("false")).collect()} == {None}
    assert {r.grade for r in t.grade_documents(table, marks.filter("toxic = 0 and quality = 1")).collect()} == {0}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.filter("doc_id % 3 <> 1")
    got = {r.doc_id: r for r in t.grade_documents(docs, known).collect()}
    left = labels.filter("doc_id % 3 = 1").collect()
    bad = [got[r.doc_id] for r in left if r.toxic == 1]
    clean = [got[r.doc_id] for r in left if r.toxic == 0]
    assert np.mean([g.toxic for g in bad]) > 0.9
    assert np.mean([g.toxic for g in clean]) < 0.005
    assert np.mean([g.expected_severity for g in bad]) > 1.5 > 0.5 > np.mean([g.expected_severity for g in clean])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op8_toxicity"][0](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_sample_is_bounded_in_documents(spark):
    """Labels without document take no places, and a repeated id enters with one row."""
    from ledgerscope.llm import toxicity as d

    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(2_000)], "doc_id long, quality int, toxic int")
    got = d.labelled_sample(docs, labels, rows=20).collect()
    assert len(got) == 20 and len({r.text for r in got}) == 20
    assert sorted(int(r.text.split()[1]) % 20 for r in got) == list(range(20))
