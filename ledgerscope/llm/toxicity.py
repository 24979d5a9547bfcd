"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 fine, 1 poor (low quality, not toxic), 2 toxic.  One weight per word
is shared by all thresholds: P(grade > j) = sigmoid(w . x - theta_j) with theta ascending.
The prediction is the expected grade, the sum of these probabilities.

Features are words and word beginnings present in the whole text.  The fit uses a bounded sample of labelled
rows (``sample_rows`` ids that have documents, those with the smallest hash; one row each); of their words, the
``features`` with the largest chi-squared statistic against the grade are kept, as far as
they stand out from chance among all words.  All documents are then scored.

Defined results: null and empty texts have no features and get the grade of the
thresholds alone; labels without toxic value are skipped, without quality count as fine;
the highest grade of repeated labels holds; labels without document are skipped; with no
label at all, or a single grade, every document gets that grade (or null); repeated
documents get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.components import use_checkpoints
from ledgerscope.llm.decontaminate import FOLD
from ledgerscope.llm.frames import as_bytes, column, map_rows

SAMPLE_ROWS = 20_000
# Bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6, 7)
FEATURES = 2_048
LEAST_DOCS = 5
# Expected number of words kept by chance.
FALSE_FEATURES = 0.05
TOXIC = 2
RESULT = "expected_severity double, p_toxic double, grade int"


@dataclass
class Model:
    """Word weights and ascending thresholds; ``grades`` is one more than the thresholds."""

    weights: dict[bytes, float]
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features_of(text: bytes, known=None) -> dict[bytes, int]:
    """Occurrences of each lower-cased word, and of each word beginning (marked by a star).

    Beginnings catch inflections.  ``known`` restricts the result to a set of features.
    """
    found: dict[bytes, int] = {}
    for word, n in Counter(text.translate(FOLD).split()).items():
        for feature in (word, *[word[:size] + b"*" for size in PREFIXES if len(word) > size]):
            if known is None or feature in known:
                found[feature] = found.get(feature, 0) + n
    return found


def value_of(n: int) -> float:
    """A feature's value by its occurrences: repeated use counts, with falling weight."""
    return math.log2(1 + n)


def grade(quality: str = "quality", toxic: str = "toxic"):
    """0 fine, 1 poor, 2 toxic; null without a toxic label."""
    return F.when(column(toxic) > 0, TOXIC).when(
        column(toxic).isNotNull(), F.when(column(quality) == 0, 1).otherwise(0)
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``grade, text`` of at most ``rows`` labelled documents, one row of each id."""
    graded = labels.select(column(doc_id).alias("id"), grade().alias("grade")).filter("grade IS NOT NULL AND id IS NOT NULL")
    graded = graded.groupBy("id").agg(F.max("grade").alias("grade"))
    source = docs.select(column(doc_id).alias("id"), column(text).alias("text"))
    # Labels without document take no place; an id counts once, with the smallest text hash.
    held = source.select("id").filter("id IS NOT NULL").distinct()
    chosen = graded.join(held, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most ``rows`` ids and grades.
    found = source.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))
    # Least hash of each id, map-side; rows that have it are one text.
    least = found.groupBy("id").agg(F.min("h").alias("h"))
    return found.join(F.broadcast(least), ["id", "h"]).groupBy("id").agg(
        F.min("grade").alias("grade"), F.min("text").alias("text")
    ).select("grade", "text")


def select_features(sample: DataFrame, features: int = FEATURES) -> list[bytes]:
    """Words with the largest chi-squared statistic, each in ``LEAST_DOCS`` documents or more."""
    kind = "words array<struct<word: binary, n: long, g1: long, g2: long>>"

    def setup():
        def work(grades, texts):
            # One table per batch goes out with its first row.
            seen, poor, bad = Counter(), Counter(), Counter()
            for g, t in zip(grades.to_pylist(), as_bytes(texts)):
                found = features_of(t).keys()
                seen.update(found)
                if g == 1:
                    poor.update(found)
                elif g == 2:
                    bad.update(found)
            rows = [{"word": w, "n": n, "g1": poor[w], "g2": bad[w]} for w, n in seen.items()]
            return [{"words": rows}] + [{"words": []}] * (len(grades) - 1)

        return work

    tables = map_rows(sample, ["grade"], [F.col("grade"), F.col("text")], kind, setup)
    n, n1, n2 = sample.agg(
        F.count(F.lit(1)), F.sum((F.col("grade") == 1).cast("long")), F.sum((F.col("grade") == 2).cast("long"))
    ).first()
    if not n:
        return []
    counts = tables.select(F.explode("result.words").alias("w")).groupBy("w.word").agg(
        F.sum("w.n").alias("n"), F.sum("w.g1").alias("g1"), F.sum("w.g2").alias("g2")
    )
    statistic = F.lit(0.0)
    for seen, total in ((F.col("n") - F.col("g1") - F.col("g2"), n - n1 - n2), (F.col("g1"), n1), (F.col("g2"), n2)):
        if total:
            for here, share in ((seen, F.col("n") / n), (total - seen, 1 - F.col("n") / n)):
                expected = total * share
                statistic = statistic + F.when(expected > 0, (here - expected) * (here - expected) / expected).otherwise(0.0)
    counts = counts.filter(F.col("n") >= LEAST_DOCS).select("word", statistic.alias("chi2"))
    words = counts.count()
    # P(chi-squared with two degrees > x) = exp(-x / 2), shared among all words.
    least = 2 * math.log(max(words, 1) / FALSE_FEATURES)
    top = counts.filter(F.col("chi2") > least).orderBy(F.desc("chi2"), "word").limit(features)
    return [bytes(r["word"]) for r in top.select("word").collect()]


def _sparse(sample: DataFrame, features: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grades, row starts, feature numbers and values of the sample (at most SAMPLE_ROWS rows)."""
    shared = sample.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(features)})

    def setup():
        place = shared.value

        def work(texts):
            held = [features_of(t, place) for t in as_bytes(texts)]
            return [{"at": [place[f] for f in h], "n": list(h.values())} for h in held]

        return work

    found = map_rows(sample, ["grade"], [F.col("text")], "at array<int>, n array<int>", setup)
    grades, sizes, at, values = [], [0], [], []
    for r in found.select("row.grade", "result.at", "result.n").toLocalIterator():
        grades.append(r["grade"])
        at += r["at"]
        values += [value_of(n) for n in r["n"]]
        sizes.append(len(at))
    return np.array(grades, np.int64), np.array(sizes, np.int64), np.array(at, np.int64), np.array(values, float)


def fit(
    grades: np.ndarray, starts: np.ndarray, at: np.ndarray, values: np.ndarray, features: list[bytes],
    penalty: float = 1.0, rounds: int = 200, rate: float = 0.1,
) -> Model:
    """Penalised maximum likelihood by Adam on the whole sample.

    Thresholds are a first value and positive steps (their logarithms are learned), so
    they stay ascending.
    """
    top, n, k = int(grades.max()), len(grades), len(features)
    row = np.repeat(np.arange(n), np.diff(starts))
    # Start where the grades' frequencies put the thresholds.
    share = np.array([np.clip((grades <= j).mean(), 1e-4, 1 - 1e-4) for j in range(top)])
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(top))
    params = np.concatenate((np.zeros(k), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    pad = np.arange(n)
    for step in range(1, rounds + 1):
        w, steps = params[:k], np.exp(params[k + 1 :])
        theta = params[k] + np.concatenate(([0.0], np.cumsum(steps)))
        score = np.bincount(row, weights=w[at] * values, minlength=n)
        # P(grade <= j) at the borders of the observed grade; minus and plus infinity outside.
        cdf = np.hstack((np.zeros((n, 1)), _sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))))
        high, low = cdf[pad, grades + 1], cdf[pad, grades]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_score = d_high - d_low
        grad_w = np.bincount(at, weights=d_score[row] * values, minlength=k) / n + penalty * w / n
        grad_t = np.array([(d_low[grades == j + 1].sum() - d_high[grades == j].sum()) / n for j in range(top)])
        tail = np.cumsum(grad_t[::-1])[::-1]
        grad = np.concatenate((grad_w, tail[:1], tail[1:] * steps))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        params = params - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    theta = params[k] + np.concatenate(([0.0], np.cumsum(np.exp(params[k + 1 :]))))
    return Model({f: float(x) for f, x in zip(features, params[:k]) if abs(x) > 1e-9}, theta)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """A model of the labelled sample; None without labelled documents."""
    use_checkpoints(docs.sparkSession)
    # Read three times; bounded by SAMPLE_ROWS.
    sample = labelled_sample(docs, labels, doc_id, text).checkpoint()
    features = select_features(sample)
    grades, starts, at, values = _sparse(sample, features)
    if not len(grades):
        return None
    if grades.max() == 0:
        return Model({}, np.zeros(0))
    return fit(grades, starts, at, values, features)


def score(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns) and ``result``: expected grade, P(toxic), likeliest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        fitted = shared.value

        def work(texts):
            if fitted is None:
                return [{"expected_severity": None, "p_toxic": None, "grade": None}] * len(texts)
            weights = fitted.weights
            held = [features_of(t, weights) for t in as_bytes(texts)]
            totals = np.array([math.fsum([weights[f] * value_of(n) for f, n in h.items()]) for h in held])
            above = fitted.above(totals)
            exact = np.hstack((np.ones((len(totals), 1)), above)) - np.hstack((above, np.zeros((len(totals), 1))))
            toxic = above[:, TOXIC - 1] if above.shape[1] >= TOXIC else np.zeros(len(totals))
            rows = zip(above.sum(axis=1).tolist(), toxic.tolist(), exact.argmax(axis=1).tolist())
            return [{"expected_severity": e, "p_toxic": p, "grade": g} for e, p, g in rows]

        return work

    return map_rows(docs, carry or docs.columns, [column(text)], RESULT, setup)


def grade_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade, toxic`` of every document."""
    done = score(docs, train(docs, labels, doc_id, text), text, [doc_id])
    return done.select(
        F.col("row").getField(doc_id).alias("doc_id"), "result.*", (F.col("result.p_toxic") >= 0.5).alias("toxic")
    )
