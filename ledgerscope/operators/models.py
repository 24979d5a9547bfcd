"""Training and scoring jobs on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import constants as C
from ledgerscope.operators.committee import (
    average_precision,
    input_dropout,
    meta_vector_columns,
    scorer_columns,
)
from ledgerscope.operators.rules import session_missing_flag


def split(
    df: DataFrame, weights: list[float], key: str, seed: int = 42, stratify: str | None = None
) -> list[DataFrame]:
    """Disjoint parts by a hash of the key, so a row's part never changes.

    With ``stratify`` the hash is taken per label, which keeps the label shares in
    expectation; no row is moved or counted.
    """
    salt = [F.col(stratify)] if stratify else []
    bucket = F.pmod(F.xxhash64(F.col(key), *salt, F.lit(seed)), F.lit(10_000)) / 10_000.0
    total, low, parts = sum(weights), 0.0, []
    for i, w in enumerate(weights):
        high = 1.0 if i == len(weights) - 1 else low + w / total
        parts.append(df.filter((bucket >= low) & (bucket < high)))
        low = high
    return parts


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Weight of a positive row: floor(negatives / positives), at least 1."""
    row = df.agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n")
    ).first()
    weight = max(1, row["n"] // row["p"]) if row["p"] else 1
    return df.withColumn("__weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.fillna(0.0, features)


def _probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def train_base(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    depth: int = 7,
    rounds: int = 400,
    step: float = 0.05,
    seed: int = 42,
) -> PipelineModel:
    """Weighted boosted trees."""
    trees = GBTClassifier(
        labelCol=label, weightCol="__weight", maxDepth=depth, maxIter=rounds, stepSize=step,
        subsamplingRate=0.85, minInstancesPerNode=3, seed=seed,
    )
    return Pipeline(stages=[_assembler(features), trees]).fit(_weighted(_filled(df, features), label))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "raw") -> DataFrame:
    scored = model.transform(_filled(df, features)).withColumn(name, _probability())
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def calibrate(scores: DataFrame, raw: str = "raw", label: str = "label") -> LogisticRegressionModel:
    """Sigmoid of the raw score fitted on rows the trees have not seen."""
    one = VectorAssembler(inputCols=[raw], outputCol="__raw").transform(scores)
    return LogisticRegression(featuresCol="__raw", labelCol=label, regParam=0.0).fit(one)


def apply_calibration(
    scores: DataFrame, model: LogisticRegressionModel, raw: str = "raw", name: str = "score"
) -> DataFrame:
    """The sigmoid as a plain expression: two numbers, no vectors per row."""
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    return scores.withColumn(name, 1.0 / (1.0 + F.exp(-(F.col(raw) * slope + intercept))))


@dataclass
class Calibrated:
    """A classifier with the sigmoid fitted on its validation part."""

    base: PipelineModel
    sigmoid: LogisticRegressionModel
    features: list[str]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        raw = predict(self.base, df, self.features, "__p")
        return apply_calibration(raw, self.sigmoid, "__p", name).drop("__p")


def train_calibrated(
    df: DataFrame, features: list[str], key: str, label: str = "label", stratify: bool = False, **options
) -> Calibrated:
    """Base model on 60 % and sigmoid on 20 % of the rows; 20 % stay for thresholds."""
    train, validation, _test = split(df, [0.6, 0.2, 0.2], key, stratify=label if stratify else None)
    base = train_base(train, features, label, **options)
    return Calibrated(base, calibrate(predict(base, validation, features), label=label), features)


def scorer_a(df: DataFrame, model: Calibrated) -> DataFrame:
    """Boosted-tree scorer; missing when more than one session feature is null."""
    scored = model.score(df, "__a")
    present = [c for c in C.SESSION_FEATURES if c in df.columns]
    missing = session_missing_flag() if len(present) == len(C.SESSION_FEATURES) else F.lit(True)
    return scorer_columns(scored, "a", "__a", missing).drop("__a")


SCORER_B_INPUTS = C.EMBEDDING_FEATURES + C.STRUCTURAL_FEATURES


def scorer_b_inputs(embeddings: DataFrame, features: DataFrame) -> DataFrame:
    """Embedding and eight structural columns side by side."""
    emb = embeddings.select(
        "account_id",
        "missing_flag",
        *[F.col("embedding")[i].cast("double").alias(f"emb_{i}") for i in range(32)],
    )
    return emb.join(features.select("account_id", *C.STRUCTURAL_FEATURES), "account_id", "left")


def train_scorer_b(df: DataFrame, label: str = "label", seed: int = 42, rounds: int = 100) -> PipelineModel:
    """Standardised inputs into a perceptron with hidden layers of 64 and 32."""
    stages = [
        _assembler(SCORER_B_INPUTS).setOutputCol("__raw"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
        MultilayerPerceptronClassifier(
            labelCol=label, layers=[len(SCORER_B_INPUTS), 64, 32, 2], maxIter=rounds, seed=seed
        ),
    ]
    return Pipeline(stages=stages).fit(_filled(df, SCORER_B_INPUTS))


def scorer_b(df: DataFrame, model: PipelineModel) -> DataFrame:
    scored = predict(model, df, SCORER_B_INPUTS, "__b").drop("__raw")
    return scorer_columns(scored, "b", "__b", F.col("missing_flag")).drop("__b")


def train_scorer_d(
    df: DataFrame, key: str, label: str = "label", trees: int = 100, depth: int = 8, seed: int = 42
) -> Calibrated:
    """Weighted forest on the seven set features, sigmoid on 20 % of the rows."""
    rows = df.filter(F.col(C.SET_FEATURES[0]).isNotNull())
    train, validation = split(rows, [0.8, 0.2], key, seed, stratify=label)
    forest = RandomForestClassifier(
        labelCol=label, weightCol="__weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    base = Pipeline(stages=[_assembler(C.SET_FEATURES), forest]).fit(
        _weighted(_filled(train, C.SET_FEATURES), label)
    )
    sigmoid = calibrate(predict(base, validation, C.SET_FEATURES), label=label)
    return Calibrated(base, sigmoid, C.SET_FEATURES)


def scorer_d(df: DataFrame, model: Calibrated) -> DataFrame:
    """Forest scorer; accounts with too little history have null features and are missing."""
    missing = F.col(C.SET_FEATURES[0]).isNull()
    marked = df.withColumn("__missing", missing)
    scored = scorer_columns(model.score(marked, "__d"), "d", "__d", F.col("__missing"))
    return (
        scored.withColumn("scorer_d_score", F.when(F.col("__missing"), 0.5).otherwise(F.col("scorer_d_score")))
        .withColumn("scorer_d_confidence", F.when(F.col("__missing"), 0.0).otherwise(F.col("scorer_d_confidence")))
        .drop("__d", "__missing")
    )


def text_vectors(df: DataFrame, text: str, dim: int = 256) -> DataFrame:
    """Default remark vectors: hashed words weighted by rarity.  Adds ``vector``."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern="\\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim),
        IDF(inputCol="__tf", outputCol="__idf"),
    ]
    rows = df.withColumn(text, F.coalesce(text, F.lit("")))
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.withColumn("vector", vector_to_array("__idf")).drop("__words", "__tf", "__idf")


def train_meta(
    df: DataFrame, key: str, label: str = "label", min_rows: int = 10_000, min_positives: int = 50,
    seed: int = 42, rounds: int = 100,
) -> tuple[PipelineModel, DataFrame]:
    """Linear model against depth-3 trees on 20 inputs; the better PR-AUC wins.

    Returns the winner and a one-row run record.  One scorer is blanked in 15 % of
    the training rows.
    """
    counted = df.filter(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")
    ).first()
    if counted["n"] < min_rows or (counted["p"] or 0) < min_positives:
        raise ValueError(
            f"meta-learner needs {min_rows} rows and {min_positives} positives, "
            f"got {counted['n']} and {counted['p'] or 0}"
        )
    names = list(meta_vector_columns())

    def inputs(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.col(label), *[c.alias(n) for n, c in meta_vector_columns().items()])

    dropped = input_dropout(df.filter(F.col(label).isNotNull()), key, seed=seed)
    train, validation = split(inputs(dropped), [0.8, 0.2], key, seed, stratify=label)
    balanced = _weighted(train, label)
    linear = Pipeline(
        stages=[
            _assembler(names),
            LogisticRegression(labelCol=label, weightCol="__weight", regParam=1e-4, maxIter=200),
        ]
    ).fit(balanced)
    trees = Pipeline(
        stages=[
            _assembler(names),
            GBTClassifier(labelCol=label, weightCol="__weight", maxDepth=3, maxIter=rounds, stepSize=0.05, seed=seed),
        ]
    ).fit(balanced)
    quality = {}
    for name, model in (("logistic_regression", linear), ("trees_depth3", trees)):
        scored = predict(model, validation, names, "score")
        quality[name] = average_precision(scored, "score", label).first()[0]
    winner = "trees_depth3" if quality["trees_depth3"] >= quality["logistic_regression"] else "logistic_regression"
    record = df.sparkSession.createDataFrame(
        [(winner, int(counted["n"]), int(counted["p"]), *[float(quality[k]) for k in sorted(quality)])],
        "algorithm string, row_count long, positives long, "
        + ", ".join(f"pr_auc_{k} double" for k in sorted(quality)),
    )
    return (trees if winner == "trees_depth3" else linear), record


def meta_score(df: DataFrame, model: PipelineModel) -> DataFrame:
    names = list(meta_vector_columns())
    rows = df.select("*", *[c.alias(n) for n, c in meta_vector_columns().items()])
    return predict(model, rows, names, "meta_score").drop(*names)


def linear_contributions(
    df: DataFrame, model: PipelineModel, features: list[str], key: str, label_free_mean: DataFrame | None = None
) -> DataFrame:
    """Signed share of each feature in the log-odds: ``coef * (x - mean)``, long form."""
    coefficients = [float(c) for c in model.stages[-1].coefficients]
    base = df if label_free_mean is None else label_free_mean
    means = base.agg(*[F.avg(f).alias(f) for f in features]).first()
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            ((F.coalesce(F.col(f), F.lit(0.0)) - float(means[f] or 0.0)) * c).alias("contribution"),
        )
        for f, c in zip(features, coefficients)
    ]
    return df.select(key, F.explode(F.array(*parts)).alias("c")).select(key, "c.*")
