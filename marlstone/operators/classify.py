"""Classifiers: MLlib estimators with the settings this work uses.

Inputs are (features vector, label double) tables.  Fits read a cached table;
scores stay in the rows as arrays, so calibration and open-set decisions are
ordinary column work.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_cut
from .matrix import partition_sums
from .metrics import macro_f1
from .onevsrest import newton


DEEPEST = 30
# Relative change at which a fit ends before its largest number of rounds.
TOLERANCE = 1e-4


class MacroF1(Evaluator):
    """Unweighted mean of the class F1 scores (MLlib's own f1 is weighted)."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self._label, self._prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return macro_f1(dataset, self._label, self._prediction).first()[0] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def random_forest(trees: int = 100, depth: int = DEEPEST, impurity: str = "gini", subset: str = "auto", seed: int = 42) -> RandomForestClassifier:
    """MLlib builds trees of at most ``DEEPEST`` levels; that stands for unbounded depth."""
    if depth > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} levels deep, not {depth}")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, impurity=impurity, featureSubsetStrategy=subset, seed=seed)


def fit_forest(trees: int, df: DataFrame, batch: int = 62, bootstrap: bool = True, seed: int = 42, parallelism: int = 4, **settings) -> list[Model]:
    """A forest fitted ``batch`` trees at a time, ``parallelism`` batches at once; ``summed_votes`` makes one decision of the parts.

    Rows keep the node they are in, so that a level of the trees neither sends all trees to the tasks nor walks them from the root.
    """
    def fit(at: int) -> Model:
        return random_forest(min(batch, trees - at), seed=seed + at, **settings).setBootstrap(bootstrap).setCacheNodeIds(True).fit(df)

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(fit), range(0, trees, batch), chunksize=1)


def summed_votes(models: Sequence[Model], df: DataFrame, name: str = "prediction") -> DataFrame:
    """``df`` with the class that the trees of all ``models`` vote for; the smaller class if votes are equal."""
    raw = [f"_votes{i}" for i in range(len(models))]
    out = df
    for model, votes in zip(models, raw):
        out = model.copy().setRawPredictionCol(votes).setProbabilityCol("").setPredictionCol("").transform(out)
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [vector_to_array(votes) for votes in raw])
    out = out.withColumn("_votes", total)
    return out.withColumn(name, (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")).drop("_votes", *raw)


def l1_logistic(c: float, n: int, max_iter: int = 100) -> LogisticRegression:
    """L1 penalty with inverse strength c over n rows."""
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), maxIter=max_iter, tol=TOLERANCE)


def softmax_regression(strength: float, max_iter: int = 100) -> LogisticRegression:
    """Multinomial output layer with an L2 penalty."""
    return LogisticRegression(family="multinomial", regParam=strength, elasticNetParam=0.0, maxIter=max_iter, tol=TOLERANCE)


def gaussian_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def linear_svm(strength: float = 0.01, max_iter: int = 50) -> LinearSVC:
    """The hinge loss has no smooth minimum, so rounds often run to ``max_iter``; each is a job."""
    return LinearSVC(regParam=strength, maxIter=max_iter, tol=TOLERANCE)


def gaussian_bayes_parameters(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean and population variance of each component per class."""
    rows = df.select(F.col(label).alias("class"), F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return rows.groupBy("class", "i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


class OneVsRestScores:
    """One binary model per class; keeps each class's raw score and probability."""

    def __init__(self, classes: Sequence[int], models: Sequence[Model]):
        self.classes, self.models = list(classes), list(models)

    @classmethod
    def fit(cls, estimator: Estimator, df: DataFrame, classes: Sequence[int], label: str = "label", features: str = "features") -> OneVsRestScores:
        rows = df.select(features, label).persist()
        try:
            models = [estimator.copy({estimator.labelCol: "_is", estimator.featuresCol: features}).fit(
                rows.withColumn("_is", (F.col(label) == c).cast("double"))) for c in classes]
        finally:
            rows.unpersist()
        return cls(classes, models)

    def scores(self, df: DataFrame, keep: Sequence[str], features: str = "features", name: str = "scores") -> DataFrame:
        """Adds ``array<struct<class, score>>`` with each model's raw margin."""
        out, columns = df, []
        for c, model in zip(self.classes, self.models):
            raw = f"_raw{c}"
            mine = model.copy({model.rawPredictionCol: raw, model.predictionCol: f"_pred{c}", model.featuresCol: features})
            if mine.hasParam("probabilityCol"):
                mine.set(mine.probabilityCol, f"_prob{c}")
            out = mine.transform(out)
            columns.append(F.struct(F.lit(c).alias("class"), vector_to_array(raw)[1].alias("score")))
        return out.select(*keep, F.array(*columns).alias(name))


def sigmoid_probabilities(df: DataFrame, name: str = "scores", probs: str = "probs") -> DataFrame:
    """Logistic of each raw score, renormalised over the classes."""
    return _normalised(df.withColumn("_p", F.transform(name, lambda x: F.struct(
        x["class"].alias("class"), (1 / (1 + F.exp(-x["score"]))).alias("p")))), probs).drop(name)


def _normalised(df: DataFrame, probs: str) -> DataFrame:
    total = df.withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x["p"]))
    shared = F.zip_with("_p", F.array_repeat("_sum", F.size("_p")), lambda x, t: F.struct(
        x["class"].alias("class"), F.when(t > 0, x["p"] / t).otherwise(0.0).alias("p")))
    return total.withColumn(probs, shared).drop("_p", "_sum")


class PlattCalibration:
    """A one-dimensional logistic fit per class on held-out raw scores."""

    def __init__(self, parameters: dict[int, tuple[float, float]]):
        self.parameters = parameters
        self.gradient = None            # norms where a fit ended, as shares of those at its start

    @classmethod
    def fit(cls, scored: DataFrame, classes: Sequence[int], label: str = "label", name: str = "scores", tolerance: float = 1e-8,
            max_rounds: int = 100) -> PlattCalibration:
        """All classes in the same passes.  The targets are Platt's, (p + 1) / (p + 2) and 1 / (n + 2) for p rows of the class and n
        others, so separable scores have a finite fit.  A row without a class's score does not count for that class."""
        of = F.map_from_entries(F.transform(name, lambda x: F.struct(x["class"], x["score"])))
        rows = write_cut(scored.where(F.col(label).isNotNull()).select(
            F.transform(F.array(*[F.try_element_at(of, F.lit(c)) for c in classes]), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("x"),
            F.array(F.col(label).cast("double")).alias("y")), "calibration")
        names, k = np.array(classes, float), len(classes)

        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            there = ~np.isnan(x)
            return np.concatenate([(there & (y == names)).sum(axis=0), there.sum(axis=0)]).astype(float)

        counts = partition_sums(rows, "x", ["y"], count)
        if not len(counts):
            return cls({c: (0.0, 0.0) for c in classes})
        own, every = np.split(counts, 2)
        high, low = (own + 1) / (own + 2), 1 / (every - own + 2)

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            def fn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                there = ~np.isnan(x)
                x = np.where(there, x, 0.0)
                z = x * w[:, 0] + w[:, 1]
                target, p = np.where(y == names, high, low), 0.5 * (1 + np.tanh(z / 2))
                terms = [np.logaddexp(0, z) - target * z, (p - target) * x, p - target, p * (1 - p) * x * x, p * (1 - p) * x, p * (1 - p)]
                return np.concatenate([(t * there).sum(axis=0) for t in terms])

            value, gx, g1, hxx, hx, h1 = np.split(partition_sums(rows, "x", ["y"], fn), 6)
            return value, np.column_stack([gx, g1]), np.stack([np.column_stack([hxx, hx]), np.column_stack([hx, h1])], axis=1)

        w, gradient, _ = newton(sums, np.zeros((k, 2)), tolerance, max_rounds)
        found = cls({c: (float(a), float(b)) for c, (a, b) in zip(classes, w)})
        found.gradient = gradient
        return found

    def apply(self, scored: DataFrame, name: str = "scores", probs: str = "probs") -> DataFrame:
        slope = F.create_map(*[F.lit(v) for c, (a, _) in self.parameters.items() for v in (c, a)])
        shift = F.create_map(*[F.lit(v) for c, (_, b) in self.parameters.items() for v in (c, b)])
        p = F.transform(name, lambda x: F.struct(x["class"].alias("class"), (1 / (1 + F.exp(
            -(x["score"] * F.element_at(slope, x["class"]) + F.element_at(shift, x["class"]))))).alias("p")))
        return _normalised(scored.withColumn("_p", p), probs).drop(name)


def argmax_class(probs: str = "probs"):
    """The class with the largest probability (ties: larger id)."""
    return F.array_max(F.transform(probs, lambda x: F.struct(x["p"], x["class"])))["class"]


def grid_search(estimator: Estimator, grid: dict, df: DataFrame, folds: int = 3, parallelism: int = 4, seed: int = 0):
    """Cross-validated search for the best macro F1; returns the fitted search."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=MacroF1(), numFolds=folds,
                          parallelism=parallelism, seed=seed).fit(df)


def random_search(estimator: Estimator, space: dict[str, Sequence], trials: int, df: DataFrame, seed: int = 0, train_ratio: float = 0.75):
    """Distinct random draws from a parameter space, judged on one held-out part."""
    import random

    rng, maps, seen = random.Random(seed), [], set()
    limit = 1
    for values in space.values():
        limit *= len(values)
    while len(maps) < min(trials, limit):
        draw = {p: rng.choice(list(v)) for p, v in space.items()}
        if (mark := tuple(draw.items())) not in seen:
            seen.add(mark)
            maps.append({estimator.getParam(p): v for p, v in draw.items()})
    return TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=MacroF1(), trainRatio=train_ratio,
                                parallelism=4, seed=seed).fit(df)


def score_submission(model: Model | Sequence[Model], df: DataFrame, key: str, name: str = "is_duplicate") -> DataFrame:
    """(key, label) rows ready to be written, by one model or by a forest in parts."""
    decided = model.transform(df) if isinstance(model, Model) else summed_votes(model, df)
    return decided.select(key, F.col("prediction").cast("int").alias(name))


def search_table(spark, maps: Iterable[dict], scores: Iterable[float]) -> DataFrame:
    """Tried settings and their score, one row each."""
    rows = [(", ".join(sorted(f"{p.name}={v}" for p, v in m.items())), float(s)) for m, s in zip(maps, scores)]
    return spark.createDataFrame(rows, "setting string, score double").orderBy(F.desc("score"), "setting")
