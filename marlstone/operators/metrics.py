"""Classification and clustering metrics from grouped counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_cut
from .openset import unseen_counts, unseen_scores


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, in one grouping.

    Each row counts once for its true class and once for its predicted class.
    """
    hit = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    roles = df.select(F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("true"), F.lit(0).alias("pred"), hit.alias("tp")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).alias("true"), F.lit(1).alias("pred"), F.lit(0).alias("tp")))).alias("r"))
    sums = roles.select("r.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("true", "pred", "tp")])
    precision = F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "true"), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"),
                       F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
                       F.col("true").alias("support"))


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a report."""
    w = F.col("support")
    return report.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
                      *[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
                      F.sum(w).alias("support"))


def macro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return classification_report(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def log_loss(df: DataFrame, probability_of_label: Column, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(probability_of_label, F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.log(p))).alias("log_loss"))


def unseen_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(*unseen_counts(label, prediction)).select("tp", "fp", "fn", *unseen_scores())


def unseen_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of truly unseen rows (label 0) predicted unseen."""
    return df.filter(F.col(label) == 0).agg(
        F.count(F.lit(1)).alias("n_unseen"), F.avg(F.when(F.col(prediction) == 0, 1.0).otherwise(0.0)).alias("accuracy"))


def cluster_agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Homogeneity, completeness, V-measure, adjusted Rand and Fowlkes-Mallows.

    All five need only sums over the contingency table, its margins and its
    total, which one cube over the (small) contingency table gives.
    """
    cells = df.groupBy(F.col(label).alias("_l"), F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    margins = cells.cube("_l", "_c").agg(F.sum("_n").alias("m"), F.grouping_id().alias("g")).withColumn("m", F.col("m").cast("double"))

    def total(level: int, value: Column) -> Column:
        return F.sum(F.when(F.col("g") == level, value))

    m = F.col("m")
    sums = margins.agg(
        total(3, m).alias("n"),
        *[total(g, m * F.log(m)).alias(f"e{g}") for g in (0, 1, 2)],
        *[total(g, m * (m - 1) / 2).alias(f"p{g}") for g in (0, 1, 2)])
    n, log_n = F.col("n"), F.log("n")
    h_label, h_cluster, h_both = (log_n - F.col(e) / n for e in ("e1", "e2", "e0"))
    mutual = h_label + h_cluster - h_both
    eps = 1e-12
    step = sums.select("*", F.when(h_label > eps, mutual / h_label).otherwise(1.0).alias("homogeneity"),
                       F.when(h_cluster > eps, mutual / h_cluster).otherwise(1.0).alias("completeness"))
    h, c = F.col("homogeneity"), F.col("completeness")
    pairs = n * (n - 1) / 2
    expected = F.try_divide(F.col("p1") * F.col("p2"), pairs)
    best = (F.col("p1") + F.col("p2")) / 2
    return step.select(
        "homogeneity", "completeness",
        F.when(h + c > eps, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"),
        F.when(best == expected, 1.0).otherwise((F.col("p0") - expected) / (best - expected)).alias("adjusted_rand"),
        F.coalesce(F.try_divide("p0", F.sqrt(F.col("p1") * F.col("p2"))), F.lit(0.0)).alias("fowlkes_mallows"))


def silhouette(df: DataFrame, features: str, cluster: str) -> float:
    """Mean silhouette over all rows (squared Euclidean, linear in the rows)."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster, metricName="silhouette").evaluate(df)


def silhouette_sample(df: DataFrame, key: str, features: str, cluster: str, size: int = 1000, seed: int = 0) -> DataFrame:
    """(key, cluster, silhouette) of ``size`` rows picked by a hash of the key: Euclidean distances, exact within the sample.

    A sampling operator: ``size`` bounds what goes to the tasks, and each task
    compares its rows with all of the sample in one block.  The only row of a
    cluster has 0, as has every row when there is one cluster; rows without a
    cluster or features are not picked.
    """
    usable = df.filter(F.col(features).isNotNull() & F.col(cluster).isNotNull())
    picked = write_cut(usable.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(features).cast("array<double>").alias("x"))
                       .orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), "key").limit(size), "sample")
    rows = picked.collect()          # size rows at most
    classes = {c: i for i, c in enumerate(sorted({r["cluster"] for r in rows}))}
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["x"] for r in rows]), np.array([classes[r["cluster"]] for r in rows]), classes))

    @F.pandas_udf("double")
    def width(x: pd.Series, of: pd.Series) -> pd.Series:
        points, label, classes = shared.value
        if not len(x) or len(classes) < 2:
            return pd.Series(np.zeros(len(x)))
        # Differences, not products of norms: near points keep all their digits.
        distance = np.stack([np.sqrt(((points - np.asarray(v)) ** 2).sum(axis=1)) for v in x])
        sums = np.stack([distance[:, label == c].sum(axis=1) for c in range(len(classes))], axis=1)
        sizes = np.bincount(label, minlength=len(classes))
        own = of.map(classes).to_numpy()
        at = np.arange(len(x))
        inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[at, own] = np.inf
        outside = means.min(axis=1)
        larger = np.maximum(inside, outside)
        return pd.Series(np.where((sizes[own] == 1) | (larger == 0), 0.0, (outside - inside) / np.where(larger == 0, 1.0, larger)))

    return picked.select(F.col("key").alias(key), F.col("cluster").alias(cluster), width("x", "cluster").alias("silhouette"))
