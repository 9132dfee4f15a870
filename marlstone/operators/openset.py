"""Open-set decisions on class probabilities.

A row carries its probabilities as ``array<struct<class, p>>``.  Statistics
per class are taken from the exploded form (class is the only key, combined
partially); their results are k numbers, handed back to every task as one
scalar-subquery map, so scaling and deciding are projections without a join or
a shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col
from .aggregates import exact_quantiles


def seen_only(df: DataFrame, label: str, unseen: Sequence[int]) -> DataFrame:
    return df.filter(~F.col(label).isin(*unseen))


def relabel_unseen(label, unseen: Sequence[int]) -> Column:
    return F.when(_col(label).isin(*unseen), F.lit(0)).otherwise(_col(label))


def long_probabilities(df: DataFrame, probs: str = "probs", *keep: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(probs).alias("_x")).filter("_x IS NOT NULL").select(*keep, "_x.class", "_x.p")


def class_ranges(df: DataFrame, probs: str = "probs") -> DataFrame:
    return long_probabilities(df, probs).groupBy("class").agg(
        F.max("p").alias("max_p"), F.min("p").alias("min_p"), (F.max("p") - F.min("p")).alias("range_p"))


def _as_map(table: DataFrame, value: str) -> Column:
    """(class, value) rows as one map; there is one entry per class."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct("class", value))).alias("m")).scalar()


def scale_class_probs(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Divide each class's probabilities by their range over the scored rows."""
    with_ranges = df.withColumn("_ranges", _as_map(class_ranges(df, probs), "range_p"))
    return with_ranges.withColumn(probs, F.transform(probs, lambda x: F.struct(
        x["class"].alias("class"), F.try_divide(x["p"], F.try_element_at("_ranges", x["class"])).alias("p")))).drop("_ranges")


def class_thresholds(df: DataFrame, percentiles: Sequence[float], probs: str = "probs") -> DataFrame:
    """(class, q, quantile) at percentiles given in 0..100."""
    return exact_quantiles(long_probabilities(df, probs), ["class"], "p", [p / 100.0 for p in percentiles])


def decide(probs, thresholds: Column, rule: str = "max_label") -> Column:
    """Label from the classes at or above their threshold; none gives 0.

    ``max_label`` takes the largest class id, ``argmax`` the largest
    probability (ties: larger id).
    """
    kept = F.filter(_col(probs), lambda x: (x["p"] > 0) & (x["p"] >= F.try_element_at(thresholds, x["class"])))
    if rule == "max_label":
        best = F.array_max(F.transform(kept, lambda x: x["class"]))
    elif rule == "argmax":
        best = F.array_max(F.transform(kept, lambda x: F.struct(x["p"], x["class"])))["class"]
    else:
        raise ValueError(f"unknown rule {rule}")
    return F.coalesce(best, F.lit(0))


def open_set_predict(df: DataFrame, percentile: float, rule: str = "max_label", probs: str = "probs",
                     name: str = "prediction") -> DataFrame:
    """Decide with thresholds taken from the scored rows themselves."""
    thresholds = _as_map(class_thresholds(df, [percentile], probs), "quantile")
    return df.withColumn("_t", thresholds).withColumn(name, decide(probs, F.col("_t"), rule)).drop("_t")


def threshold_sweep(df: DataFrame, label: str, low: int = 50, high: int = 95, max_ratio: float = 1.1,
                    rule: str = "argmax", probs: str = "probs") -> DataFrame:
    """Unseen-class scores at every percentile in [low, high), in one pass.

    All thresholds come from one quantile job; each row is then decided at each
    of them and counted per percentile before anything is shuffled.  A
    percentile where a score is undefined keeps nulls; ``eligible`` marks those
    whose predicted/actual ratio is below ``max_ratio``.
    """
    percentiles = list(range(low, high))
    table = class_thresholds(df, percentiles, probs).withColumn("threshold", F.round(F.col("q") * 100).cast("int"))
    per_q = table.groupBy("threshold").agg(F.map_from_entries(F.collect_list(F.struct("class", "quantile"))).alias("m"))
    every = per_q.agg(F.collect_list(F.struct("threshold", "m")).alias("t")).scalar()
    tried = df.select(F.col(label).alias("_label"), F.col(probs).alias("_probs"), F.explode(every).alias("t"))
    decided = tried.select("t.threshold", "_label", decide("_probs", F.col("t.m"), rule).alias("_pred"))
    return decided.groupBy("threshold").agg(*unseen_counts("_label", "_pred")).select(
        "threshold", "tp", "fp", "fn", *unseen_scores(),
        F.try_divide(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("ratio")).withColumn(
        "eligible", F.when(F.col("f1").isNotNull() & (F.col("ratio") < max_ratio), 1).otherwise(0))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The eligible percentile with the best F1 (ties: the lowest)."""
    return sweep.filter("eligible = 1 AND f1 > 0").orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def unseen_counts(label: str, prediction: str) -> list[Column]:
    """True and false positives and false negatives of the unseen class 0."""
    t, p = F.col(label) == 0, F.col(prediction) == 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return [count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & (F.col(prediction) > 0)).alias("fn")]


def unseen_scores() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def centroid_scores(df: DataFrame, key: str, label: str, vec: str, centroids: DataFrame, sharpness: float = 1.0) -> DataFrame:
    """A simple closed-form scorer: softmax of minus the squared distance to each
    class centroid.  ``centroids`` is (class, centroid), one row per class."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("class", "centroid"))).alias("c")).scalar()
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    weights = F.transform("_c", lambda c: F.struct(c["class"].alias("class"), F.exp(-sharpness * F.aggregate(
        F.zip_with(F.col("_v"), c["centroid"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("e")))
    scored = df.select(key, label, v.alias("_v"), table.alias("_c")).withColumn("_w", weights)
    scored = scored.withColumn("_total", F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["e"]))
    return scored.select(key, label, F.transform("_w", lambda x: F.struct(
        x["class"].alias("class"), (x["e"] / F.col("_total")).alias("p"))).alias("probs"))


def class_centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector per class: sums per (class, component) combine before the shuffle."""
    parts = df.select(F.col(label).alias("class"), F.posexplode(vec).alias("_i", "_x"))
    means = parts.groupBy("class", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))
