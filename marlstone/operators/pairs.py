"""Features of text pairs: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import _col, pair_tokens
from ..session import single_row

SCALED_COLUMNS = ("q1_length", "q2_length", "q1_numwords", "q2_numwords", "shared_words_norm", "avg_similarity")


def word_count(c) -> Column:
    return F.size(F.split(_col(c), " "))


def combine_pair(a, b) -> Column:
    return F.concat_ws(" ", _col(a), _col(b))


def pair_features(df: DataFrame, a: str = "question1", b: str = "question2", keep_scores: bool = False) -> DataFrame:
    """Lengths, word counts, shared words and the mean set similarity of each pair."""
    tokens = df.withColumn("_a", pair_tokens(a)).withColumn("_b", pair_tokens(b))
    scored = tokens.select(
        "*", F.length(a).alias("q1_length"), F.length(b).alias("q2_length"),
        word_count(a).alias("q1_numwords"), word_count(b).alias("q2_numwords"),
        sim.ochiai("_a", "_b").alias("ochiai"), sim.jaccard("_a", "_b").alias("jaccard"),
        sim.overlap("_a", "_b").alias("overlap"), sim.shared_words("_a", "_b").alias("shared_words_norm"))
    out = scored.withColumn("avg_similarity", (F.col("jaccard") + F.col("overlap") + F.col("ochiai")) / 3.0).drop("_a", "_b")
    return out if keep_scores else out.drop("ochiai", "jaccard", "overlap")


def min_max_scale(df: DataFrame, columns, low: Column | float = 0.0, high: Column | float = 1.0,
                  fitted_on: DataFrame | None = None) -> DataFrame:
    """Scale columns into [low, high] by the minimum and maximum of ``fitted_on``.

    Fit once on the training rows and pass them for every other set.  The
    extremes are a scalar subquery: one row, no join.
    """
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    source = df if fitted_on is None else fitted_on
    seen = single_row(source.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]))
    scaled = {}
    for c in columns:
        lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
        span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        scaled[c] = (F.col(c) - lo) / span * (high - low) + low
    return df.withColumns(scaled)


def vector_range(vectors: DataFrame, vec: str = "vec", digits: int = 2) -> Column:
    """Smallest and largest component over the table, rounded, as one struct."""
    return single_row(vectors.agg(F.round(F.min(F.array_min(vec)), digits).alias("low"),
                                  F.round(F.max(F.array_max(vec)), digits).alias("high")))
