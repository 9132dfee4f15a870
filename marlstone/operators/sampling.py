"""Repeatable splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col
from .aggregates import order_statistic


def hash_share(key, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed, whatever the partitioning."""
    digest = F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def train_test_split(df: DataFrame, key: str, split: float = 0.8, seed: int = 10) -> DataFrame:
    """Adds ``split``: train below the fraction, test above."""
    return df.withColumn("split", F.when(hash_share(key, seed) < split, "train").otherwise("test"))


def three_way_split(df: DataFrame, key: str, split: float = 0.8, seed: int = 10) -> DataFrame:
    """Two chained splits: with 0.8 this is 64 % train, 16 % validation, 20 % test."""
    return df.withColumn("split", F.when(hash_share(key, seed) >= split, "test").when(
        hash_share(key, seed + 1) >= split, "validation").otherwise("train"))


def contiguous_split(df: DataFrame, order: str, fraction: float) -> DataFrame:
    """The first ``floor(fraction n)`` rows by a unique order column are train.

    The cut is one order statistic, found without sorting the rows in one task.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # The k-th smallest value lies at quantile (k - 1) / (n - 1).
    position = order_statistic(df, order, F.floor(F.lit(fraction) * n))
    return df.withColumn("split", F.when(F.col(order) <= position, "train").otherwise("validation"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stack_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Concatenate row sets, remembering where each row came from."""
    named = [part.withColumn("split", F.lit(name)) for name, part in parts.items()]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out
