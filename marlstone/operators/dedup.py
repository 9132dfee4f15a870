"""Keyed de-duplication and insert-if-absent.

No windows: a window would bring all copies of one text to one task.  The
groupings below combine copies on the map side first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_all_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only rows whose key occurs once (every copy of a repeated key goes)."""
    others = [c for c in df.columns if c not in keys]
    row = [F.any_value(F.struct(*others)).alias("_row")] if others else []
    kept = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *row).filter("_n = 1")
    return kept.select(*keys, *(["_row.*"] if others else [])).select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key; ``order`` is the arrival order.

    The key is not carried a second time inside the kept row.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def insert_if_absent(new: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str],
                     error_column: str | None = None, error_value: str = "Data Error") -> DataFrame:
    """Rows of ``new`` to append: no error rows, first of each key, key not in ``target``."""
    if error_column is not None:
        new = new.filter(~F.col(error_column).eqNullSafe(F.lit(error_value)))
    return first_wins(new, keys, order).join(target.select(*keys), list(keys), "left_anti").select(*new.columns)


def word_owner_counts(words: DataFrame, word: str, owner: str, order: Sequence[str]) -> DataFrame:
    """Running word counts with an owner: (word, owner, count).

    The first row holding a word fixes its owner; later rows count only when
    they come from the same owner.  Counting per (word, owner) first leaves one
    row per pair, and the earliest pair of each word is the answer, so nothing
    is joined back.
    """
    # A single column keeps the counting a hash aggregation; a struct would sort.
    arrival = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    pairs = words.groupBy(word, owner).agg(F.count(F.lit(1)).alias("_n"), F.min(arrival).alias("_first"))
    return pairs.groupBy(word).agg(
        F.min_by(F.struct(owner, F.col("_n").alias("count")), F.struct("_first", owner)).alias("_o")).select(word, "_o.*")
