"""Text corpora: word lists, labelled subsets, plain-text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import hash_share


def words_of_lines(lines: DataFrame, sep: str = " ", column: str = "value") -> DataFrame:
    """Distinct lower-cased words of text lines, split at ``sep``."""
    pieces = F.split(F.trim(F.lower(column)), "\\Q" + sep + "\\E")
    return lines.select(F.explode(pieces).alias("word")).distinct()


def read_word_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return words_of_lines(spark.read.text(path), sep)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """A short name list (one per line) as Python strings."""
    return [r.value for r in spark.read.text(path).collect() if r.value]


def labelled_subset(df: DataFrame, label: str, categories: Sequence[str] | None = None, name: str = "target") -> DataFrame:
    """Rows of the given categories with labels renumbered 0..k-1 in sorted order."""
    if categories is not None:
        df = df.filter(F.col(label).isin(*categories))
        order = sorted(set(categories))
        return df.withColumn(name, (F.array_position(F.array(*[F.lit(c) for c in order]), F.col(label)) - 1).cast("int"))
    # The distinct labels, one row each, give every label its number.
    labels = df.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("l")).scalar()
    return df.withColumn(name, (F.array_position(labels, F.col(label)) - 1).cast("int"))


def random_classes(df: DataFrame, label: str, k: int, seed: int) -> DataFrame:
    """k classes drawn by hash order: the same for the same seed."""
    return df.select(F.col(label).alias("class")).distinct().orderBy(hash_share("class", seed), "class").limit(k)


def page_cursors(df: DataFrame, page: str, record_id: str) -> DataFrame:
    """Count, smallest and largest id per page; the next page starts at the smallest."""
    return df.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min(record_id).alias("min_id"), F.max(record_id).alias("max_id"))


def next_page(df: DataFrame, record_id: str, max_id: int, size: int) -> DataFrame:
    """The page of the ``size`` newest records at or below ``max_id``."""
    return df.filter(F.col(record_id) <= max_id).orderBy(F.desc(record_id)).limit(size)


def merge_pages(*pages: DataFrame, record_id: str = "id") -> DataFrame:
    """All pages; a page starts with the last record of the one before, so ids are made unique."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.dropDuplicates([record_id])


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    """One cleaned document per line."""
    df.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")
