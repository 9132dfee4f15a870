"""Vocabularies and token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import UNKNOWN
from .aggregates import top_rows
from .blocks import look_up
from .ordering import in_order

# The first three ids.
SPECIAL_WORDS = ("<s>", "</s>", UNKNOWN)
START_ID, END_ID, UNKNOWN_ID = 0, 1, 2


def word_counts(df: DataFrame, tokens: Column | str, word: str = "word") -> DataFrame:
    """Occurrences of each token over the whole table."""
    return df.select(F.explode_outer(tokens).alias(word)).filter(F.col(word).isNotNull()).groupBy(word).agg(F.count(F.lit(1)).alias("count"))


def rank_words(counts: DataFrame, first: int = 0) -> DataFrame:
    """Adds ``id`` (long): position by count (descending) then word.

    Words are dealt into sampled ranges of (count, word) and numbered inside
    them, so the huge group of words seen once is no task of its own.
    """
    placed = in_order(counts, [], [F.col("count").desc(), F.col("word")])
    return placed.select("word", (F.col("_before") + first).alias("id"), "count")


def vocabulary(counts: DataFrame, size: int | None = None) -> DataFrame:
    """(word, id, count): three special words, then the most frequent words.

    With a size, the top words are a bounded top-N and are numbered among
    themselves; without one every word is numbered by ``rank_words``.
    """
    special = counts.sparkSession.createDataFrame(
        [(w, i, 0) for i, w in enumerate(SPECIAL_WORDS)], "word string, id long, count long")
    real = counts.filter(~F.col("word").isin(*SPECIAL_WORDS))
    if size is None:
        ranked = rank_words(real, len(SPECIAL_WORDS))
    else:
        top = top_rows(real, max(size - len(SPECIAL_WORDS), 0))
        order = W.orderBy(F.col("count").desc(), F.col("word"))
        ranked = top.select("word", (F.row_number().over(order) + len(SPECIAL_WORDS) - 1).cast("long").alias("id"), "count")
    return special.unionByName(ranked.select("word", "id", "count"))


def words_to_ids(df: DataFrame, keys: list[str], tokens: str, vocab: DataFrame, name: str = "ids") -> DataFrame:
    """Token arrays to id arrays; a word outside the vocabulary is unknown."""
    return look_up(df, keys, tokens, vocab, "word", F.coalesce("id", F.lit(UNKNOWN_ID).cast("long")), name, keep=True, missing=UNKNOWN_ID)


def ids_to_words(df: DataFrame, keys: list[str], ids: str, vocab: DataFrame, name: str = "words") -> DataFrame:
    return look_up(df, keys, ids, vocab, "id", F.col("word"), name)


def sentence_to_ids(df: DataFrame, keys: list[str], tokens: str, vocab: DataFrame, name: str = "ids") -> DataFrame:
    """Ids with the start id in front and the end id behind."""
    plain = words_to_ids(df, keys, tokens, vocab, name)
    return plain.withColumn(name, F.concat(F.array(F.lit(START_ID).cast("long")), F.col(name), F.array(F.lit(END_ID).cast("long"))))


def ordered_words(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("id").select("word")


def sentence_boundaries(tokens: Column | str, end: bool = True) -> Column:
    """Tokens between sentence markers; without ``end`` only the separator."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    parts = [F.array(F.lit(SPECIAL_WORDS[0])), t] + ([F.array(F.lit(SPECIAL_WORDS[1]))] if end else [])
    return F.concat(*parts)
