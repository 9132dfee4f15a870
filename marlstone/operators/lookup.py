"""Token look-ups against tables.

Replacements go by blocks of rows (``blocks``): a block gets the entries its
tokens need, the tokens stay in their row.  The others are an equi join on the
token; tokens travel with their position and are put back per row key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, canonical_digits, tokenize
from .blocks import apart, held, look_up, looked_up, values_of


def positions(df: DataFrame, keys: list[str], tokens: str, word: str = "word") -> DataFrame:
    """One row per token: (keys, pos, word), pos from 0.

    The outer form keeps the optimiser from inferring a filter on the array,
    which would tokenise every text a second time.
    """
    return df.select(*keys, F.posexplode_outer(tokens).alias("pos", word)).filter("pos IS NOT NULL")


def regroup(df: DataFrame, keys: list[str], value: Column | str, name: str) -> DataFrame:
    """Values back to one array per key, in position order."""
    value = F.col(value) if isinstance(value, str) else value
    items = F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("v"))))
    return df.groupBy(*keys).agg(items.getField("v").alias(name))


def remove_words(df: DataFrame, keys: list[str], tokens: str, stopwords: DataFrame, word: str = "word") -> DataFrame:
    """Drop tokens found in a stop-word table of any size (case-insensitive)."""
    rows = positions(df, keys, tokens, "_t").withColumn("_w", F.lower("_t"))
    table = stopwords.select(F.lower(F.col(word)).alias("_w")).distinct()
    kept = regroup(rows.join(table, "_w", "left_anti"), keys, "_t", tokens)
    gone = df.join(kept, keys, "left_anti").select(*keys, F.array().cast("array<string>").alias(tokens))
    return kept.unionByName(gone)


def replace_tokens(df: DataFrame, keys: list[str], tokens: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """Replace each token found in ``table[source]`` by ``table[target]``."""
    return look_up(df, keys, tokens, table, source, F.coalesce(target, source), tokens, keep=True, empty=True)


def consolidate_by_table(df: DataFrame, keys: list[str], text: str, variants: DataFrame, variant: str = "variant", canonical: str = "canonical") -> DataFrame:
    """Variants of words to their canonical form by a table of any size: (keys, text).

    The form of ``text.consolidate_words`` for tables that do not fit into a
    plan.  A variant listed twice takes its smallest form; ``keys`` identify a
    row, a null text has no words.
    """
    tokens = df.select(*keys, F.coalesce(tokenize(text), F.array().cast("array<string>")).alias("_tokens"))
    table = variants.filter(F.col(variant).isNotNull()).groupBy(variant).agg(F.min(canonical).alias(canonical))
    return replace_tokens(tokens, keys, "_tokens", table, variant, canonical).select(*keys, F.array_join("_tokens", " ").alias(text))


def lemmatize(df: DataFrame, keys: list[str], text: str, lemmas: DataFrame, tag: str = "n") -> DataFrame:
    """Lemma of every token by a (word, tag, lemma) table, noun unless told otherwise."""
    tokens = df.select(*keys, tokenize(text).alias("_tokens"))
    table = lemmas.filter(F.col("tag") == tag)
    return replace_tokens(tokens, keys, "_tokens", table, "word", "lemma").select(
        *keys, F.array_join("_tokens", " ").alias(text))


def lemmatize_in_place(df: DataFrame, key: str, text: str, lemmas: DataFrame, tag: str = "n") -> DataFrame:
    """``df`` with the words of one column replaced by their lemmas; ``key`` identifies a row.

    The lemma step of a cleaning chain: by a table that every worker holds the
    rows stay where they are, else key and text go through the look-up.  A null
    text stays null, one with a null key becomes null; rows that share their key get the words of all.
    """
    known, table = held(values_of(lemmas.filter(F.col("tag") == tag), "word", F.coalesce("lemma", "word")))
    once, again = apart(df, [key]) if known is not None else (None, df)
    out = []
    if once is not None:
        words = looked_up(tokenize(text), known, table.schema["v"].dataType, keep=True)
        out.append(once.withColumn(text, F.when(F.col(key).isNotNull(), F.array_join(words, " "))))
    if again is not None:
        joined = lemmatize(again.filter(F.col(text).isNotNull()).select(key, text), [key], text, lemmas, tag)
        out.append(again.drop(text).join(joined, key, "left").select(*df.columns))
    return reduce(DataFrame.unionByName, out)


def lemmatize_tagged(df: DataFrame, keys: list[str], tagged: str, lemmas: DataFrame, default_tag: str | None = None) -> DataFrame:
    """Lemma of tagged words by (word, tag); a null tag leaves the word, or stands for ``default_tag``."""
    rows = df.select(*keys, F.posexplode_outer(tagged).alias("pos", "t")).filter("pos IS NOT NULL").select(
        *keys, "pos", "t.word", F.coalesce("t.tag", F.lit(default_tag)).alias("tag"))
    hits = rows.join(lemmas.select("word", "tag", "lemma"), ["word", "tag"], "left")
    out = regroup(hits, keys, F.coalesce("lemma", "word"), tagged)
    empty = df.filter(F.size(tagged) <= 0).select(*keys, F.array().cast("array<string>").alias(tagged))
    return out.unionByName(empty)


def canonicalize_words(words: DataFrame, word: str = "word", vocabulary: DataFrame | None = None,
                       digits: bool = True) -> DataFrame:
    """Lower-case; a word outside the vocabulary has its digits marked, and is
    unknown when that is not in the vocabulary either.  Adds ``canonical``."""
    low = words.withColumn("_low", F.lower(word)).withColumn("_dig", canonical_digits("_low") if digits else F.col("_low"))
    if vocabulary is None:
        return low.withColumn("canonical", F.col("_dig")).drop("_low", "_dig")
    known = vocabulary.select("word").distinct()
    both = low.join(known.select(F.col("word").alias("_low"), F.lit(True).alias("_k1")), "_low", "left").join(
        known.select(F.col("word").alias("_dig"), F.lit(True).alias("_k2")), "_dig", "left")
    canonical = F.when(F.col("_k1"), F.col("_low")).when(F.col("_k2"), F.col("_dig")).otherwise(F.lit(UNKNOWN))
    return both.withColumn("canonical", canonical).drop("_low", "_dig", "_k1", "_k2")


def stopword_set(base: DataFrame, extra: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(base and extra) without exclude; every side has a ``word`` column."""
    words = base.select("word")
    if extra is not None:
        words = words.unionByName(extra.select("word"))
    words = words.distinct()
    return words if exclude is None else words.join(exclude.select("word"), "word", "left_anti")
