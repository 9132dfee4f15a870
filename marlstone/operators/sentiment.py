"""Lexicon sentiment: table look-up, modifiers before the word, squashed sum."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _col, whitespace_tokens
from ..functions.wordlists import NEGATORS, SAMPLE_VALENCE, STRENGTHENERS, WEAKENERS
from .blocks import apart, flat, held, places, slices

# Published constants of the rule-based score (2014).
STRENGTH = 0.293
TURN = -0.74
DISTANCE_FACTORS = (1.0, 0.95, 0.9)
ALPHA = 15.0


def sample_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_VALENCE.items()), "word string, valence double")


def sentiment_label(score) -> Column:
    s = _col(score)
    return F.when(s > 0, "positive").when(s == 0, "neutral").when(s < 0, "negative")


def compound(valence_sum) -> Column:
    """Sum of valences squashed into -1..1, four digits."""
    v = _col(valence_sum)
    return F.round(v / F.sqrt(v * v + ALPHA), 4)


def _modified(valence: Column, before: list[Column]) -> Column:
    """Valence after the up to three words in front of it."""
    v = valence
    for word, factor in zip(before, DISTANCE_FACTORS):
        push = F.when(word.isin(*STRENGTHENERS), STRENGTH * factor).when(word.isin(*WEAKENERS), -STRENGTH * factor).otherwise(0.0)
        v = v + F.when(v < 0, -push).otherwise(push)
        v = F.when(word.isin(*NEGATORS), v * TURN).otherwise(v)
    return v


def _with_preceding(tokens: str) -> Column:
    """Every token with the three before it: array<struct<w, b1, b2, b3>>."""
    shifted = [F.concat(F.array_repeat(F.lit(None).cast("string"), d), F.col(tokens)) for d in (1, 2, 3)]
    zipped = F.arrays_zip(F.col(tokens).alias("w"), shifted[0].alias("b1"), shifted[1].alias("b2"), shifted[2].alias("b3"))
    return F.slice(zipped, F.lit(1), F.size(tokens))


def _sums_in_place(tokens: Column, known: Broadcast) -> Column:
    """The sum of the modified valences of a token list, by a lexicon (w, v) that every worker holds; null without a valence."""
    def part(lists: pa.Array) -> pa.Array:
        coded, length = flat(lists)
        coded = coded.dictionary_encode()
        words, code = coded.dictionary, coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists), dtype=np.int32), length)
        entry, valence = (known.value[c].combine_chunks() for c in ("w", "v"))
        place, *kinds = (np.append(places(words, x), -1) for x in (entry, *(pa.array(k, words.type) for k in (STRENGTHENERS, WEAKENERS, NEGATORS))))
        at = np.flatnonzero(place[code] >= 0)
        v = valence.to_numpy(zero_copy_only=False)[place[code[at]]]
        for back, factor in enumerate(DISTANCE_FACTORS, start=1):
            before = np.maximum(at - back, 0)
            there = (at >= back) & (row[before] == row[at])
            stronger, weaker, turned = ((kind >= 0)[code[before]] & there for kind in kinds)
            push = np.where(stronger, STRENGTH * factor, np.where(weaker, -STRENGTH * factor, 0.0))
            v = v + np.where(v < 0, -push, push)
            v = np.where(turned, v * TURN, v)
        total = np.bincount(row[at], v, len(lists))
        return pa.array(total, mask=np.bincount(row[at], minlength=len(lists)) == 0)

    @F.arrow_udf("double")
    def sums(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(x) for x in slices(lists)])

    return sums(tokens)


def _lexicon_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """By a lexicon that every worker holds, rows stay where they are; for a
    larger one, or one with several valences of a word, and for rows that share
    their key, one equi join per token and one sum per key.
    """
    entries = lexicon.select(F.col("word").alias("w"), F.col("valence").cast("double").alias("v")).filter("w IS NOT NULL AND v IS NOT NULL")
    known, entries = held(entries)
    if known is not None and not entries.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        known = None
    if known is None:
        return _joined_scores(df, key, text, entries)
    once, again = apart(df, [key])
    total = F.when(F.col(key).isNotNull(), _sums_in_place(whitespace_tokens(text), known))
    scored = once.withColumn("sentiment_score", compound(F.coalesce(total, F.lit(0.0))))
    return scored if again is None else scored.unionByName(_joined_scores(again, key, text, entries))


def _joined_scores(df: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    rows = df.select(key, whitespace_tokens(text).alias("_t")).select(key, F.explode(_with_preceding("_t")).alias("x")).select(key, "x.*")
    hits = rows.join(entries.select("w", F.col("v").alias("_v")), "w")
    total = hits.groupBy(key).agg(F.sum(_modified(F.col("_v"), [F.col("b1"), F.col("b2"), F.col("b3")])).alias("_s"))
    scored = df.join(total, key, "left")
    return scored.withColumn("sentiment_score", compound(F.coalesce("_s", F.lit(0.0)))).drop("_s")


def _not_available(*_args) -> DataFrame:
    raise NotImplementedError("this sentiment method is declared but not available")


# Methods by name; callers may add their own.
METHODS: dict[str, Callable[..., DataFrame]] = {"vader": _lexicon_scores, "capone": _not_available}


def score_sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame, method: str = "vader") -> DataFrame:
    """Adds ``sentiment_score`` and ``sentiment``; ``key`` identifies a row."""
    if method not in METHODS:
        raise ValueError(f"sentiment method {method} is not known")
    scored = METHODS[method](df, key, text, lexicon)
    return scored.withColumn("sentiment", sentiment_label("sentiment_score"))


def word_sentiment(words: DataFrame, word: str, lexicon: DataFrame, name: str = "word_sentiment") -> DataFrame:
    """Label of a word from its own valence alone."""
    hit = words.join(lexicon.select(F.col("word").alias(word), F.col("valence").alias("_v")), word, "left")
    return hit.withColumn(name, sentiment_label(compound(F.coalesce("_v", F.lit(0.0))))).drop("_v")


def pair_lexicon_difference(df: DataFrame, key: str, a: str, b: str, lexicon: DataFrame) -> DataFrame:
    """Polarity, subjectivity and noun-count differences of a pair.

    ``lexicon`` has word, polarity, subjectivity, is_noun.  Both sides go
    through one join and one grouping.
    """
    sides = df.select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("side"), whitespace_tokens(a).alias("t")),
        F.struct(F.lit(2).alias("side"), whitespace_tokens(b).alias("t")))).alias("s"))
    hits = sides.select(key, "s.side", F.explode_outer("s.t").alias("word")).join(lexicon, "word")

    def of(side: int, fn, value: str) -> Column:
        return F.coalesce(fn(F.when(F.col("side") == side, F.col(value))), F.lit(0.0))

    both = hits.groupBy(key).agg(
        F.abs(of(1, F.avg, "polarity") - of(2, F.avg, "polarity")).alias("polarity_diff"),
        F.abs(of(1, F.avg, "subjectivity") - of(2, F.avg, "subjectivity")).alias("subjectivity_diff"),
        of(1, F.sum, "is_noun").alias("_n1"), of(2, F.sum, "is_noun").alias("_n2"))
    noun = F.when(F.col("_n1") + F.col("_n2") > 0, F.abs(F.col("_n1") - F.col("_n2")) / (F.col("_n1") + F.col("_n2"))).otherwise(0.0)
    out = both.select(key, noun.alias("noun_diff"), "polarity_diff", "subjectivity_diff")
    return df.select(key).join(out, key, "left").na.fill(0.0)
