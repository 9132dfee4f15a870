"""Term counts, TF-IDF and word-vector features in long, sparse form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokenize
from ..session import write_cut
from .aggregates import top_rows
from .blocks import vector_sums

# Words of at least two characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _counted(df: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, count) of a term array: sorted, then the lengths of its runs.

    Each step is a projection of its own, as a lambda works out again whatever
    it takes from outside.  The outer form with the null filter behind it keeps
    the whole chain out of the scan's filter.
    """
    ordered = df.select(key, F.sort_array(terms).alias("_s"))
    zipped = ordered.select(key, F.size("_s").alias("_n"), F.arrays_zip(
        F.col("_s").alias("w"), F.concat(F.array(F.lit(None).cast("string")), F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0)))).alias("before"),
        F.sequence(F.lit(0), F.size("_s")).alias("at")).alias("_z"))
    starts = zipped.select(key, "_n", F.filter("_z", lambda z: z["w"].isNotNull() & ~z["w"].eqNullSafe(z["before"])).alias("_z"))
    ends = F.concat(F.slice("_z.at", F.lit(2), F.greatest(F.size("_z"), F.lit(1))), F.array("_n"))
    runs = starts.select(key, F.inline_outer(F.arrays_zip(F.col("_z.w").alias("term"), F.col("_z.at").alias("_from"), ends.alias("_to"))))
    return runs.filter("term IS NOT NULL").select(key, "term", (F.col("_to") - F.col("_from")).cast("long").alias("count"))


def ngram_counts(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 1),
                 max_features: int | None = None, pattern: str = TERM_PATTERN) -> DataFrame:
    """(key, term, count) of every n-gram; optionally only the most frequent terms.

    A row is a document, so its terms are counted inside the row and nothing
    moves; rows that share a key are counted each for itself.  With
    ``max_features`` the counts are read twice and therefore written once.
    """
    # A projection of its own: the n-grams refer to the tokens several times.
    tokens = df.select(key, tokenize(text, pattern=pattern).alias("_tokens"))
    counts = _counted(tokens.select(key, ngrams("_tokens", ngram_range).alias("_terms")), key, "_terms")
    if max_features is None:
        return counts
    counts = write_cut(counts, "term-counts")
    totals = counts.groupBy("term").agg(F.sum("count").alias("total"))
    return counts.join(top_rows(totals, max_features, "total", "term").select("term"), "term", "left_semi")


def tfidf(counts: DataFrame, key: str, n_docs: Column, use_idf: bool = True, smooth_idf: bool = True) -> DataFrame:
    """(key, term, value): count times idf, each row scaled to length 1.

    Smoothed idf is ln((1 + n) / (1 + df)) + 1.  ``n_docs`` counts all
    documents, also those without a term.
    """
    if use_idf:
        seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        one = 1 if smooth_idf else 0
        idf = seen.select("term", (F.log((n_docs + one) / (F.col("_df") + one)) + 1).alias("_idf"))
        weighted = counts.join(idf, "term").withColumn("_w", F.col("count") * F.col("_idf"))
    else:
        weighted = counts.withColumn("_w", F.col("count").cast("double"))
    # The rows of one document come together once; its length is taken in place.
    docs = weighted.groupBy(key).agg(F.collect_list(F.struct("term", "_w")).alias("_t"),
                                     F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return docs.select(key, F.explode("_t").alias("t"), "_norm").select(
        key, F.col("t.term").alias("term"), (F.col("t._w") / F.col("_norm")).alias("value"))


def document_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def tfidf_vectorizer(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int] = (1, 1),
                     max_features: int | None = None, use_idf: bool = True, smooth_idf: bool = True) -> DataFrame:
    counts = ngram_counts(df, key, text, ngram_range, max_features)
    if use_idf and max_features is None:
        counts = write_cut(counts, "term-counts")       # read for the document frequencies and for the weights
    return tfidf(counts, key, document_count(df), use_idf, smooth_idf)


def term_doc_matrix(values: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """A fitted matrix in long form, rounded."""
    return values.select(key, "term", F.round("value", digits).alias("value"))


def vectors_for_vocabulary(vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of a (word, vec) table whose word is in the vocabulary."""
    return vectors.join(vocab.select("word"), "word", "left_semi")


def fill_unknown_vectors(vectors: DataFrame, vocab: DataFrame, size: int, low: float = -0.25, high: float = 0.25) -> DataFrame:
    """Vectors of the whole vocabulary; a missing word gets one drawn from its hash."""
    missing = vocab.select("word").distinct().join(vectors.select("word"), "word", "left_anti")

    def draw(i: Column) -> Column:
        head = F.conv(F.substring(F.md5(F.concat_ws(":", "word", i.cast("string"))), 1, 8), 16, 10).cast("double")
        return low + (high - low) * head / float(2**32)

    drawn = missing.select("word", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), draw).alias("vec"))
    have = vectors_for_vocabulary(vectors, vocab).select("word", F.col("vec").cast("array<double>").alias("vec"))
    return have.unionByName(drawn)


def mean_word_vector(df: DataFrame, key: str, tokens: str, vectors: DataFrame, size: int, name: str = "vec") -> DataFrame:
    """Mean vector of a text's known words; a text without one gets zeros.

    Vectors go to blocks of texts, not to words (``blocks``); a text sends its
    words and one row of ``size`` sums.
    """
    sums = vector_sums(df, key, tokens, vectors, size).groupBy(key).agg(F.sum("_m").alias("_m"), *[
        F.sum(F.get("_s", F.lit(i))).alias(f"_s{i}") for i in range(size)])
    means = sums.select(key, F.array(*[F.col(f"_s{i}") / F.col("_m") for i in range(size)]).alias(name))
    zero = F.array_repeat(F.lit(0.0), size)
    return df.select(key).join(means, key, "left").withColumn(name, F.coalesce(name, zero))
