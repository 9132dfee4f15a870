"""Message enrichment as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import clean_text, strip_entities, whitespace_tokens
from ..operators import dedup, lookup, sentiment
from ..session import freed_shuffles
from ..sources.records import MISSING_TEXT, extract_message, extract_message_file, parse, write_csv
from . import versions

MINIMUM_WORD = 4      # words of three letters or fewer are not counted
BUCKETS = 64          # folders of the message table


def bucket_of(hexadecimal: Column) -> Column:
    """The folder of a message by the first eight digits of its hash."""
    return F.pmod(F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")


def clean_messages(messages: DataFrame, key: str, lemmas: DataFrame | None = None) -> DataFrame:
    """Parsed messages -> flat columns and cleaned text (one projection).

    With a (word, tag, lemma) table the cleaned text is that of the nouns' lemmas.
    """
    return _cleaned(extract_message(messages, key), key, lemmas)


def _cleaned(flat: DataFrame, key: str, lemmas: DataFrame | None) -> DataFrame:
    cleaned = flat.withColumn("text_clean", clean_text(strip_entities("text"), short_tokens=False))
    return cleaned if lemmas is None else lookup.lemmatize_in_place(cleaned, key, "text_clean", lemmas)


def enrich(messages: DataFrame, key: str, lexicon: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Parsed messages -> flat columns, cleaned text, score and label."""
    return sentiment.score_sentiment(clean_messages(messages, key, lemmas), key, "text_clean", lexicon)


def message_file_job(messages: DataFrame, key: str, lexicon: DataFrame, lemmas: DataFrame, path: str) -> None:
    """Parsed messages of a file -> one CSV table of text, origin, cleaned lemmas, score and label.

    Records without a text are left out; coordinates are written as two numbers
    with a blank between them.
    """
    flat = extract_message_file(messages, key).filter("text IS NOT NULL")
    scored = sentiment.score_sentiment(_cleaned(flat, key, lemmas), key, "text_clean", lexicon)
    write_csv(scored.withColumn("coordinates", F.array_join(F.col("coordinates").cast("array<string>"), " ")), path)


def message_words(enriched: DataFrame, *keep: str) -> DataFrame:
    """One row per counted word of a message."""
    words = F.filter(whitespace_tokens("text_clean", lower=False), lambda w: F.length(w) >= MINIMUM_WORD)
    return enriched.select(*keep, "movie", F.explode(words).alias("word"))


def counted_words(enriched: DataFrame, order: str, lexicon: DataFrame) -> DataFrame:
    """(word, movie, count, word_sentiment) of a whole table of messages."""
    owned = dedup.word_owner_counts(message_words(enriched, order), "word", "movie", [order])
    return sentiment.word_sentiment(owned, "word", lexicon)


def fold_word_counts(rows: DataFrame, whole: bool) -> DataFrame:
    """Parts of (word, movie, n, version, first) as one.

    A word belongs to the movie that had it in the earliest version, there in the
    earliest row; its count is that of the owner's rows.  Rows of other movies
    go as soon as the parts reach back to the first batch.
    """
    pairs = rows.groupBy("word", "movie").agg(F.sum("n").alias("n"), F.min(F.struct("version", "first")).alias("at"))
    if whole:
        pairs = pairs.groupBy("word").agg(F.min_by(F.struct("movie", "n", "at"), F.struct("at", "movie")).alias("o")).select("word", "o.*")
    return pairs.select("word", "movie", "n", "at.version", "at.first")


def add_word_counts(tables: str, run: str, batch_id: int, words: DataFrame, key: str) -> None:
    """Add a batch of words to the count table, once: what is written grows with the batch (``versions.add_batch``)."""
    pairs = words.groupBy("word", "movie").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    versions.add_batch(tables, "words", run, batch_id, lambda v: pairs.select("word", "movie", "n", F.lit(v).cast("long").alias("version"), "first"), fold_word_counts)


def latest_word_counts(spark: SparkSession, tables: str) -> DataFrame:
    """(word, movie, count) of the newest recorded version."""
    return versions.newest(spark, tables, "words", fold_word_counts).select("word", "movie", F.col("n").alias("count"))


def stored_messages(spark: SparkSession, tables: str) -> DataFrame:
    """The message table."""
    return spark.read.parquet(f"{tables}/messages").drop("bucket")


def enrichment_sink(tables: str, key: str, lexicon: DataFrame, run: str | None = None, lemmas: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of the message table and the word-count table.

    Both writes can be repeated: messages already in the table are excluded by
    the SHA-256 of their text, and batches are added to the counts once.  The
    table is kept in ``BUCKETS`` folders by the start of that hash; a batch
    opens those it has messages for, and reads 32 bytes of each message there.  ``run`` names the stream whose
    batch numbers these are; by default that is the id its checkpoint holds.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = run or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("the stream has no id; name the run")
        # The sinks read the scored rows twice.
        enriched = enrich(parse(batch), key, lexicon, lemmas).persist()
        try:
            with freed_shuffles(spark):
                hashed = F.sha2("text", 256)
                new = enriched.withColumns({"created_at": F.current_timestamp(), "text_key": F.unhex(hashed), "bucket": bucket_of(hashed)})
                stored = versions.stored(spark, f"{tables}/messages")
                if stored is not None:
                    opened = [r[0] for r in new.select("bucket").distinct().collect()]          # BUCKETS at most
                    rows = dedup.insert_if_absent(new, stored.filter(F.col("bucket").isin(opened)), ["text_key"], [key], "text")
                else:
                    rows = dedup.first_wins(new.filter(F.col("text") != MISSING_TEXT), ["text_key"], [key])
                # One file for a bucket and batch.
                rows.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(f"{tables}/messages")
                add_word_counts(tables, name, batch_id, message_words(enriched, key), key)
        finally:
            enriched.unpersist()

    return write


def start_enrichment(stream: DataFrame, tables: str, checkpoint: str, key: str, lexicon: DataFrame,
                     once: bool = True, lemmas: DataFrame | None = None) -> StreamingQuery:
    """Run the enrichment over a stream of JSON ``value`` records; with a lemma table, on lemmas."""
    writer = stream.writeStream.foreachBatch(enrichment_sink(tables, key, lexicon, lemmas=lemmas)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_dedup(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row per key of an endless stream; a watermark bounds what is remembered."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


# -- running counts with an owner --------------------------------------------------------

def stream_pair_counts(words: DataFrame, order: str) -> DataFrame:
    """Running (word, movie) counts and first arrivals as a built-in stateful
    aggregation: it stays in the JVM and combines on the map side, so a hot word
    costs its task one row per input task."""
    return words.groupBy("word", "movie").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def fold_updates(rows: DataFrame, whole: bool) -> DataFrame:
    """Parts of (word, movie, n, first, version) as one: the newest row of each pair."""
    return rows.groupBy("word", "movie").agg(F.max_by(F.struct("n", "first", "version"), "version").alias("p")).select("word", "movie", "p.*")


def update_sink(tables: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of running pair counts: a batch writes its updates, older ones of a pair go when parts are merged."""
    def write(batch: DataFrame, batch_id: int) -> None:
        name = run or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("the stream has no id; name the run")
        versions.add_batch(tables, "updates", name, batch_id, lambda v: batch.select("word", "movie", "n", "first", F.lit(v).cast("long").alias("version")), fold_updates)

    return write


def latest_owners(spark: SparkSession, tables: str) -> DataFrame:
    """(word, movie, count) from the updates up to the newest recorded version."""
    return owners_of(versions.newest(spark, tables, "updates", fold_updates), "version")


def owners_of(updates: DataFrame, batch: str = "batch") -> DataFrame:
    """(word, movie, count) from the updates so far: the newest row of each pair,
    then the pair that arrived first."""
    pairs = updates.groupBy("word", "movie").agg(F.max_by(F.struct("n", "first"), batch).alias("p"))
    return pairs.groupBy("word").agg(F.min_by(F.struct("movie", F.col("p.n").alias("count")), F.struct("p.first", "movie")).alias("o")).select(
        "word", "o.*")


WORD_COUNT_SCHEMA = "word string, movie string, count long"


class OwnedCounts(StatefulProcessor):
    """Per word: the first movie seen owns it; only its rows are counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("owner", "movie string, count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        first: dict[str, int] = {}
        for part in rows:
            for movie, n, at in zip(part["movie"], part["n"], part["first"]):
                counts[movie] = counts.get(movie, 0) + int(n)
                first[movie] = min(first.get(movie, at), at)
        if self._state.exists():
            movie, count = self._state.get()
        else:
            movie, count = min(first, key=lambda m: (first[m], m)), 0
        count = int(count) + counts.get(movie, 0)
        self._state.update((movie, count))
        yield pd.DataFrame({"word": [key[0]], "movie": [movie], "count": [count]})

    def close(self) -> None:
        pass


def _combine(order: str):
    """Count words per Arrow batch before the shuffle, so a hot word sends a few
    rows per task instead of all of its occurrences."""
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.groupby(["word", "movie"], as_index=False, sort=False).agg(n=("word", "size"), first=(order, "min"))

    return combine


def stream_owned_counts(words: DataFrame, order: str) -> DataFrame:
    """The same counts with the owner fixed in arrival order, kept per word in the
    state store, which must be RocksDB (``session.SETTINGS``).  Use it when an owner
    must never change after it was reported;
    it calls Python once per word and batch, so ``stream_pair_counts`` is faster."""
    combined = words.select("word", "movie", order).mapInPandas(_combine(order), "word string, movie string, n long, first long")
    return combined.groupBy("word").transformWithStateInPandas(
        OwnedCounts(), outputStructType=WORD_COUNT_SCHEMA, outputMode="Update", timeMode="None")
