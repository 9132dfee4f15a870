"""Message streams built from the documents, and the movie table from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import sentiment
from ..session import new_folder, write_cut
from ..sources import records as rec
from ..streaming import enrich as en
from . import sql as S
from .catalog import query, table
from .cleaning import _LEMMAS_SQL, lemma_table

# A message per document: gaps appear by document number in the fields beside the text.
_MESSAGE = {
    "id": "doc_id", "text": "text", "lang": "lang", "retweet_count": "CAST(n_chars % 50 AS INT)",
    "ts": "timestamp_seconds(1700000000 + doc_id)",
    "entities": "named_struct('hashtags', CASE WHEN doc_id % 5 = 0 THEN array() ELSE array(named_struct('text', source), named_struct('text', lang)) END)",
    "user": "named_struct('lang', lang, 'name', concat('user ', source), 'screen_name', source, 'location', CASE WHEN doc_id % 7 <> 0 THEN lang END, "
            "'followers_count', n_chars, 'favourites_count', CASE WHEN doc_id % 4 <> 0 THEN doc_id % 100 END, 'friends_count', doc_id % 10)",
    "place": "CASE WHEN doc_id % 3 <> 0 THEN named_struct('country', upper(lang)) END",
    "coordinates": "CASE WHEN doc_id % 2 <> 0 THEN named_struct('coordinates', CASE WHEN doc_id % 11 <> 0 THEN array(doc_id % 180 + 0.5D, doc_id % 90 + 0.25D) END) END",
    "retweeted_status": "CASE WHEN doc_id % 6 = 0 THEN named_struct('retweet_count', doc_id % 1000) END",
}


# Bytes of files in a batch of a stream.
BATCH = 1 << 29


def as_messages(documents):
    """Documents as JSON ``value`` records (batch or stream)."""
    return rec.publish(documents.selectExpr(*[f"{e} AS {n}" for n, e in _MESSAGE.items()]))


def messages(spark, sf_dir):
    return rec.parse(as_messages(table(spark, sf_dir, "documents")))


def document_stream(spark, sf_dir):
    """The documents table as a file stream.  A batch is of a size that gives every task work, whatever the number of files."""
    schema = table(spark, sf_dir, "documents").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH).parquet(f"{sf_dir}/[d]ocuments.parquet")


_EXTRACT = """SELECT doc_id AS id, coalesce(text, 'Data Error') AS text,
  CASE WHEN doc_id % 5 = 0 THEN 'Data Error' ELSE source END AS movie, lang AS language, CASE WHEN doc_id % 3 <> 0 THEN upper(lang) END AS country,
  'user ' || source AS user_nm, source AS screen_nm,
  CASE WHEN doc_id % 2 <> 0 THEN CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 90) || '.25' ELSE 'Not available' END END AS coordinates_lat,
  CASE WHEN doc_id % 2 <> 0 THEN CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 180) || '.5' ELSE 'Not available' END END AS coordinates_long,
  CASE WHEN doc_id % 7 <> 0 THEN lang END AS location, CASE WHEN doc_id % 6 = 0 THEN (doc_id % 1000)::INTEGER ELSE 0 END AS retweets_count,
  n_chars::INTEGER AS followers_count, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100)::INTEGER ELSE 0 END AS favourites_count,
  (doc_id % 10)::INTEGER AS friends_count FROM documents"""


@query("tweet_extract", _EXTRACT)
def tweet_extract(spark, sf_dir):
    return rec.extract_message(messages(spark, sf_dir), "id")


@query("tweet_extract_file", """
SELECT doc_id AS id, trim(replace(text, chr(10), ' ')) AS text, lang, CASE WHEN doc_id % 3 <> 0 THEN upper(lang) END AS country, 'user ' || source AS user_nm,
  CASE WHEN doc_id % 2 <> 0 AND doc_id % 11 <> 0 THEN (doc_id % 180) || '.5 ' || (doc_id % 90) || '.25' END AS coordinates, (n_chars % 50)::INTEGER AS retweet_count
FROM documents WHERE text IS NOT NULL""")
def tweet_extract_file(spark, sf_dir):
    rows = rec.extract_message_file(messages(spark, sf_dir), "id").filter("text IS NOT NULL")
    return rows.withColumn("coordinates", F.when(F.col("coordinates").isNotNull(), F.array_join(F.col("coordinates").cast("array<string>"), " ")))


@query("publish_json", """
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value
FROM customer""")
def publish_json(spark, sf_dir):
    published = rec.publish(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return published.select(F.get_json_object("value", "$.c_custkey").cast("long").alias("c_custkey"), "value")


@query("event_properties", """
SELECT event_type, count(*) AS n, sum(('0' || regexp_extract(props, '"k": *(\\d+)', 1))::BIGINT)::BIGINT AS total FROM events GROUP BY 1""")
def event_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "props")
    parsed = events.select("event_type", F.from_json("props", "k LONG").alias("p"))
    return parsed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("track_filter", """
SELECT doc_id AS id, length(text) AS n FROM documents
WHERE lang = 'en' AND doc_id % 5 <> 0 AND source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def track_filter(spark, sf_dir):
    tracked = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("#src"), "n_nationkey").alias("name"))
    kept = rec.track_filter(messages(spark, sf_dir), tracked)
    return kept.select("id", F.length("text").cast("long").alias("n"))


@query("metadata_normalise", """
SELECT p_name AS title, CASE WHEN p_size % 8 = 0 THEN 'NA' ELSE '[' || array_to_string(list_transform(range(1, least(p_size % 8, 5) + 1), lambda i: '"' || p_brand || '-' || i || '"'), ',') || ']' END AS main_cast,
  CASE WHEN p_size % 5 = 0 THEN 'NA' ELSE p_brand END AS director, '["' || p_type || '"]' AS genres, CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE '["en","fr"]' END AS lang,
  CASE WHEN p_size % 3 = 0 THEN 'NA' ELSE '["' || p_name || '"]' END AS plot, 'http://parts/' || p_partkey AS "imdbURL" FROM part""")
def metadata_normalise(spark, sf_dir):
    movies = table(spark, sf_dir, "part").selectExpr(
        "p_name AS title", "CASE WHEN p_size % 8 > 0 THEN transform(sequence(1, p_size % 8), i -> named_struct('name', concat(p_brand, '-', i))) END AS cast",
        "CASE WHEN p_size % 5 <> 0 THEN array(p_brand, p_type) END AS director", "array(p_type) AS genres",
        "CASE WHEN p_size % 2 <> 0 THEN array('en', 'fr') END AS lang", "CASE WHEN p_size % 3 <> 0 THEN array(p_name) END AS plot",
        "concat('http://parts/', p_partkey) AS url")
    return rec.normalise_movie(movies)


# -- sentiment ------------------------------------------------------------------------

# A lexicon derived from the labelled documents: words seen in at least three of
# them, rated by how those are labelled.
_LEXICON = f"""lexicon AS (SELECT word, round(8 * (avg(quality) - 0.5), 1) AS valence FROM (
  SELECT DISTINCT doc_id, unnest({S.tokens('text')}) AS word FROM documents) JOIN labels USING (doc_id)
  GROUP BY word HAVING count(*) >= 3 AND round(8 * (avg(quality) - 0.5), 1) <> 0)"""


def lexicon(spark, sf_dir):
    # Texts meet their labels, not words: only labelled ones are tokenised, and a text is sent once.
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    valence = F.round(8 * (F.avg("quality") - 0.5), 1)
    rated = labelled.select("quality", F.explode(F.array_distinct(tokenize("text"))).alias("word")).groupBy("word").agg(valence.alias("valence"), F.count(F.lit(1)).alias("n"))
    # A few thousand words from a pass over all texts: kept, not derived again.
    return write_cut(rated.filter("n >= 3 AND valence <> 0").select("word", "valence"), "lexicon")


_LABEL = "CASE WHEN {s} > 0 THEN 'positive' WHEN {s} = 0 THEN 'neutral' ELSE 'negative' END"


def _list(words):
    return "(" + S.literals(words) + ")"


def _modified_sql(v: str) -> str:
    """The modifier rules, one nested query per distance."""
    out = v
    for d, factor in enumerate(sentiment.DISTANCE_FACTORS, start=1):
        step = sentiment.STRENGTH * factor
        out = (f"SELECT * REPLACE (CASE WHEN b{d} IN {_list(sentiment.NEGATORS)} THEN v * {sentiment.TURN}::DOUBLE ELSE v END AS v) FROM ("
               f"SELECT * REPLACE (CASE WHEN b{d} IN {_list(sentiment.STRENGTHENERS)} THEN CASE WHEN v < 0 THEN v - {step!r}::DOUBLE ELSE v + {step!r}::DOUBLE END "
               f"WHEN b{d} IN {_list(sentiment.WEAKENERS)} THEN CASE WHEN v < 0 THEN v + {step!r}::DOUBLE ELSE v - {step!r}::DOUBLE END ELSE v END AS v) FROM ({out}))")
    return out


def _score_sql(clean: str) -> str:
    """clean(id, text_clean) -> score(id, sentiment_score)."""
    return f"""toks AS (SELECT id, i, ws[i] AS w, ws[i - 1] AS b1, CASE WHEN i > 2 THEN ws[i - 2] END AS b2, CASE WHEN i > 3 THEN ws[i - 3] END AS b3
  FROM (SELECT id, regexp_extract_all(lower(text_clean), {S.CHUNKS}) AS ws FROM {clean}), unnest(range(1, len(ws) + 1)) AS r(i)),
hits AS (SELECT id, valence::DOUBLE AS v, b1, b2, b3 FROM toks JOIN lexicon ON word = w),
sums AS (SELECT id, sum(v) AS s FROM ({_modified_sql('SELECT * FROM hits')}) GROUP BY id),
score AS (SELECT c.id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 4) AS sentiment_score FROM {clean} c LEFT JOIN sums USING (id))"""


@query("sentiment_score", f"""
WITH {_LEXICON}, clean AS (SELECT doc_id AS id, {S.cleaned('text', short=False)} AS text_clean FROM documents), {_score_sql('clean')}
SELECT id AS doc_id, sentiment_score, {_LABEL.format(s='sentiment_score')} AS sentiment FROM score""")
def sentiment_score(spark, sf_dir):
    from ..functions.text import clean_text

    cleaned = table(spark, sf_dir, "documents").select("doc_id", clean_text("text", short_tokens=False).alias("text_clean"))
    return sentiment.score_sentiment(cleaned, "doc_id", "text_clean", lexicon(spark, sf_dir)).drop("text_clean")


@query("sentiment_label", f"SELECT event_id, {_LABEL.format(s='(value - 10)')} AS label FROM events")
def sentiment_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sentiment.sentiment_label(F.col("value") - 10).alias("label"))


# -- the whole message job -------------------------------------------------------------

_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+', '', 'g'), '#\\S+', '', 'g'), '@\\S+', '', 'g'), 'u''RT\\S+', '', 'g')"
_ENRICHED = f"""{_LEXICON}, flat AS ({_EXTRACT}), clean AS (SELECT *, {S.cleaned(_STRIPPED, short=False)} AS text_clean FROM flat), {_score_sql('clean')},
enriched AS (SELECT clean.*, sentiment_score, {_LABEL.format(s='sentiment_score')} AS sentiment FROM clean JOIN score USING (id))"""


def _columns():
    return ("id", "text", "movie", "country", "coordinates_lat", "retweets_count", "text_clean", "sentiment_score", "sentiment")


@query("enrich_messages", f"WITH {_ENRICHED} SELECT {', '.join(_columns())} FROM enriched")
def enrich_messages(spark, sf_dir):
    return en.enrich(messages(spark, sf_dir), "id", lexicon(spark, sf_dir)).select(*_columns())


_WORDS = f"""words AS (SELECT id, movie, unnest(regexp_extract_all(text_clean, {S.CHUNKS})) AS word FROM enriched),
long AS (SELECT * FROM words WHERE length(word) > 3), own AS (SELECT word, arg_min(movie, id) AS movie FROM long GROUP BY word),
counts AS (SELECT word, movie, count(*) AS count FROM long JOIN own USING (word, movie) GROUP BY 1, 2)"""


@query("message_word_counts", f"""
WITH {_ENRICHED}, {_WORDS}
SELECT c.word, movie, count, {_LABEL.format(s="coalesce(valence, 0)")} AS word_sentiment FROM counts c LEFT JOIN lexicon l ON l.word = c.word""")
def message_word_counts(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    return en.counted_words(en.enrich(messages(spark, sf_dir), "id", lex), "id", lex)


# -- the same on lemmas: nouns of the corpus without their s ---------------------------------


def _lemmatized_sql(flat: str) -> str:
    """flat(id, text, ...) -> clean(..., text_clean) of lemmas, with its scores."""
    return f"""{_LEXICON}, {_LEMMAS_SQL}, flat AS ({flat}), c0 AS (SELECT *, {S.cleaned(_STRIPPED, short=False)} AS t0 FROM flat),
lw AS (SELECT id, i, ws[i] AS word FROM (SELECT id, {S.tokens('t0')} AS ws FROM c0), unnest(range(1, len(ws) + 1)) AS r(i)),
lem AS (SELECT id, string_agg(coalesce(lemma, lw.word), ' ' ORDER BY i) AS t FROM lw LEFT JOIN lemmas USING (word) GROUP BY id),
clean AS (SELECT c0.* EXCLUDE (t0), coalesce(t, '') AS text_clean FROM c0 LEFT JOIN lem USING (id)), {_score_sql('clean')},
enriched AS (SELECT clean.*, sentiment_score, {_LABEL.format(s='sentiment_score')} AS sentiment FROM clean JOIN score USING (id))"""


@query("enrich_lemmatized", f"WITH {_lemmatized_sql(_EXTRACT)} SELECT {', '.join(_columns())} FROM enriched")
def enrich_lemmatized(spark, sf_dir):
    return en.enrich(messages(spark, sf_dir), "id", lexicon(spark, sf_dir), lemma_table(spark, sf_dir)).select(*_columns())


@query("stream_enrich_lemmatized", f"""
WITH {_lemmatized_sql(_EXTRACT)}, first AS (SELECT min(id) AS id FROM enriched WHERE text <> 'Data Error' GROUP BY text)
SELECT {', '.join(_columns())} FROM enriched WHERE id IN (SELECT id FROM first)""")
def stream_enrich_lemmatized(spark, sf_dir):
    folder = new_folder(spark, "enrich")
    en.start_enrichment(as_messages(document_stream(spark, sf_dir)), f"{folder}/tables", f"{folder}/checkpoint", "id",
                        lexicon(spark, sf_dir), lemmas=write_cut(lemma_table(spark, sf_dir), "lemmas")).awaitTermination()
    return en.stored_messages(spark, f"{folder}/tables").select(*_columns())


_FILE = """SELECT doc_id AS id, trim(replace(text, chr(10), ' ')) AS text, lang, CASE WHEN doc_id % 3 <> 0 THEN upper(lang) END AS country, 'user ' || source AS user_nm,
  CASE WHEN doc_id % 2 <> 0 AND doc_id % 11 <> 0 THEN (doc_id % 180) || '.5 ' || (doc_id % 90) || '.25' END AS coordinates, (n_chars % 50)::INTEGER AS retweet_count
FROM documents WHERE text IS NOT NULL"""


@query("message_file_job", f"""
WITH {_lemmatized_sql(_FILE)}
SELECT id, coalesce(text, '') AS text, lang, coalesce(country, '') AS country, user_nm, coalesce(coordinates, '') AS coordinates, retweet_count, text_clean, sentiment_score, sentiment FROM enriched""")
def message_file_job(spark, sf_dir):
    """The file job's CSV, read back; gaps of text columns are empty."""
    path = new_folder(spark, "message-file")
    en.message_file_job(messages(spark, sf_dir), "id", lexicon(spark, sf_dir), lemma_table(spark, sf_dir), path)
    return rec.read_csv(spark, path, "id long, text string, lang string, country string, user_nm string, coordinates string, retweet_count int, "
                        "text_clean string, sentiment_score double, sentiment string")


# -- streams ----------------------------------------------------------------------------


def run_stream(df, folder: str, mode: str = "append") -> None:
    """Drain a stream into a parquet folder."""
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("stream_json_source", _EXTRACT)
def stream_json_source(spark, sf_dir):
    folder = new_folder(spark, "json-source")
    run_stream(rec.extract_message(rec.parse(as_messages(document_stream(spark, sf_dir))), "id"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("stream_enrich", f"""
WITH {_ENRICHED}, first AS (SELECT min(id) AS id FROM enriched WHERE text <> 'Data Error' GROUP BY text)
SELECT {', '.join(_columns())} FROM enriched WHERE id IN (SELECT id FROM first)""")
def stream_enrich(spark, sf_dir):
    folder = new_folder(spark, "enrich")
    en.start_enrichment(as_messages(document_stream(spark, sf_dir)), f"{folder}/tables", f"{folder}/checkpoint", "id",
                        lexicon(spark, sf_dir)).awaitTermination()
    return en.stored_messages(spark, f"{folder}/tables").select(*_columns())


@query("stream_owner_table", f"WITH {_ENRICHED}, {_WORDS} SELECT word, movie, count FROM counts")
def stream_owner_table(spark, sf_dir):
    """The word counts that the enrichment job keeps beside its messages."""
    folder = new_folder(spark, "owner-table")
    en.start_enrichment(as_messages(document_stream(spark, sf_dir)), f"{folder}/tables", f"{folder}/checkpoint", "id",
                        lexicon(spark, sf_dir)).awaitTermination()
    return en.latest_word_counts(spark, f"{folder}/tables")


@query("stream_dedup", "SELECT DISTINCT text FROM documents")
def stream_dedup(spark, sf_dir):
    folder = new_folder(spark, "dedup")
    run_stream(en.stream_dedup(document_stream(spark, sf_dir), ["text"]), folder)
    return spark.read.parquet(f"{folder}/out").select("text")


@query("stream_word_counts", f"""
WITH long AS (SELECT doc_id AS id, source AS movie, word FROM (SELECT doc_id, source, unnest({S.tokens('text')}) AS word FROM documents) WHERE length(word) > 3),
own AS (SELECT word, arg_min(movie, id) AS movie FROM long GROUP BY word)
SELECT word, movie, count(*) AS count FROM long JOIN own USING (word, movie) GROUP BY 1, 2""")
def stream_word_counts(spark, sf_dir):
    folder = new_folder(spark, "word-counts")
    words = document_stream(spark, sf_dir).select("doc_id", F.col("source").alias("movie"), F.explode(
        F.filter(tokenize("text"), lambda w: F.length(w) > 3)).alias("word"))

    en.stream_pair_counts(words, "doc_id").writeStream.outputMode("update").foreachBatch(en.update_sink(f"{folder}/tables")).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return en.latest_owners(spark, f"{folder}/tables")
