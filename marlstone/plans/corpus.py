"""Corpus statistics, vocabularies, vectors and splits over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..operators import aggregates as agg
from ..operators import dedup, lookup, sampling, vectorize
from ..operators import vocabulary as voc
from ..sources import corpus as source
from . import sql as S
from .catalog import query, table
from .cleaning import docs

# -- duplicates ---------------------------------------------------------------


@query("drop_all_duplicates", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)""")
def drop_all_duplicates(spark, sf_dir):
    return dedup.drop_all_duplicates(table(spark, sf_dir, "documents"), ["text"]).select("doc_id", "lang", "source", "n_chars")


@query("first_wins_dedup", """
SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text""")
def first_wins_dedup(spark, sf_dir):
    return dedup.first_wins(docs(spark, sf_dir, "text"), ["text"], ["doc_id"])


@query("insert_if_absent", """
WITH old AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE lang <> 'en' GROUP BY text),
new AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text <> 'Data Error'
        AND text NOT IN (SELECT text FROM old) GROUP BY text)
SELECT * FROM old UNION ALL SELECT * FROM new""")
def insert_if_absent(spark, sf_dir):
    all_docs = docs(spark, sf_dir, "text", "lang")
    target = dedup.first_wins(all_docs.filter("lang <> 'en'").drop("lang"), ["text"], ["doc_id"])
    return target.unionByName(dedup.insert_if_absent(all_docs.drop("lang"), target, ["text"], ["doc_id"], "text"))


@query("word_owner_counts", f"""
WITH w AS (SELECT doc_id, source, unnest({S.tokens('text')}) AS word FROM documents),
l AS (SELECT * FROM w WHERE length(word) > 3),
o AS (SELECT word, arg_min(source, doc_id) AS movie FROM l GROUP BY word)
SELECT o.word, o.movie, count(*) AS count FROM l JOIN o ON l.word = o.word AND l.source = o.movie GROUP BY 1, 2""")
def word_owner_counts(spark, sf_dir):
    words = docs(spark, sf_dir, F.col("source").alias("movie"), F.explode(
        F.filter(t.tokenize("text"), lambda w: F.length(w) > 3)).alias("word"))
    return dedup.word_owner_counts(words, "word", "movie", ["doc_id"])


# -- word sets ----------------------------------------------------------------


@query("word_list", """
SELECT DISTINCT unnest(string_split(trim(lower(line)), ' ')) AS word
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)""")
def word_list(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return source.words_of_lines(lines)


@query("stopword_set", f"""
SELECT DISTINCT word FROM (SELECT unnest({S.tokens('text')}) AS word FROM documents WHERE lang = 'en'
  UNION ALL SELECT unnest({S.tokens('text')}) FROM documents WHERE lang = 'de')
WHERE word NOT IN (SELECT unnest({S.tokens('text')}) FROM benchmark)""")
def stopword_set(spark, sf_dir):
    words = docs(spark, sf_dir, "lang", F.explode(t.tokenize("text")).alias("word"))
    exclude = table(spark, sf_dir, "benchmark").select(F.explode(t.tokenize("text")).alias("word"))
    return lookup.stopword_set(words.filter("lang = 'en'"), words.filter("lang = 'de'"), exclude)


@query("remove_table_stopwords", f"""
WITH stop AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM benchmark),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, {S.tokens('text')} AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS r(i))
SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (word NOT IN (SELECT word FROM stop)), '') AS kept
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")
def remove_table_stopwords(spark, sf_dir):
    stop = table(spark, sf_dir, "benchmark").select(F.explode(t.tokenize("text")).alias("word"))
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    return lookup.remove_words(tokens, ["doc_id"], "tokens", stop).select("doc_id", t.join_tokens("tokens").alias("kept"))


@query("unique_tokens", f"SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents")
def unique_tokens(spark, sf_dir):
    return docs(spark, sf_dir, F.explode(t.tokenize("text")).alias("word")).select("word").distinct()


@query("vocab_composition", f"""
SELECT count(*) FILTER (regexp_matches(word, '\\b[A-Za-z]+\\b')) AS n_words,
       count(*) FILTER (NOT regexp_matches(word, '\\b[A-Za-z]+\\b')) AS n_other
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents)""")
def vocab_composition(spark, sf_dir):
    words = docs(spark, sf_dir, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word"))
    return agg.vocabulary_composition(words.select("word").distinct())


@query("top_terms", f"""
SELECT word, count(*) AS count FROM (SELECT unnest({S.tokens(S.cleaned('text'))}) AS word FROM documents)
GROUP BY word ORDER BY count DESC, word LIMIT 100""")
def top_terms(spark, sf_dir):
    cleaned = docs(spark, sf_dir, t.clean_text("text").alias("clean"))
    return agg.top_rows(voc.word_counts(cleaned, t.tokenize("clean")), 100)


# -- vocabulary ---------------------------------------------------------------

_COUNTS = f"SELECT word, count(*) AS count FROM (SELECT unnest({S.tokens('text')}) AS word FROM documents) GROUP BY word"


def _vocab_sql(size: int | None) -> str:
    limit = "" if size is None else f"LIMIT {size - 3}"
    return f"""vocab AS (SELECT * FROM (VALUES ('<s>', 0, 0::BIGINT), ('</s>', 1, 0), ('<unk>', 2, 0)) AS v(word, id, count)
 UNION ALL SELECT word, (row_number() OVER (ORDER BY count DESC, word) + 2)::INTEGER AS id, count
 FROM (SELECT * FROM ({_COUNTS}) ORDER BY count DESC, word {limit}))"""


def corpus_vocabulary(spark, sf_dir, size: int | None):
    return voc.vocabulary(voc.word_counts(table(spark, sf_dir, "documents"), t.tokenize("text")), size)


@query("vocabulary", f"WITH {_vocab_sql(20_000)} SELECT word, id, count FROM vocab")
def vocabulary(spark, sf_dir):
    return corpus_vocabulary(spark, sf_dir, 20_000).withColumn("id", F.col("id").cast("int"))


@query("full_vocabulary", f"WITH {_vocab_sql(None)} SELECT word, id, count FROM vocab")
def full_vocabulary(spark, sf_dir):
    """The ids as the SQL has them; the operator's are long."""
    return corpus_vocabulary(spark, sf_dir, None).withColumn("id", F.col("id").cast("int"))


_POSITIONS = f"""pos AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, {S.tokens('text')} AS ws FROM documents),
 unnest(range(1, len(ws) + 1)) AS r(i))"""
_IDS = f"""ids AS (SELECT doc_id, i, coalesce(id, 2) AS id FROM pos LEFT JOIN vocab USING (word))"""


def document_ids(spark, sf_dir):
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    return voc.words_to_ids(tokens, ["doc_id"], "tokens", corpus_vocabulary(spark, sf_dir, 20_000))


@query("words_to_ids", f"""
WITH {_vocab_sql(20_000)}, {_POSITIONS}, {_IDS}
SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM ids GROUP BY doc_id""")
def words_to_ids(spark, sf_dir):
    return document_ids(spark, sf_dir).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("ids_to_words", f"""
WITH {_vocab_sql(20_000)}, {_POSITIONS}, {_IDS}
SELECT doc_id, string_agg(v.word, ' ' ORDER BY i) AS words FROM ids JOIN vocab v USING (id) GROUP BY doc_id""")
def ids_to_words(spark, sf_dir):
    vocab = corpus_vocabulary(spark, sf_dir, 20_000)
    words = voc.ids_to_words(document_ids(spark, sf_dir), ["doc_id"], "ids", vocab)
    return words.select("doc_id", t.join_tokens("words").alias("words"))


@query("docs_to_ids", f"""
WITH {_vocab_sql(20_000)}, w AS (SELECT doc_id, {S.tokens('text')} AS w FROM documents),
padded AS (SELECT doc_id, CASE WHEN len(w) >= 2000 THEN w[1:2000]
  ELSE list_concat(['<pad>'], w, list_transform(range(1999 - len(w)), lambda x: '<pad>')) END AS ws FROM w),
pos AS (SELECT doc_id, i, ws[i] AS word FROM padded, unnest(range(1, len(ws) + 1)) AS r(i)), {_IDS}
SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM ids GROUP BY doc_id""")
def docs_to_ids(spark, sf_dir):
    padded = docs(spark, sf_dir, t.cut_or_pad(t.tokenize("text"), 2000).alias("tokens"))
    ids = voc.words_to_ids(padded, ["doc_id"], "tokens", corpus_vocabulary(spark, sf_dir, 20_000))
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("sentence_to_ids", f"""
WITH {_vocab_sql(20_000)}, {_POSITIONS}, {_IDS}
SELECT doc_id, '0 ' || string_agg(id::VARCHAR, ' ' ORDER BY i) || ' 1' AS ids FROM ids GROUP BY doc_id""")
def sentence_to_ids(spark, sf_dir):
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    ids = voc.sentence_to_ids(tokens, ["doc_id"], "tokens", corpus_vocabulary(spark, sf_dir, 20_000))
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("sentence_boundaries", f"""
SELECT doc_id, '<s> ' || array_to_string({S.tokens('text')}, ' ') || ' </s>' AS marked,
       '<s> ' || array_to_string({S.tokens('text')}, ' ') AS separated FROM documents""")
def sentence_boundaries(spark, sf_dir):
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    return tokens.select("doc_id", t.join_tokens(voc.sentence_boundaries("tokens")).alias("marked"),
                         t.join_tokens(voc.sentence_boundaries("tokens", end=False)).alias("separated"))


@query("next_word_pairs", f"""
WITH w AS (SELECT {S.tokens('text')} AS ws FROM documents)
SELECT ws[i] AS word, ws[i + 1] AS next_word, count(*) AS n FROM w, unnest(range(1, len(ws))) AS r(i) GROUP BY 1, 2""")
def next_word_pairs(spark, sf_dir):
    pairs = docs(spark, sf_dir, F.explode(t.next_words(t.tokenize("text"))).alias("p")).select("p.*")
    return pairs.groupBy("word", "next_word").agg(F.count(F.lit(1)).alias("n"))


@query("context_features", f"""
WITH w AS (SELECT doc_id, {S.tokens('text')} AS ws FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS pos, ws[i] AS word,
  CASE WHEN len(ws) = 1 THEN '<None>' WHEN i = 1 THEN '<START>' ELSE ws[i - 1] END AS prev_word,
  CASE WHEN len(ws) = 1 THEN '<None>' WHEN i = len(ws) THEN '<End>' ELSE ws[i + 1] END AS next_word
FROM w, unnest(range(1, len(ws) + 1)) AS r(i)""")
def context_features(spark, sf_dir):
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    return tokens.select("doc_id", F.posexplode(t.word_contexts("tokens")).alias("pos", "c")).select("doc_id", "pos", "c.*")


# -- term matrices ------------------------------------------------------------

_TERM = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_TF = f"tf AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_TERM}) AS term FROM documents) GROUP BY 1, 2)"
_TFIDF = f"""{_TF}, n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf, n GROUP BY term),
w AS (SELECT doc_id, term, c * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"""


@query("ngram_counts", f"""
WITH t AS (SELECT doc_id, {_TERM} AS ws FROM documents),
g AS (SELECT doc_id, unnest(ws) AS term FROM t
      UNION ALL SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM t, unnest(range(1, len(ws))) AS r(i)),
c AS (SELECT doc_id, term, count(*) AS count FROM g GROUP BY 1, 2),
top AS (SELECT term FROM c GROUP BY term ORDER BY sum(count) DESC, term LIMIT 1000)
SELECT doc_id, term, count FROM c WHERE term IN (SELECT term FROM top)""")
def ngram_counts(spark, sf_dir):
    return vectorize.ngram_counts(table(spark, sf_dir, "documents"), "doc_id", "text", (1, 2), 1000)


@query("tfidf", f"WITH {_TFIDF} SELECT doc_id, term, round(w / norm, 6) AS value FROM w JOIN norm USING (doc_id)")
def tfidf(spark, sf_dir):
    values = vectorize.tfidf_vectorizer(table(spark, sf_dir, "documents"), "doc_id", "text")
    return values.select("doc_id", "term", F.round("value", 6).alias("value"))


@query("term_doc_matrix", f"WITH {_TFIDF} SELECT doc_id, term, round(w / norm, 3) AS value FROM w JOIN norm USING (doc_id)")
def term_doc_matrix(spark, sf_dir):
    values = vectorize.tfidf_vectorizer(table(spark, sf_dir, "documents"), "doc_id", "text")
    return vectorize.term_doc_matrix(values, "doc_id")


@query("sort_terms", f"WITH {_TF} SELECT term, sum(c)::BIGINT AS total FROM tf GROUP BY term ORDER BY total DESC, term")
def sort_terms(spark, sf_dir):
    counts = vectorize.ngram_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return agg.term_totals(counts, value="count")


# -- word vectors -------------------------------------------------------------

# The vector table of the checks: the word with id i has embedding i.
_VECTORS_SQL = f"""{_vocab_sql(None)},
vectors AS (SELECT word, embedding AS vec FROM vocab JOIN embeddings ON id = vec_id)"""


def word_vector_table(spark, sf_dir):
    vocab = corpus_vocabulary(spark, sf_dir, None)
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"))
    return vocab.join(emb, "id").select("word", "vec")


def _vec_text(c, digits=6):
    return F.array_join(F.transform(c, lambda x: F.format_number(F.round(x.cast("double"), digits) + 0.0, digits)), " ")


@query("vectors_for_vocab", f"""
WITH {_VECTORS_SQL}, wanted AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM benchmark)
SELECT word, round(list_sum(vec), 5) AS total, len(vec)::INTEGER AS size FROM vectors WHERE word IN (SELECT word FROM wanted)""")
def vectors_for_vocab(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(t.tokenize("text")).alias("word"))
    found = vectorize.vectors_for_vocabulary(word_vector_table(spark, sf_dir), wanted)
    return found.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("vec").alias("size"))


@query("fill_unknown_vectors", f"""
WITH {_VECTORS_SQL}, wanted AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM benchmark),
drawn AS (SELECT word, i, -0.25 + 0.5 * ('0x' || substr(md5(word || ':' || i), 1, 8))::BIGINT / 4294967296.0 AS x
          FROM wanted, range(64) AS r(i) WHERE word NOT IN (SELECT word FROM vectors)),
have AS (SELECT word, unnest(range(64)) AS i, unnest(vec)::DOUBLE AS x FROM vectors WHERE word IN (SELECT word FROM wanted))
SELECT word, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT * FROM drawn UNION ALL SELECT * FROM have)""")
def fill_unknown_vectors(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(t.tokenize("text")).alias("word"))
    full = vectorize.fill_unknown_vectors(word_vector_table(spark, sf_dir), wanted, 64)
    return full.select("word", F.posexplode("vec").alias("i", "x")).select("word", "i", F.round("x", 6).alias("x"))


@query("mean_word_vector", f"""
WITH {_VECTORS_SQL}, w AS (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents),
x AS (SELECT doc_id, unnest(range(64)) AS i, unnest(vec)::DOUBLE AS x FROM w JOIN vectors USING (word)),
m AS (SELECT doc_id, i, avg(x) AS x FROM x GROUP BY 1, 2)
SELECT d.doc_id, r.i::INTEGER AS i, round(coalesce(m.x, 0), 6) AS x
FROM documents d CROSS JOIN range(64) AS r(i) LEFT JOIN m ON m.doc_id = d.doc_id AND m.i = r.i""")
def mean_word_vector(spark, sf_dir):
    tokens = docs(spark, sf_dir, t.tokenize("text").alias("tokens"))
    means = vectorize.mean_word_vector(tokens, "doc_id", "tokens", word_vector_table(spark, sf_dir), 64)
    return means.select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


@query("l2_normalize", """
SELECT vec_id, i::INTEGER AS i, round(x / norm, 6) AS x FROM (
  SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x,
         sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS norm FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v.l2_normalize("embedding")).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("x"))


@query("one_hot", """
SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS encoded FROM embeddings""")
def one_hot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(v.one_hot("label", 10).cast("array<string>"), "").alias("encoded"))


# -- statistics ---------------------------------------------------------------


@query("label_balance", """
SELECT count(*) AS n, sum(quality)::BIGINT AS n_positive, (count(*) - sum(quality))::BIGINT AS n_negative,
  round(100.0 * sum(quality) / count(*), 6)::DOUBLE AS pct_positive,
  round(100.0 * (count(*) - sum(quality)) / count(*), 6)::DOUBLE AS pct_negative FROM labels""")
def label_balance(spark, sf_dir):
    b = agg.label_balance(table(spark, sf_dir, "labels"), "quality")
    return b.withColumns({c: F.round(c, 6) for c in ("pct_positive", "pct_negative")})


@query("id_occurrences", """
SELECT occurrences, count(*) AS n_ids FROM (SELECT id, count(*) AS occurrences FROM (
  SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY id) GROUP BY occurrences""")
def id_occurrences(spark, sf_dir):
    return agg.id_occurrences(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("doc_length_stats", f"""
WITH l AS (SELECT len({S.tokens('text')}) AS n FROM documents)
SELECT count(*) AS n, max(n)::BIGINT AS max_length, min(n)::BIGINT AS min_length, round(avg(n), 6) AS mean_length,
  quantile_cont(n, 0.5)::DOUBLE AS median_length FROM l""")
def doc_length_stats(spark, sf_dir):
    lengths = docs(spark, sf_dir, F.size(t.tokenize("text")).alias("n_words"))
    return agg.length_stats(lengths, "n_words").withColumn("mean_length", F.round("mean_length", 6))


@query("histogram_width", """
SELECT floor(value / 5) * 5 AS bin_start, count(*) AS n FROM events WHERE value <> 0 GROUP BY 1""")
def histogram_width(spark, sf_dir):
    return agg.histogram_by_width(table(spark, sf_dir, "events").filter("value <> 0"), "value", 5)


@query("histogram_bins", """
WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents)
SELECT least(floor((n_chars - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def histogram_bins(spark, sf_dir):
    return agg.histogram_by_count(table(spark, sf_dir, "documents"), "n_chars", 50)


@query("exact_quantiles", """
SELECT event_type, q::DOUBLE AS q, round(CASE q WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5)
  ELSE quantile_cont(value, 0.9) END, 6) AS quantile
FROM events, (VALUES (0.1), (0.5), (0.9)) AS t(q) GROUP BY event_type, q""")
def exact_quantiles(spark, sf_dir):
    out = agg.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.5, 0.9])
    return out.withColumn("quantile", F.round("quantile", 6))


# -- splits and samples -------------------------------------------------------

_BUCKET = "('0x' || substr(md5({k}::VARCHAR || ':{s}'), 1, 8))::BIGINT"


@query("train_test_split", f"""
SELECT doc_id, CASE WHEN {_BUCKET.format(k='doc_id', s=10)} / 4294967296.0 >= 0.8 THEN 'test'
  WHEN {_BUCKET.format(k='doc_id', s=11)} / 4294967296.0 >= 0.8 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def train_test_split(spark, sf_dir):
    return sampling.three_way_split(docs(spark, sf_dir), "doc_id", 0.8, seed=10)


@query("contiguous_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split
FROM documents""")
def contiguous_split(spark, sf_dir):
    return sampling.contiguous_split(docs(spark, sf_dir), "doc_id", 0.8)


@query("head_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def head_rows(spark, sf_dir):
    return sampling.head(docs(spark, sf_dir, "n_chars"), 100, "doc_id")


@query("union_splits", """
SELECT l.doc_id, 'train' AS split, quality AS label FROM labels l WHERE toxic = 0
UNION ALL SELECT l.doc_id, 'test', quality FROM labels l WHERE toxic = 1""")
def union_splits(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.col("quality").alias("label"))
    return sampling.stack_splits({"train": labels.filter("toxic = 0").drop("toxic"), "test": labels.filter("toxic = 1").drop("toxic")})


# -- labelled corpus ----------------------------------------------------------


@query("corpus_subset", """
SELECT doc_id, source AS target_name, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS target
FROM documents WHERE source IN ('src1', 'src11', 'src3', 'src7')""")
def corpus_subset(spark, sf_dir):
    d = docs(spark, sf_dir, F.col("source").alias("target_name"))
    return source.labelled_subset(d, "target_name", ["src1", "src3", "src7", "src11"])


@query("random_classes", f"""
SELECT source AS class FROM (SELECT DISTINCT source FROM documents)
ORDER BY {_BUCKET.format(k='source', s=8)}, source LIMIT 7""")
def random_classes(spark, sf_dir):
    return source.random_classes(docs(spark, sf_dir, "source"), "source", 7, seed=8)


@query("id_cursor", """
SELECT (event_id // 100)::BIGINT AS page, count(*) AS n, min(event_id) AS min_id, max(event_id) AS max_id FROM events GROUP BY 1""")
def id_cursor(spark, sf_dir):
    paged = table(spark, sf_dir, "events").withColumn("page", F.expr("event_id div 100"))
    return source.page_cursors(paged, "page", "event_id")
