"""Question pairs: each turn of a conversation with the next one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as t
from ..functions import vectors as v
from ..operators import pairs, sentiment, vectorize
from ..session import write_cut
from . import sql as S
from .catalog import query, table
from .corpus import _VECTORS_SQL, word_vector_table


def question_pairs(spark, sf_dir):
    """id, question1, question2, is_duplicate; a keyed self join, so one long
    conversation spreads over all tasks."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("question2"), F.col("role").alias("role2"))
    return turns.join(after, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question1"), "question2",
        F.when(F.col("role2") == "assistant", 1).otherwise(0).alias("is_duplicate"))


_PAIRS = """pairs AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS question1, b.text AS question2,
  CASE WHEN b.role = 'assistant' THEN 1 ELSE 0 END AS is_duplicate
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_TOKENS = _PAIRS + """,
tok AS (SELECT *, regexp_extract_all(CASE WHEN question1 = '' THEN 'empty string' ELSE lower(question1) END, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') AS a,
  regexp_extract_all(CASE WHEN question2 = '' THEN 'empty string' ELSE lower(question2) END, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') AS b FROM pairs),
s AS (SELECT *, len(list_intersect(a, b)) AS common, len(list_distinct(a)) AS da, len(list_distinct(b)) AS db FROM tok)"""
_SHARED = "(len(list_filter(a, lambda w: list_contains(b, w))) + len(list_filter(b, lambda w: list_contains(a, w)))) / (len(a) + len(b))::DOUBLE"
_OCHIAI = "common / (sqrt(len(a)) * sqrt(len(b)))"
_JACCARD = "common / (da + db - common)::DOUBLE"
_OVERLAP = "common / least(da, db)::DOUBLE"
_EDIT = _PAIRS + """, e AS (SELECT id, regexp_replace(question1, '[^A-Za-z0-9 \n]+', '', 'g') AS a,
  regexp_replace(question2, '[^A-Za-z0-9 \n]+', '', 'g') AS b FROM pairs)"""


def tokenized(spark, sf_dir):
    return question_pairs(spark, sf_dir).withColumn("a", t.pair_tokens("question1")).withColumn("b", t.pair_tokens("question2"))


def _score(name):
    def run(spark, sf_dir):
        return tokenized(spark, sf_dir).select("id", F.round(sim.pair_score(name, "a", "b"), 6).alias(name))

    return run


query("shared_words", f"WITH {_TOKENS} SELECT id, round({_SHARED}, 6) AS shared_words FROM s")(_score("shared_words"))
query("ochiai", f"WITH {_TOKENS} SELECT id, round({_OCHIAI}, 6) AS ochiai FROM s")(_score("ochiai"))
query("jaccard", f"WITH {_TOKENS} SELECT id, round({_JACCARD}, 6) AS jaccard FROM s")(_score("jaccard"))
query("overlap", f"WITH {_TOKENS} SELECT id, round({_OVERLAP}, 6) AS overlap FROM s")(_score("overlap"))


@query("pair_lengths", f"""
WITH {_PAIRS} SELECT id, length(question1)::INTEGER AS q1_length, length(question2)::INTEGER AS q2_length,
  len(string_split(question1, ' '))::INTEGER AS q1_numwords, len(string_split(question2, ' '))::INTEGER AS q2_numwords FROM pairs""")
def pair_lengths(spark, sf_dir):
    return question_pairs(spark, sf_dir).select(
        "id", F.length("question1").alias("q1_length"), F.length("question2").alias("q2_length"),
        pairs.word_count("question1").alias("q1_numwords"), pairs.word_count("question2").alias("q2_numwords"))


@query("unique_words", f"""
WITH {_TOKENS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(
    list_filter(a, lambda w: NOT list_contains(b, w)), list_filter(b, lambda w: NOT list_contains(a, w))))), ' ') AS words,
  (da + db - 2 * common)::INTEGER AS n FROM s""")
def unique_words(spark, sf_dir):
    words = tokenized(spark, sf_dir).select("id", sim.unique_words("a", "b").alias("w"))
    return words.select("id", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


@query("damerau_levenshtein", f"WITH {_EDIT} SELECT id, damerau_levenshtein(a, b)::INTEGER AS distance FROM e")
def damerau_levenshtein(spark, sf_dir):
    return question_pairs(spark, sf_dir).select("id", sim.pair_score("damerau_levenshtein", "question1", "question2").alias("distance"))


@query("jaro_winkler", f"WITH {_EDIT} SELECT id, round(jaro_winkler_similarity(a, b), 6) AS score FROM e")
def jaro_winkler(spark, sf_dir):
    return question_pairs(spark, sf_dir).select("id", F.round(sim.pair_score("jaro_winkler", "question1", "question2"), 6).alias("score"))


@query("hamming", f"""
WITH {_EDIT} SELECT id, (greatest(length(a), length(b)) - len(list_filter(range(1, least(length(a), length(b)) + 1),
  lambda i: a[i] = b[i])))::INTEGER AS distance FROM e""")
def hamming(spark, sf_dir):
    return question_pairs(spark, sf_dir).select("id", sim.pair_score("hamming", "question1", "question2").alias("distance"))


_FEATURES = f"""f AS (SELECT id, is_duplicate, length(question1)::INTEGER AS q1_length, length(question2)::INTEGER AS q2_length,
  len(string_split(question1, ' '))::INTEGER AS q1_numwords, len(string_split(question2, ' '))::INTEGER AS q2_numwords,
  {_SHARED} AS shared_words_norm, ({_JACCARD} + {_OVERLAP} + {_OCHIAI}) / 3.0 AS avg_similarity FROM s)"""
_SCORES = ("shared_words_norm", "avg_similarity")


@query("pair_features", f"""
WITH {_TOKENS}, {_FEATURES} SELECT id, is_duplicate, q1_length, q2_length, q1_numwords, q2_numwords,
  round(shared_words_norm, 6) AS shared_words_norm, round(avg_similarity, 6) AS avg_similarity FROM f""")
def pair_features(spark, sf_dir):
    features = pairs.pair_features(question_pairs(spark, sf_dir)).drop("question1", "question2")
    return features.withColumns({c: F.round(c, 6) for c in _SCORES})


@query("combine_pair", f"WITH {_PAIRS} SELECT id, question1 || ' ' || question2 AS combined FROM pairs")
def combine_pair(spark, sf_dir):
    return question_pairs(spark, sf_dir).select("id", pairs.combine_pair("question1", "question2").alias("combined"))


def pair_vectors(spark, sf_dir, source=None):
    """Mean word vectors of both questions and of the pair."""
    q = question_pairs(spark, sf_dir) if source is None else source
    vectors = word_vector_table(spark, sf_dir)
    sides = q.select(F.explode(F.array(*[F.struct(F.concat("id", F.lit(f"/{s}")).alias("key"), F.lit(s).alias("side"), F.col("id"), c.alias("t"))
                                         for s, c in ((1, F.col("question1")), (2, F.col("question2")),
                                                      (0, pairs.combine_pair("question1", "question2")))])).alias("x")).select("x.*")
    tokens = sides.withColumn("tokens", t.tokenize("t"))
    means = vectorize.mean_word_vector(tokens, "key", "tokens", vectors, 64)
    by_id = means.select(F.split("key", "/")[0].alias("id"), F.split("key", "/")[1].cast("int").alias("side"), "vec")
    return by_id.groupBy("id").agg(*[F.max(F.when(F.col("side") == s, F.col("vec"))).alias(n) for s, n in ((0, "vec"), (1, "vec1"), (2, "vec2"))])


_MEANS = f"""{_PAIRS}, {_VECTORS_SQL},
sides AS (SELECT id, 1 AS side, question1 AS t FROM pairs UNION ALL SELECT id, 2, question2 FROM pairs
          UNION ALL SELECT id, 0, question1 || ' ' || question2 FROM pairs),
w AS (SELECT id, side, unnest({S.tokens('t')}) AS word FROM sides),
x AS (SELECT id, side, unnest(range(64)) AS i, unnest(vec)::DOUBLE AS x FROM w JOIN vectors USING (word)),
m AS (SELECT id, side, i, avg(x) AS x FROM x GROUP BY 1, 2, 3)"""


@query("vector_cosine", f"""
WITH {_MEANS}, p AS (SELECT a.id, sum(a.x * b.x) AS ab FROM m a JOIN m b ON a.id = b.id AND a.i = b.i AND a.side = 1 AND b.side = 2 GROUP BY a.id),
n AS (SELECT id, sqrt(sum(x * x) FILTER (side = 1)) AS na, sqrt(sum(x * x) FILTER (side = 2)) AS nb FROM m GROUP BY id)
SELECT pairs.id, round(coalesce(CASE WHEN na * nb > 0 THEN ab / (na * nb) END, 0), 6) AS cosine
FROM pairs LEFT JOIN p USING (id) LEFT JOIN n USING (id)""")
def vector_cosine(spark, sf_dir):
    return pair_vectors(spark, sf_dir).select("id", F.round(v.cosine("vec1", "vec2"), 6).alias("cosine"))


_SCALE = ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE * (hi - lo) + lo, 6) AS {c}" for c in pairs.SCALED_COLUMNS)


@query("min_max_scale", f"""
WITH {_MEANS}, full_vectors AS (SELECT coalesce(m.x, 0) AS x FROM pairs CROSS JOIN range(64) AS r(i)
  LEFT JOIN m ON m.id = pairs.id AND m.i = r.i AND m.side = 0),
e AS (SELECT round(min(x), 2) AS lo, round(max(x), 2) AS hi FROM full_vectors),
{_TOKENS.removeprefix(_PAIRS + ',')}, {_FEATURES}
SELECT id, {_SCALE} FROM f, e""")
def min_max_scale(spark, sf_dir):
    q = question_pairs(spark, sf_dir)
    limits = pairs.vector_range(pair_vectors(spark, sf_dir, q))
    scaled = pairs.min_max_scale(pairs.pair_features(q), pairs.SCALED_COLUMNS, limits["low"], limits["high"])
    return scaled.select("id", *[F.round(c, 6).alias(c) for c in pairs.SCALED_COLUMNS])


# Polarity, subjectivity and nouns derived from the labelled documents: how a
# word's documents are labelled, and its ending.
_LEXICON = f"""lexicon AS (SELECT word, round(2 * avg(quality) - 1, 6) AS polarity, round(avg(toxic), 6) AS subjectivity,
  CASE WHEN word LIKE '%tion' THEN 1.0::DOUBLE ELSE 0.0 END AS is_noun
  FROM (SELECT doc_id, unnest({S.tokens('text')}) AS word FROM documents) JOIN labels USING (doc_id) GROUP BY word)"""


def polarity_lexicon(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokenize("text")).alias("word"))
    return words.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("word").agg(
        F.round(2 * F.avg("quality") - 1, 6).alias("polarity"), F.round(F.avg("toxic"), 6).alias("subjectivity")).withColumn(
        "is_noun", F.when(F.col("word").like("%tion"), 1.0).otherwise(0.0))


@query("pair_lexicon_diff", f"""
WITH {_PAIRS}, {_LEXICON},
w AS (SELECT id, side, unnest(regexp_extract_all(lower(t), {S.CHUNKS})) AS word FROM (
  SELECT id, 1 AS side, question1 AS t FROM pairs UNION ALL SELECT id, 2, question2 FROM pairs)),
h AS (SELECT id, coalesce(avg(polarity) FILTER (side = 1), 0) AS p1, coalesce(avg(polarity) FILTER (side = 2), 0) AS p2,
  coalesce(avg(subjectivity) FILTER (side = 1), 0) AS s1, coalesce(avg(subjectivity) FILTER (side = 2), 0) AS s2,
  coalesce(sum(is_noun) FILTER (side = 1), 0) AS n1, coalesce(sum(is_noun) FILTER (side = 2), 0) AS n2
  FROM w JOIN lexicon USING (word) GROUP BY id)
SELECT pairs.id, round(coalesce(CASE WHEN n1 + n2 > 0 THEN abs(n1 - n2) / (n1 + n2) END, 0), 6)::DOUBLE AS noun_diff,
  round(coalesce(abs(p1 - p2), 0), 6) AS polarity_diff, round(coalesce(abs(s1 - s2), 0), 6) AS subjectivity_diff
FROM pairs LEFT JOIN h USING (id)""")
def pair_lexicon_diff(spark, sf_dir):
    diff = sentiment.pair_lexicon_difference(question_pairs(spark, sf_dir), "id", "question1", "question2", polarity_lexicon(spark, sf_dir))
    return diff.select("id", *[F.round(c, 6).alias(c) for c in ("noun_diff", "polarity_diff", "subjectivity_diff")])


def pair_matrix(spark, sf_dir):
    """Mean vector, cosine and scaled scalars as one feature vector, with the label."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    q = question_pairs(spark, sf_dir)
    vectors = write_cut(pair_vectors(spark, sf_dir, q), "pair-vectors")        # read for the range and for the rows
    limits = pairs.vector_range(vectors)
    scaled = pairs.min_max_scale(pairs.pair_features(q), pairs.SCALED_COLUMNS, limits["low"], limits["high"])
    joined = scaled.join(vectors, "id").select(
        "id", F.col("is_duplicate").alias("label"), array_to_vector("vec").alias("mean_vec"), v.cosine("vec1", "vec2").alias("cosine"), *pairs.SCALED_COLUMNS)
    assembler = VectorAssembler(inputCols=["mean_vec", "cosine", *pairs.SCALED_COLUMNS], outputCol="features")
    return assembler.transform(joined).select("id", "label", "features")


@query("assembled_features")
def assembled_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    return pair_matrix(spark, sf_dir).select("id", "label", F.posexplode(vector_to_array("features")).alias("i", "x"))
