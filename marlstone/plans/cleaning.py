"""Text cleaning over the documents: row-wise projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.wordlists import UNIMPORTANT_TAGS
from ..operators import lookup
from . import sql as S
from .catalog import query, table


def docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query("clean_text", f"SELECT doc_id, {S.cleaned('text')} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir, t.clean_text("text").alias("clean"))


@query("lower_all", "SELECT doc_id, lower(text) AS lowered FROM documents")
def lower_all(spark, sf_dir):
    return docs(spark, sf_dir, t.lower_all("text").alias("lowered"))


@query("remove_punctuation", f"""
SELECT doc_id, {S.no_punctuation('text')} AS plain,
       regexp_replace(text, '[!-"$-?\\[-`{{-~]', '', 'g') AS kept_marks FROM documents""")
def remove_punctuation(spark, sf_dir):
    return docs(spark, sf_dir, t.remove_punctuation("text").alias("plain"),
                t.remove_punctuation(t.remove_numeric("text"), ignore="@#").alias("kept_marks"))


@query("remove_numeric", "SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS plain FROM documents")
def remove_numeric(spark, sf_dir):
    return docs(spark, sf_dir, t.remove_numeric("text").alias("plain"))


@query("tokenize", f"SELECT doc_id, array_to_string({S.tokens('text')}, '|') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return docs(spark, sf_dir, F.array_join(t.tokenize("text"), "|").alias("tokens"))


@query("whitespace_tokens", f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {S.CHUNKS}), '|') AS tokens FROM documents""")
def whitespace_tokens(spark, sf_dir):
    return docs(spark, sf_dir, F.array_join(t.whitespace_tokens("text"), "|").alias("tokens"))


@query("remove_stopwords", f"SELECT doc_id, {S.no_stopwords('text')} AS kept FROM documents")
def remove_stopwords(spark, sf_dir):
    return docs(spark, sf_dir, t.remove_stopwords("text").alias("kept"))


@query("remove_split_stopwords", f"""
WITH kept AS (SELECT doc_id, list_filter(regexp_extract_all(text, {S.CHUNKS}),
                lambda w: NOT list_contains({S.STOP}, lower(w))) AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word, coalesce(list_contains({S.STOP}, ws[i] || ws[i + 1]), false) AS hit
      FROM kept, unnest(range(1, len(ws) + 1)) AS r(i)),
runs AS (SELECT *, i - max(CASE WHEN NOT hit THEN i ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM w),
marked AS (SELECT *, hit AND depth % 2 = 1 AS starts FROM runs),
gone AS (SELECT *, starts OR coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY i), false) AS dropped FROM marked)
SELECT d.doc_id, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT dropped), '') AS kept
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id""")
def remove_split_stopwords(spark, sf_dir):
    return docs(spark, sf_dir, t.remove_stopwords("text", splitwords=True).alias("kept"))


@query("remove_short_tokens", f"""
SELECT doc_id, array_to_string(list_filter({S.tokens('text')}, lambda w: length(w) >= 3), ' ') AS kept FROM documents""")
def remove_short_tokens(spark, sf_dir):
    return docs(spark, sf_dir, t.remove_short_tokens("text").alias("kept"))


# A few surface variants found in the documents, as a caller would supply them.
VARIANTS = {"tion": "ation", "ting": "ing", "les": "le", "der": "die", "los": "el", "thes": "the"}


@query("consolidate_words", f"""
SELECT doc_id, array_to_string(list_transform({S.tokens('text')}, lambda w: CASE w
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in VARIANTS.items())} ELSE w END), ' ') AS consolidated FROM documents""")
def consolidate_words(spark, sf_dir):
    return docs(spark, sf_dir, t.consolidate_words("text", VARIANTS).alias("consolidated"))


@query("stem_tokens")
def stem_tokens(spark, sf_dir):
    from ..functions.stemming import stem_tokens as stem

    return docs(spark, sf_dir, t.join_tokens(stem(t.tokenize("text"), "porter")).alias("stems"))


# Lemma table derived from the corpus: a word with a plural s whose stem also
# occurs is the plural of it.
_LEMMAS_SQL = f"""
words AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents),
lemmas AS (SELECT a.word, b.word AS lemma FROM words a JOIN words b ON a.word = b.word || 's')"""


def lemma_table(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(t.tokenize("text")).alias("word")).distinct()
    plural = words.select(F.col("word").alias("lemma"), F.concat("word", F.lit("s")).alias("word"))
    return plural.join(words, "word", "left_semi").select("word", F.lit("n").alias("tag"), "lemma")


@query("lemmatize_lookup", f"""
WITH {_LEMMAS_SQL}, t AS (SELECT doc_id, {S.tokens('text')} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word FROM t, unnest(range(1, len(ws) + 1)) AS r(i)),
j AS (SELECT doc_id, i, coalesce(lemma, p.word) AS w FROM p LEFT JOIN lemmas USING (word))
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS lemmas
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""")
def lemmatize_lookup(spark, sf_dir):
    out = lookup.lemmatize(docs(spark, sf_dir, "text"), ["doc_id"], "text", lemma_table(spark, sf_dir))
    return out.withColumnRenamed("text", "lemmas")


@query("sentence_split", """
WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS pos, parts[i] AS sentence FROM s, unnest(range(1, len(parts) + 1)) AS r(i)""")
def sentence_split(spark, sf_dir):
    sentences = docs(spark, sf_dir, F.posexplode(t.sentence_split("text")).alias("pos", "sentence"))
    return sentences


# A stand-in tagger for the checks: tags follow from the word's ending.
_TAG = ("CASE WHEN {w} IN ('the', 'of', 'der', 'la') THEN 'DT' WHEN {w} LIKE '%ing' THEN 'VBG' WHEN {w} LIKE '%tion' "
        "THEN 'NN' WHEN {w} LIKE '%ly' THEN 'RB' WHEN {w} LIKE '%ed' THEN 'JJ' WHEN {w} LIKE '%er' THEN 'JJR' ELSE 'CD' END")
_TAGGED_SQL = f"list_transform({S.tokens('text')}, lambda w: {{'word': w, 'tag': {_TAG.format(w='w')}}})"


def tagged(spark, sf_dir):
    words = docs(spark, sf_dir, t.tokenize("text").alias("ws"))
    return words.select("doc_id", F.expr(
        f"transform(ws, w -> named_struct('word', w, 'tag', {_TAG.format(w='w')}))").alias("tagged"))


# Every word of the corpus whose end -ed or -ing leaves another word of it is a variant of that.
_VARIANT_TABLE = f"""words AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents),
variants AS (SELECT a.word, min(b.word) AS canonical FROM words b, (VALUES ('ed'), ('ing')) AS e(ending) JOIN words a ON a.word = b.word || e.ending GROUP BY a.word)"""


@query("consolidate_by_table", f"""
WITH {_VARIANT_TABLE}, t AS (SELECT doc_id, {S.tokens('text')} AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word FROM t, unnest(range(1, len(ws) + 1)) AS r(i)),
j AS (SELECT doc_id, i, coalesce(canonical, p.word) AS w FROM p LEFT JOIN variants USING (word))
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS consolidated
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""")
def consolidate_by_table(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(t.tokenize("text")).alias("word")).distinct()
    longer = words.select(F.col("word").alias("canonical"), F.explode(F.array(*[F.concat("word", F.lit(e)) for e in ("ed", "ing")])).alias("word"))
    variants = longer.join(words, "word", "left_semi").withColumnRenamed("word", "variant")
    return lookup.consolidate_by_table(docs(spark, sf_dir, "text"), ["doc_id"], "text", variants).withColumnRenamed("text", "consolidated")


# Nouns lose an s, verbs an ed, where the shorter word is one of the corpus.
_TAGGED_LEMMAS = f"""words AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents),
lemmas AS (SELECT a.word, e.tag, b.word AS lemma FROM words b, (VALUES ('n', 's'), ('v', 'ed')) AS e(tag, ending) JOIN words a ON a.word = b.word || e.ending)"""
_WORD_TAG = "CASE WHEN word LIKE '%ed' THEN 'v' WHEN word LIKE '%ly' THEN 'r' WHEN word LIKE '%ss' THEN 'n' END"


def tagged_lemma_table(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(t.tokenize("text")).alias("word")).distinct()
    endings = F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), F.concat("word", F.lit(e)).alias("longer")) for tag, e in (("n", "s"), ("v", "ed"))]))
    longer = words.select(F.col("word").alias("lemma"), endings.alias("e")).select(F.col("e.longer").alias("word"), "e.tag", "lemma")
    return longer.join(words, "word", "left_semi").select("word", "tag", "lemma")


@query("lemmatize_tagged", f"""
WITH {_TAGGED_LEMMAS}, t AS (SELECT doc_id, {S.tokens('text')} AS ws FROM documents),
p AS (SELECT *, coalesce({_WORD_TAG}, 'n') AS tag FROM (SELECT doc_id, i, ws[i] AS word FROM t, unnest(range(1, len(ws) + 1)) AS r(i))),
j AS (SELECT doc_id, i, coalesce(lemma, p.word) AS w FROM p LEFT JOIN lemmas USING (word, tag))
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS lemmas
FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id""")
def lemmatize_tagged(spark, sf_dir):
    """Words with a tag or none; no tag means noun."""
    words = docs(spark, sf_dir, t.tokenize("text").alias("ws")).select("doc_id", F.expr(
        f"transform(coalesce(ws, array()), word -> named_struct('word', word, 'tag', {_WORD_TAG}))").alias("tagged"))
    out = lookup.lemmatize_tagged(words, ["doc_id"], "tagged", tagged_lemma_table(spark, sf_dir), "n")
    return out.select("doc_id", F.array_join("tagged", " ").alias("lemmas"))


def _slashed(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["word"], F.coalesce(x["tag"], F.lit("-")))), " ")


@query("sanitize_tags", f"""
SELECT doc_id, array_to_string(list_transform({_TAGGED_SQL}, lambda x: x.word || '/' || CASE
  WHEN x.tag LIKE 'V%' THEN 'v' WHEN x.tag LIKE 'N%' THEN 'n' WHEN x.tag LIKE 'J%' THEN 'a'
  WHEN x.tag LIKE 'RB%' THEN 'r' ELSE '-' END), ' ') AS tagged FROM documents""")
def sanitize_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", _slashed(t.check_tags(t.sanitize_tags("tagged"))).alias("tagged"))


@query("filter_tags", f"""
SELECT doc_id, array_to_string(list_transform(list_filter({_TAGGED_SQL},
  lambda x: NOT list_contains([{S.literals(UNIMPORTANT_TAGS)}], x.tag)), lambda x: x.word || '/' || x.tag), ' ') AS tagged
FROM documents""")
def filter_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", _slashed(t.filter_tags("tagged", UNIMPORTANT_TAGS)).alias("tagged"))


@query("combine_tags", f"""
SELECT doc_id, array_to_string(list_transform({_TAGGED_SQL}, lambda x: x.word || x.tag), ' ') AS combined FROM documents""")
def combine_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", t.join_tokens(t.combine_tags("tagged")).alias("combined"))


@query("split_substrings", f"""
WITH w AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents)
SELECT word, array_to_string(list_concat(
  CASE WHEN length(word) >= 4 THEN list_transform(range(1, length(word) - 2), lambda i: substr(word, i)) ELSE [] END,
  CASE WHEN length(word) > 4 THEN list_transform(range(4, length(word)), lambda k: substr(word, 1, k)) ELSE [] END), '|') AS parts
FROM w""")
def split_substrings(spark, sf_dir):
    words = docs(spark, sf_dir, F.explode(t.tokenize("text")).alias("word")).select("word").distinct()
    return words.select("word", F.array_join(t.split_substrings("word", 4), "|").alias("parts"))


PHRASE_RULES = """
# position, text, replacement
START The A
END . !
ALL tion TION
EQUAL A. one
"""


@query("phrase_rules", """
WITH a AS (SELECT doc_id, CASE WHEN starts_with(text, 'The') THEN 'A' || substr(text, 4) ELSE text END AS t FROM documents),
b AS (SELECT doc_id, CASE WHEN ends_with(t, '.') THEN left(t, length(t) - 1) || '!' ELSE t END AS t FROM a)
SELECT doc_id, CASE WHEN replace(t, 'tion', 'TION') = 'A.' THEN 'one' ELSE replace(t, 'tion', 'TION') END AS phrased FROM b""")
def phrase_rules(spark, sf_dir):
    return docs(spark, sf_dir, t.clean_specific_phrases("text", PHRASE_RULES).alias("phrased"))


@query("strip_entities", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+', '', 'g'), '#\\S+', '', 'g'),
  '@\\S+', '', 'g'), 'u''RT\\S+', '', 'g') AS stripped FROM documents""")
def strip_entities(spark, sf_dir):
    return docs(spark, sf_dir, t.strip_entities("text").alias("stripped"))


@query("clean_str_contractions", f"SELECT doc_id, {S.normalised('text')} AS normalised FROM documents")
def clean_str_contractions(spark, sf_dir):
    return docs(spark, sf_dir, t.normalise_sentence("text").alias("normalised"))


@query("clean_str_pairs", f"SELECT doc_id, {S.normalised('text', False, '-')} AS normalised FROM documents")
def clean_str_pairs(spark, sf_dir):
    return docs(spark, sf_dir, t.normalise_sentence("text", contractions=False, keep="-").alias("normalised"))


_DOC_TOKENS = (f"list_filter(regexp_extract_all({S.no_punctuation(S.normalised('text'))}, {S.CHUNKS}), "
               f"lambda w: NOT list_contains({S.STOP}, w))")


@query("preprocess_stop_stem", f"SELECT doc_id, array_to_string({_DOC_TOKENS}, ' ') AS tokens FROM documents")
def preprocess_stop_stem(spark, sf_dir):
    return docs(spark, sf_dir, t.join_tokens(t.stop_stem_tokens(t.normalise_sentence("text"), stop=True)).alias("tokens"))


@query("cut_or_pad", f"""
WITH t AS (SELECT doc_id, {_DOC_TOKENS} AS w FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(w) >= 2000 THEN w[1:2000]
  ELSE list_concat(['<pad>'], w, list_transform(range(1999 - len(w)), lambda x: '<pad>')) END, ' ') AS padded FROM t""")
def cut_or_pad(spark, sf_dir):
    return docs(spark, sf_dir, t.join_tokens(t.prepare_document("text", 2000)).alias("padded"))


@query("preprocess_question", f"""
SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all({S.normalised('text', False, '-')}, {S.CHUNKS}),
  lambda w: NOT list_contains({S.STOP}, w)), ' ') AS question FROM conversations""")
def preprocess_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.prepare_question("text").alias("question"))


_DIGITS = ("CASE WHEN regexp_matches({w}, '\\p{{L}}') THEN {w} WHEN starts_with(regexp_replace({w}, '[0-9]', 'DG', 'g'), 'DG') "
           "THEN replace(regexp_replace({w}, '[0-9]', 'DG', 'g'), ',', '') ELSE regexp_replace({w}, '[0-9]', 'DG', 'g') END")


@query("canonicalize_digits", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, {S.CHUNKS})) AS word FROM documents)
SELECT word, {_DIGITS.format(w='word')} AS canonical FROM w""")
def canonicalize_digits(spark, sf_dir):
    words = docs(spark, sf_dir, F.explode(t.whitespace_tokens("text", lower=False)).alias("word")).select("word").distinct()
    return words.select("word", t.canonical_digits("word").alias("canonical"))


@query("canonicalize_word", f"""
WITH w AS (SELECT unnest(regexp_extract_all(text, {S.CHUNKS})) AS word FROM documents),
known AS (SELECT DISTINCT {_DIGITS.format(w='k')} AS k FROM (SELECT unnest(regexp_extract_all(lower(text), {S.CHUNKS})) AS k FROM benchmark)),
d AS (SELECT DISTINCT word, lower(word) AS low, {_DIGITS.format(w='lower(word)')} AS dig FROM w)
SELECT word, CASE WHEN a.k IS NOT NULL THEN low WHEN b.k IS NOT NULL THEN dig ELSE '<unk>' END AS canonical
FROM d LEFT JOIN known a ON a.k = low LEFT JOIN known b ON b.k = dig""")
def canonicalize_word(spark, sf_dir):
    words = docs(spark, sf_dir, F.explode(t.whitespace_tokens("text", lower=False)).alias("word")).select("word").distinct()
    vocab = table(spark, sf_dir, "benchmark").select(F.explode(t.whitespace_tokens("text")).alias("word")).select(
        t.canonical_digits("word").alias("word"))
    return lookup.canonicalize_words(words, "word", vocab).select("word", "canonical")


@query("cleanse_pairs", """
SELECT conv_id, turn, array_to_string(regexp_extract_all(CASE WHEN coalesce(text, '') = '' THEN 'empty string' ELSE lower(text) END,
  '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]'), ' ') AS tokens FROM conversations""")
def cleanse_pairs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.join_tokens(t.pair_tokens("text")).alias("tokens"))


_QUOTED = "(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)"


@query("strip_message_parts", f"""
WITH l AS (SELECT doc_id, text, trim(text) AS body, string_split(trim(text), chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, text, ls, list_max(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^\\s*-*\\s*$') THEN i - 1 END)) AS cut FROM l),
b AS (SELECT doc_id, CASE WHEN cut > 0 THEN array_to_string(ls[1:cut], chr(10)) ELSE text END AS t FROM f)
SELECT doc_id, coalesce(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '{_QUOTED}')), chr(10)), '') AS body,
       CASE WHEN strpos(d.text, chr(10) || chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10) || chr(10)) + 2) ELSE '' END AS after_header
FROM b JOIN documents d USING (doc_id)""")
def strip_message_parts(spark, sf_dir):
    return docs(spark, sf_dir, t.strip_message_parts("text", headers=False).alias("body"),
                t.strip_message_parts("text", quotes=False, footers=False).alias("after_header"))
