"""One query per operator over its whole table, and the SQL each must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, decontaminate, embeddings, licences, lines, minhash, packing, pii, quality, runs, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, source
  FROM documents WHERE text IS NOT NULL),
keyed AS (
  SELECT *, lower(trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k FROM lines),
wide AS (
  SELECT k, arg_min((doc_id, pos), (doc_id, pos)) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 5),
gone AS (
  SELECT doc_id, count(*) AS n, list(pos) AS gone FROM keyed JOIN wide USING (k) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CASE WHEN n IS NULL THEN text ELSE array_to_string(list_transform(list_filter(generate_series(1, len(string_split(text, chr(10)))),
    lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS clean_text
FROM documents d LEFT JOIN gone USING (doc_id)
"""


@_query("op1_line_dedup", _LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text free of cross-site boilerplate lines."""
    marked = lines.mark_boilerplate(_read(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
                         F.size("removed.positions").cast("long").alias("n_removed"), "removed.clean_text")


_ITEM_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_LEAKS_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
  SELECT doc_id, i, z.size, array_to_string(w[i:i + z.size - 1], ' ') AS p
  FROM d, sizes z, unnest(generate_series(1, len(w) - z.size + 1)) AS s(i) WHERE len(w) >= z.size),
found AS (SELECT doc_id, i, w.size, item_id FROM windows w JOIN patterns p ON w.size = p.size AND w.p = p.p),
hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM found, unnest(generate_series(i, i + size - 1)) AS s(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op3_decontamination", _LEAKS_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of a benchmark item covers."""
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.n_words", F.size("leak.hits").cast("long").alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "leak.items"), 256).alias("items_sha256"), (F.size("leak.hits") > 0).alias("contaminated"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The digest of ``packing.pack`` over documents, as ``op9_packing`` and the last stage of the pipeline return it."""
    return packing.pack(docs, tokenizer_path()).select(
        F.col("doc").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        "sequence_id", F.col("offset").cast("long").alias("offset"))


@_query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in sequences of 1024 ids."""
    return packed_pieces(_read(spark, sf_dir, "documents"))


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own form, its source and its language there."""
    scored = quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select(F.col("doc").alias("doc_id"), "p_document", "p_host", "p_path", "p_quality", "accepted")


_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0 AND isfinite(list_sum(e))),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.w FROM reach r JOIN links l ON r.other = l.u),
roots AS (SELECT vec_id, min(other) AS root FROM reach GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE u = v.vec_id) AS n_links, root AS component_id, v.vec_id = root AS kept
FROM v JOIN roots USING (vec_id)
"""


@_query("op4_embedding_dedup", _VECTORS_SQL)
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = embeddings.link_vectors(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


_WORDS = r"regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+')"
_NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
classes AS (SELECT list_sort(g) AS g, min(doc_id) AS c, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
grams AS (SELECT c, n, hash(unnest(g)) AS x FROM classes),
rare AS (SELECT x FROM grams GROUP BY x HAVING count(*) > 1),
shared AS (SELECT * FROM grams SEMI JOIN rare USING (x)),
links AS (SELECT a.c AS u, b.c AS v FROM shared a JOIN shared b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT c, c AS other FROM classes UNION SELECT r.c, l.v FROM reach r JOIN links l ON r.other = l.u),
roots AS (SELECT c, min(other) AS root FROM reach GROUP BY c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id, coalesce(root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes ON list_sort(s.g) = classes.g LEFT JOIN roots USING (c)
"""


@_query("op2_minhash_dedup", _NEAR_SQL)
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


_WARC_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS latest FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n
"""


@_query("op5_warc", _WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives."""
    def number(uri: str):
        return F.expr(f"try_cast(regexp_extract({uri}, '^page:(-?[0-9]+) ', 1) AS bigint)")

    back = warc.round_trip(_read(spark, sf_dir, "pages"))
    return back.select(number("target").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))


@_query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its private values; a real key is a secret of whoever runs this."""
    found = pii.pseudonymise(_read(spark, sf_dir, "documents"), key="not a secret")

    def count(kind: str):
        # One argument: a second one would be taken for the index.
        return F.size(F.filter("private.found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.PATTERNS), "private.clean_text")


@_query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its bytes in repeated strings of 400."""
    found = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is never learnt from."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), usable=~held_out)
    scored = toxicity.score(docs, model).withColumnRenamed("doc", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _licence_sql() -> str:
    """Places of the phrases, and of the templates by comparing every place, in SQL."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    index = ", ".join(f"({t}, {text(label)}, {place}, {text(word)}, {key})" for t, label, place, word, key in licences.postings())
    base = ", ".join(f"({text(p)}, {len(licences.words_of(p))}, {text(label)})" for p, label in licences.BASE_PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
phrases(p, size, label) AS (VALUES {base}),
postings(template, label, place, word, key) AS (VALUES {index}),
occ AS (SELECT r, i - 1 AS pos, w[i] AS word FROM d, unnest(generate_series(1, len(w))) AS s(i)),
places AS (SELECT r, i - 1 AS pos, label FROM d, phrases, unnest(generate_series(1, len(w) - size + 1)) AS s(i)
  WHERE len(w) >= size AND array_to_string(w[i:i + size - 1], ' ') = p),
df AS (SELECT word, count(DISTINCT r) AS n FROM occ SEMI JOIN postings USING (word) GROUP BY word),
weighted AS (SELECT t.*, CAST(1 + round(1000 * ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1))) AS BIGINT) AS weight
  FROM postings t LEFT JOIN df USING (word)),
sizes AS (SELECT template, count(*) FILTER (WHERE key) AS n_key, sum(weight) AS total FROM weighted GROUP BY template),
matched AS (SELECT r, template, label, pos - place AS at, sum(weight) AS weight, count(*) FILTER (WHERE key) AS n
  FROM occ JOIN weighted USING (word) GROUP BY ALL),
found AS (SELECT r, label, weight / total AS score FROM matched JOIN sizes USING (template) WHERE n = n_key),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found UNION SELECT r, label FROM places) GROUP BY r),
base AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
best AS (SELECT r, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(greatest(coalesce(score, 0), CASE WHEN n > 0 THEN {licences.BASE_SCORE} ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)
"""


@_query("op11_licence_scan", _licence_sql())
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases in every document, its licences and the score of the best one."""
    return licences.digest(licences.scan_licences(_read(spark, sf_dir, "documents"))).withColumnRenamed("doc", "doc_id")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth id by its checksum repeats some of its words up to the end, as the contract of ``op12`` has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        period = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))), " ")).otherwise("")

    # The words are handed on as a lambda's argument, or they would be found again for each of them.
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and its words without the repeats."""
    found = runs.find_runs(with_planted_repeats(_read(spark, sf_dir, "documents")))
    one = F.array_max(F.transform("periodic.runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.array_join(F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = found.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), one.alias("one"),
                           F.when(F.size("periodic.runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "periodic.collapsed")
    return longest.select("doc_id", "n_runs", (-F.col("one.col2")).alias("start"), F.col("one.length").alias("length"), (-F.col("one.col3")).alias("period"),
                          F.floor(1000 * F.col("one.length") / -F.col("one.col3")).alias("exponent_milli"),
                          F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenisers, and how usual its links are."""
    aligned = alignment.align_tokenizers(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return aligned.measures.withColumnRenamed("doc", "doc_id")
