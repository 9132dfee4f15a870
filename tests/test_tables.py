"""Aggregates, de-duplication, look-ups, vocabularies, vectors, splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as t
from marlstone.operators import aggregates as agg
from marlstone.operators import dedup, lookup, sampling, vectorize
from marlstone.operators import vocabulary as voc


def test_exact_quantiles_with_a_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([0.0, 1.0, rng.random()])) for _ in range(5000)] + [("b", rng.gauss(0, 1)) for _ in range(333)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.853, 0.9, 1.0]
    for accuracy in (10, 10000):        # a poor sketch must not change the answer
        got = {(r.g, r.q): r.quantile for r in agg.exact_quantiles(df, ["g"], "x", qs, accuracy).collect()}
        assert len(got) == 3 * len(qs)
        for g in ("hot", "b", "one"):
            want = np.quantile([x for k, x in rows if k == g], qs)
            assert [got[g, q] for q in qs] == pytest.approx(list(want), abs=1e-12)


def test_length_stats_and_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    row = agg.length_stats(df, "x").first()
    assert tuple(row) == (4, 10, 1, 4.0, 2.5)
    assert {r.bin: r.n for r in agg.histogram_by_count(df, "x", 3).collect()} == {0: 3, 2: 1}
    assert {r.bin_start: r.n for r in agg.histogram_by_width(df, "x", 5).collect()} == {0.0: 3, 10.0: 1}
    assert agg.histogram_by_count(df.filter("x = 2"), "x", 5).collect()[0].bin == 0


def test_balance_and_occurrences(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (1, 1, 1)], "a int, b int, label int")
    assert tuple(agg.label_balance(df, "label").first())[:3] == (3, 2, 1)
    assert {r.occurrences: r.n_ids for r in agg.id_occurrences(df, "a", "b").collect()} == {3: 1, 2: 1, 1: 1}
    assert agg.nonzero_rate(df, ["a"], "label").orderBy("a").collect()[1].purchase_rate == 0.0


def test_dedup_rules(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c"), (4, None, "d"), (5, None, "e")], "id int, text string, m string")
    assert [r.id for r in dedup.drop_all_duplicates(df, ["text"]).collect()] == [3]
    assert sorted(r.id for r in dedup.first_wins(df.repartition(3), ["text"], ["id"]).collect()) == [1, 3, 4]
    target = spark.createDataFrame([("y",)], "text string")
    assert sorted(r.id for r in dedup.insert_if_absent(df, target, ["text"], ["id"], "text", "x").collect()) == [4]


def test_word_owner_counts_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("mno"), "hot" if rng.random() < 0.4 else rng.choice(["p", "q", "r"])) for i in range(400)]
    owner, count = {}, {}
    for _, movie, word in rows:
        owner.setdefault(word, movie)
        count[word] = count.get(word, 0) + (owner[word] == movie)
    df = spark.createDataFrame(rows, "at int, movie string, word string").repartition(5)
    got = dedup.word_owner_counts(df, "word", "movie", ["at"]).collect()
    assert {r.word: (r.movie, r["count"]) for r in got} == {w: (owner[w], count[w]) for w in owner}


def test_lookups(spark):
    df = spark.createDataFrame([(1, ["The", "cats", "ran"]), (2, []), (3, ["the"])], "id int, w array<string>")
    stop = spark.createDataFrame([("the",)], "word string")
    assert {r.id: r.w for r in lookup.remove_words(df, ["id"], "w", stop).collect()} == {1: ["cats", "ran"], 2: [], 3: []}
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("ran", "v", "run")], "word string, tag string, lemma string")
    texts = spark.createDataFrame([(1, "Cats ran"), (2, "!")], "id int, text string")
    assert {r.id: r.text for r in lookup.lemmatize(texts, ["id"], "text", lemmas).collect()} == {1: "cat ran", 2: ""}
    tagged = spark.sql("SELECT 1 AS id, array(named_struct('word', 'ran', 'tag', 'v'), named_struct('word', 'cats', 'tag', CAST(NULL AS STRING))) AS a")
    assert lookup.lemmatize_tagged(tagged, ["id"], "a", lemmas).first().a == ["run", "cats"]
    words = spark.createDataFrame([("Cat",), ("12",), ("dog",)], "word string")
    vocab = spark.createDataFrame([("cat",), ("DGDG",)], "word string")
    assert {r.word: r.canonical for r in lookup.canonicalize_words(words, "word", vocab).collect()} == {"Cat": "cat", "12": "DGDG", "dog": "<unk>"}
    assert {r.canonical for r in lookup.canonicalize_words(words).collect()} == {"cat", "DGDG", "dog"}
    extra, out = spark.createDataFrame([("b",)], "word string"), spark.createDataFrame([("the",)], "word string")
    assert [r.word for r in lookup.stopword_set(stop, extra, out).collect()] == ["b"]


def test_vocabulary_orders(spark):
    rng = random.Random(4)
    tokens = [rng.choice(["aa", "ab", "b", "ca", "cb", "d%d" % rng.randrange(60)]) for _ in range(500)]
    df = spark.createDataFrame([(tokens[:250],), (tokens[250:],)], "w array<string>").repartition(2)
    counts = voc.word_counts(df, "w")
    want = sorted(set(tokens), key=lambda w: (-tokens.count(w), w))
    full = {r.id: r.word for r in voc.vocabulary(counts).collect()}
    assert [full[i] for i in range(3)] == ["<s>", "</s>", "<unk>"]
    assert [full[i + 3] for i in range(len(want))] == want
    small = voc.vocabulary(counts, 10)
    assert [r.word for r in voc.ordered_words(small).collect()] == ["<s>", "</s>", "<unk>", *want[:7]]
    docs = spark.createDataFrame([(1, [want[0], "never", want[1]])], "id int, w array<string>")
    assert voc.words_to_ids(docs, ["id"], "w", small).first().ids == [3, 2, 4]
    assert voc.sentence_to_ids(docs, ["id"], "w", small).first().ids == [0, 3, 2, 4, 1]
    back = voc.ids_to_words(voc.words_to_ids(docs, ["id"], "w", small), ["id"], "ids", small).first().words
    assert back == [want[0], "<unk>", want[1]]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "!")], "id int, text string")
    got = {(r.id, r.term): r.value for r in vectorize.tfidf_vectorizer(df, "id", "text").collect()}
    idf = {w: np.log(4 / (1 + n)) + 1 for w, n in (("aa", 2), ("bb", 1), ("cc", 1))}
    one = np.array([2 * idf["aa"], idf["bb"]])
    assert got[1, "aa"] == pytest.approx(one[0] / np.linalg.norm(one))
    assert sum(v * v for (d, _), v in got.items() if d == 2) == pytest.approx(1.0)
    plain = {(r.id, r.term): r.value for r in vectorize.tfidf_vectorizer(df, "id", "text", use_idf=False).collect()}
    assert plain[1, "aa"] == pytest.approx(2 / 5 ** 0.5)
    top = vectorize.ngram_counts(df, "id", "text", (1, 2), 1).collect()
    assert {(r.id, r.term, r["count"]) for r in top} == {(1, "aa", 2), (2, "aa", 1)}


def test_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, ["a", "a", "b", "z"]), (2, ["z"]), (3, [])], "id int, w array<string>")
    got = {r.id: r.vec for r in vectorize.mean_word_vector(docs, "id", "w", vectors, 2).collect()}
    assert got[1] == pytest.approx([2 / 3, 2 / 3]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]
    vocab = spark.createDataFrame([("a",), ("new",)], "word string")
    filled = {r.word: r.vec for r in vectorize.fill_unknown_vectors(vectors, vocab, 2).collect()}
    again = {r.word: r.vec for r in vectorize.fill_unknown_vectors(vectors, vocab.repartition(3), 2).collect()}
    assert filled == again and set(filled) == {"a", "new"} and all(-0.25 <= x < 0.25 for x in filled["new"])


def test_splits(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    split = {r.k: r.split for r in sampling.three_way_split(df, "k").collect()}
    shares = [sum(s == name for s in split.values()) / 5000 for name in ("train", "validation", "test")]
    assert shares == pytest.approx([0.64, 0.16, 0.2], abs=0.02)
    assert split == {r.k: r.split for r in sampling.three_way_split(df.repartition(1), "k").collect()}
    cut = sampling.contiguous_split(df.filter("k % 7 = 0").repartition(3), "k", 0.75)
    train = [r.k for r in cut.filter("split = 'train'").collect()]
    assert len(train) == int(0.75 * 715) and max(train) == 7 * (len(train) - 1)
    assert [r.k for r in sampling.head(df, 3, "k").collect()] == [0, 1, 2]
    both = sampling.stack_splits({"a": df.limit(2), "b": df.limit(1)})
    assert sorted(r.split for r in both.collect()) == ["a", "a", "b"]


def test_clean_text_is_one_projection(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(t.clean_text("t"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_numbering_of_words_that_share_count_and_prefix(spark):
    """One count and one prefix hold all words: ranges still split them, and ids follow count and word."""
    from marlstone.operators import ordering

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).select(F.format_string("aaaa%06d", (F.col("id") * 7919) % 20_000).alias("word"), F.lit(1).cast("long").alias("count"))
        ids = {r.word: r.id for r in voc.rank_words(counts, 3).collect()}
        assert ids == {f"aaaa{i:06d}": i + 3 for i in range(20_000)}
        assert dict(voc.rank_words(counts).dtypes)["id"] == "bigint"
        plan = ordering.in_order(counts, [], ["count", "word"])._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan           # the order was written once, not sorted again
        ranges = spark.read.parquet(_last(spark, "in-order")).groupBy(F.shiftright("_at", 33)).count()
        assert ranges.count() > 1 and ranges.agg(F.max("count")).first()[0] < 12_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _last(spark, name):
    import glob
    import os

    from marlstone.session import shared_dir

    return max(glob.glob(f"{shared_dir(spark)}/{name}-*"), key=os.path.getmtime)


def test_positions_with_keys_weights_and_ties(spark):
    from marlstone.operators import ordering

    rows = [("a", i % 7, i) for i in range(200)] + [("b", None, 1), ("b", 5, 2), (None, 1, 3), (None, 0, 4)]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    got = {(r.g, r.v, r.n): r.p for r in ordering.in_order(df, ["g"], ["v", "n"], "n", "p").collect() if r.g is not None}
    for g, v, n in rows:
        if g is not None:
            before = sum(m for h, u, m in rows if h == g and ((u is not None, u or 0, m) < (v is not None, v or 0, n)))
            assert got[(g, v, n)] == before
    assert ordering.in_order(df.limit(0), ["g"], ["v"]).count() == 0


def test_quantiles_when_the_sketch_is_fooled(spark):
    """A sketch that keeps next to nothing puts all values into one bracket; the answer is exact all the same."""
    values = [float(i) for i in range(5000)] + [1e300] * 3 + [-1e300] * 3 + [2.5] * 4000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ordered = sorted(values)
    got = {r.q: r.quantile for r in agg.exact_quantiles(df, [], "x", [0.0, 0.3, 0.5, 0.99, 1.0], accuracy=2).collect()}
    for q, v in got.items():
        pos = q * (len(ordered) - 1)
        lo, hi = ordered[int(pos)], ordered[min(int(pos) + 1, len(ordered) - 1)]
        assert v == pytest.approx(lo + (hi - lo) * (pos - int(pos)))
    for k in (1, 2, 4500, 9006):
        assert df.limit(1).select(agg.order_statistic(df, "x", F.lit(k), accuracy=2).alias("v")).first().v == ordered[k - 1]
    plan = agg.exact_quantiles(df, [], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "_all" not in plan


def test_terms_are_not_worked_out_in_the_scan(spark, tmp_path):
    """The n-gram chain is a projection; the scan's filter has none of it."""
    from marlstone.operators import vectorize

    spark.createDataFrame([(1, "a bb bb cc"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    counts = vectorize.ngram_counts(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text", (1, 2))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line]
    assert {(r.term, r["count"]) for r in counts.collect()} == {("bb", 2), ("cc", 1), ("bb bb", 1), ("bb cc", 1)}


def test_a_hundred_thousand_variants(spark):
    """A table far too long for a plan gives what a plain dictionary gives."""
    variants = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("variant"), F.concat(F.lit("c"), (F.col("id") / 10).cast("int")).alias("canonical"))
    variants = variants.unionByName(spark.createDataFrame([("v5", "b"), (None, "x")], "variant string, canonical string"))
    df = spark.createDataFrame([(1, "V5 v99999 other v5"), (2, ""), (3, None), (4, "v12 " * 3000)], "id int, text string")
    got = {r.id: r.text for r in lookup.consolidate_by_table(df, ["id"], "text", variants).collect()}
    assert got == {1: "b c9999 other b", 2: "", 3: "", 4: " ".join(["c1"] * 3000)}


def test_lemmas_in_place_and_default_tag(spark):
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("ran", "v", "run")], "word string, tag string, lemma string")
    df = spark.createDataFrame([(1, "Cats ran", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, other string")
    got = {r.id: (r.text, r.other) for r in lookup.lemmatize_in_place(df, "id", "text", lemmas).collect()}
    assert got == {1: ("cat ran", "x"), 2: (None, "y"), 3: ("", "z")}
    tagged = spark.sql("SELECT 1 AS id, array(named_struct('word', 'ran', 'tag', 'v'), named_struct('word', 'cats', 'tag', CAST(NULL AS STRING))) AS a")
    assert lookup.lemmatize_tagged(tagged, ["id"], "a", lemmas, "n").first().a == ["run", "cat"]
