"""Look-ups by tables that every worker holds, and the same in blocks of files; shuffle files that go with their query."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions.wordlists import NEGATORS, STRENGTHENERS, WEAKENERS
from marlstone.operators import blocks, lookup, sentiment, vectorize, vocabulary
from marlstone.plans import messages
from marlstone.session import write_cut
from marlstone.streaming import enrich as en


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["held", "blocks"])
def way(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    monkeypatch.setattr(blocks, "PIECE", 2)
    monkeypatch.setattr(blocks, "SLICE", 3)
    if request.param == "blocks":
        monkeypatch.setattr(blocks, "HELD", 0)
    return request.param


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def _gone(spark, before):
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return not left


def test_ids_of_rows_that_stay_where_they_are(spark, way):
    rows = [(i, ["a", "b", "x", None][: i % 5] * (i % 3 + 1)) for i in range(40)] + [(40, []), (41, None), (None, ["b"])]
    docs = spark.createDataFrame(rows, "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), (None, 5)], "word string, id long")
    ids = vocabulary.words_to_ids(docs, ["k"], "tokens", vocab)
    of = {"a": 3, "b": 4}
    assert {r["k"]: r["ids"] for r in ids.collect()} == {k: [of.get(w, 2) for w in t] for k, t in rows if t}
    assert ("Exchange" in _plan(ids)) == (way == "blocks")
    forms = lookup.replace_tokens(docs, ["k"], "tokens", vocab.select("word", F.upper("word").alias("form")), "word", "form")
    assert {r["k"]: r["tokens"] for r in forms.collect()} == {k: [{"a": "A", "b": "B"}.get(w, w) for w in t] for k, t in rows if t is not None}


def test_rows_that_share_their_keys_give_one_row(spark, way):
    docs = spark.createDataFrame([(2, ["r"]), (2, ["p", "z"]), (3, ["p"]), (None, ["r"]), (None, ["q"])], "k long, tokens array<string>")
    table = spark.createDataFrame([("p", "P2"), ("p", "P1"), ("r", "R")], "word string, form string")
    out = lookup.replace_tokens(docs, ["k"], "tokens", table, "word", "form")
    got = {r["k"]: r["tokens"] for r in out.collect()}
    assert out.count() == 3 and got[2] == ["P1", "P2", "R", "z"] and got[3] == ["P1", "P2"] and sorted(got[None]) == ["R", "q"]


def test_mean_vectors_of_rows_that_stay_where_they_are(spark, way):
    rows = [(i, [f"w{(i * j) % 7}" for j in range(i % 6)]) for i in range(50)]
    docs = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(3)
    vectors = {f"w{i}": [i / 3, -float(i)] for i in range(5)}
    table = spark.createDataFrame(list(vectors.items()), "word string, vec array<float>")
    sums = blocks.vector_sums(docs, "k", "tokens", table, 2)
    assert ("_block" in _plan(sums)) == (way == "blocks")
    means = vectorize.mean_word_vector(docs, "k", "tokens", table, 2)
    for r in means.collect():
        mine = [vectors[w] for w in rows[r["k"]][1] if w in vectors]
        assert r["vec"] == pytest.approx([sum(c) / len(mine) for c in zip(*mine)] if mine else [0.0, 0.0], abs=1e-6)


def test_blocks_take_files_that_follow_one_another(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 0)
    docs = spark.createDataFrame([(i, [f"w{i // 50}"] * 10) for i in range(400)], "k long, tokens array<string>").repartitionByRange(8, "k")
    table = spark.createDataFrame([(f"w{i}", [float(i)]) for i in range(8)], "word string, vec array<double>")
    monkeypatch.setattr(blocks, "BLOCK", 1000 // 32)
    wanted = []
    kind = type(docs)
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda df, n, c: wanted.append(df.filter("NOT _row").count()) or real(df, n, c))
    assert blocks.vector_sums(docs, "k", "tokens", table, 1).count() == 400
    assert wanted[0] <= 16           # eight words, each in one block or two; a row dealt by its hash alone would want up to 40


def test_lemmas_in_place(spark, way):
    rows = [(1, "Cats run", "x"), (2, None, "y"), (3, "", "z"), (None, "cats", "n"), (5, "cats", "a"), (5, "dogs", "b")]
    df = spark.createDataFrame(rows, "k long, text string, other string")
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("run", "v", "ran"), ("dogs", "n", "dog")], "word string, tag string, lemma string")
    out = lookup.lemmatize_in_place(df, "k", "text", lemmas)
    assert out.columns == df.columns
    assert {r["other"]: r["text"] for r in out.filter("k <> 5 OR k IS NULL").collect()} == {"x": "cat run", "y": None, "z": "", "n": None}
    shared = out.filter("k = 5").collect()
    assert len(shared) == 2 and len({r["text"] for r in shared}) == 1 and sorted(shared[0]["text"].split()) == ["cat", "dog"]
    alone = lookup.lemmatize_in_place(df.filter("k < 5"), "k", "text", lemmas)
    assert ("Exchange" in _plan(alone)) == (way == "blocks")


def test_scores_in_place_are_those_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE", 20)
    rng = random.Random(5)
    words = ["good", "bad", "plain", "odd"] + [sorted(s)[0] for s in (NEGATORS, STRENGTHENERS, WEAKENERS)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(200)] + ["GOOD", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    lex = spark.createDataFrame([("good", 2.0), ("bad", -0.2), ("odd", None), (None, 1.0)], "word string, valence double")
    out = sentiment.score_sentiment(df, "k", "t", lex)
    assert "Exchange" not in _plan(out) and "Join" not in _plan(out)
    want = {r["k"]: r["sentiment_score"] for r in sentiment._joined_scores(df, "k", "t", lex.select(F.col("word").alias("w"), F.col("valence").alias("v"))).collect()}
    assert {r["k"]: r["sentiment_score"] for r in out.collect()} == pytest.approx(want, abs=1e-4) and len(set(want.values())) > 20
    twice = sentiment.score_sentiment(df.limit(5).unionByName(df.limit(5)), "k", "t", lex)
    assert twice.count() == 10
    both = sentiment.score_sentiment(df.filter("k < 9"), "k", "t", lex.unionByName(lex)).collect()
    assert {r["k"] for r in both} == set(range(9))
    none = sentiment.score_sentiment(spark.createDataFrame([(None, "good"), (None, "bad")], "k long, t string"), "k", "t", lex)
    assert [r["sentiment_score"] for r in none.collect()] == [0.0, 0.0]


def test_texts_meet_their_labels_before_they_are_cut_into_words(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "fine word" if i < 5 else "other") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(4)] + [(8, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plans = []
    monkeypatch.setattr(messages, "write_cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert {tuple(r) for r in messages.lexicon(spark, str(tmp_path)).collect()} == {("fine", 4.0), ("word", 4.0)}
    assert 0 < plans[0].index("Generate explode") < plans[0].index("Join Inner")


def test_shuffle_files_go_with_their_query(spark):
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    write_cut(spark.range(5000).groupBy((F.col("id") % 91).alias("k")).count(), "counts")
    assert _gone(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_shuffle_files_of_the_messages_of_a_batch_go_with_it(spark, tmp_path, monkeypatch):
    lex = spark.createDataFrame([("good", 2.0)], "word string, valence double")
    batch = spark.createDataFrame([(i, f"good text number {i % 7}") for i in range(40)], "id long, text string").select(F.to_json(F.struct("id", "text")).alias("value"))
    seen = []
    real = en.enrich
    monkeypatch.setattr(en, "enrich", lambda *args: (real(*args), before.update(_shuffle_files(spark)))[0])
    monkeypatch.setattr(en, "add_word_counts", lambda *_: seen.append(_gone(spark, before)))
    before = set()
    en.enrichment_sink(f"{tmp_path}/t", "id", lex, run="r")(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/t/messages").count() == 7 and seen == [True]


def test_the_file_job_sends_no_message(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([(1, "Cats are good"), (2, None), (3, "bad\ncats")], "id long, text string").select(F.to_json(F.struct("id", "text")).alias("value"))
    lex = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    lemmas = spark.createDataFrame([("cats", "n", "cat")], "word string, tag string, lemma string")
    plans, real = [], en.write_csv
    monkeypatch.setattr(en, "write_csv", lambda df, path: (plans.append(_plan(df)), real(df, path))[1])
    en.message_file_job(en.parse(batch), "id", lex, lemmas, f"{tmp_path}/out")
    assert "Exchange" not in plans[0] and "Join" not in plans[0]
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out").collect()
    assert {r["id"]: (r["text_clean"], r["sentiment"]) for r in rows} == {"1": ("cat good", "positive"), "3": ("bad cat", "negative")}
