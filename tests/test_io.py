"""Sources, sinks and streams."""

import json
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marlstone.operators import sentiment
from marlstone.session import shared_dir
from marlstone.sources import corpus, records
from marlstone.streaming import enrich as en

MESSAGES = [
    {"id": 1, "text": "I love #moana http://t.co/x great fun", "lang": "en", "retweet_count": 2, "entities": {"hashtags": [{"text": "moana"}, {"text": "x"}]},
     "user": {"lang": "en", "name": "A", "screen_name": "a", "location": "here", "followers_count": 3, "favourites_count": 4, "friends_count": 5},
     "place": {"country": "US"}, "coordinates": {"coordinates": [10.5, 20.25]}, "retweeted_status": {"retweet_count": 7}},
    {"id": 2, "text": "terrible waste", "lang": "en", "entities": {"hashtags": []}, "user": None, "place": None, "coordinates": None},
    {"id": 3, "text": "great story", "lang": "fr", "entities": {"hashtags": [{"text": "Arrival"}]}, "coordinates": {"coordinates": []}},
    {"id": 4, "text": "terrible waste", "lang": "en", "entities": {"hashtags": [{"text": "arrival"}]}},
    {"id": 5, "lang": "en", "entities": {"hashtags": [{"text": "arrival"}]}},
]


def _values(spark, rows=MESSAGES):
    return spark.createDataFrame([(json.dumps(m),) for m in rows], "value string")


def test_extract_defaults(spark):
    got = {r.id: r for r in records.extract_message(records.parse(_values(spark)), "id").collect()}
    one, two = got[1], got[2]
    assert (one.movie, one.country, one.coordinates_lat, one.coordinates_long, one.retweets_count) == ("moana", "US", "20.25", "10.5", 7)
    assert (two.movie, two.language, two.country, two.coordinates_lat, two.location, two.followers_count) == ("Data Error", "Data Error", None, None, None, 0)
    assert got[3].coordinates_lat == "Not available" and got[5].text == "Data Error"


def test_track_filter(spark):
    names = spark.createDataFrame([("#Arrival",), ("#moana",)], "name string")
    got = records.track_filter(records.parse(_values(spark)), names)
    assert sorted(r.id for r in got.collect()) == [1, 4, 5]
    assert records.track_query(["#a", "#b"]) == "#a OR #b"


def test_json_files_and_archive(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(MESSAGES[:2], indent=1))
    (tmp_path / "single.json").write_text(json.dumps(MESSAGES[2], indent=1))
    assert records.read_json_documents(spark, str(tmp_path / "*.json")).count() == 3
    rows = _values(spark)
    for _ in range(2):
        records.archive(rows, str(tmp_path / "archive"))
    back = records.parse(spark.read.text(str(tmp_path / "archive")))
    assert back.count() == 10 and back.filter("id = 1").first().user.name == "A"
    published = records.publish(spark.createDataFrame([(1, None)], "a int, b string")).first().value
    assert json.loads(published) == {"a": 1}
    flat = records.extract_message_file(records.parse(_values(spark)), "id").filter("id = 1").first()
    assert flat.coordinates == [10.5, 20.25] and flat.retweet_count == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, "two\nlines", "x")], "id int, q string, r string")
    records.write_csv(df, str(tmp_path / "csv"))
    back = records.read_csv(spark, str(tmp_path / "csv"), df.schema)
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, 'say "hi", you', ""), (2, "two\nlines", "x")]
    assert dict(records.read_csv(spark, str(tmp_path / "csv")).dtypes)["id"] == "int"


def test_movie_table(spark):
    df = spark.sql("SELECT 'T' AS title, array(named_struct('name', 'a'), named_struct('name', 'b')) AS cast, array('D', 'E') AS director, "
                   "array('x') AS genres, CAST(NULL AS array<string>) AS lang, array() AS plot, CAST(NULL AS string) AS url")
    row = records.normalise_movie(df.withColumn("plot", F.col("plot").cast("array<string>"))).first()
    assert tuple(row) == ("T", '["a","b"]', "D", '["x"]', "NA", "NA", "NA")
    for _ in range(2):      # overwrite, not append
        records.save_movie_table(records.normalise_movie(df.withColumn("plot", F.col("plot").cast("array<string>"))), "movie_data")
    table = spark.table("movie_data")
    assert table.columns == list(records.MOVIE_COLUMNS) and [tuple(r) for r in table.collect()] == [tuple(row)]


def test_word_lists_and_documents(spark, tmp_path):
    (tmp_path / "w.txt").write_text("The a|b\nB|the\n")
    assert sorted(r.word for r in corpus.read_word_list(spark, str(tmp_path / "w.txt"), "|").collect()) == ["b", "the", "the a"]
    (tmp_path / "names.txt").write_text("#moana\n#arrival\n")
    assert corpus.read_lines(spark, str(tmp_path / "names.txt")) == ["#moana", "#arrival"]
    docs = spark.createDataFrame([("one\ntwo",), ("three",)], "text string")
    corpus.write_documents(docs, str(tmp_path / "docs"))
    assert sorted(r.text for r in corpus.read_documents(spark, str(tmp_path / "docs")).collect()) == ["one two", "three"]


def test_labels_classes_pages(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(20)], "id int, c string")
    sub = corpus.labelled_subset(df, "c", ["d", "b"])
    assert {(r.c, r.target) for r in sub.collect()} == {("b", 0), ("d", 1)}
    assert {(r.c, r.target) for r in corpus.labelled_subset(df, "c").collect()} == {(c, i) for i, c in enumerate("abcd")}
    drawn = [r["class"] for r in corpus.random_classes(df, "c", 3, 8).collect()]
    assert drawn == [r["class"] for r in corpus.random_classes(df.repartition(5), "c", 3, 8).collect()] and len(set(drawn)) == 3
    first = corpus.next_page(df, "id", 19, 5)
    second = corpus.next_page(df, "id", first.agg(F.min("id")).first()[0], 5)
    assert sorted(r.id for r in corpus.merge_pages(first, second).collect()) == list(range(11, 20))
    assert corpus.page_cursors(df, "c", "id").filter("c = 'a'").first().max_id == 16


def test_feature_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert records.cached_features(spark, str(tmp_path / "f"), build).count() == 3
    assert calls == [1]


def test_sentiment_rules(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    texts = ["good", "very good", "x very good", "not good", "not very good", "bad slightly bad", "plain", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.sentiment_score for r in sentiment.score_sentiment(df, "id", "t", lex).orderBy("id").collect()]

    def squash(v):
        return round(v / (v * v + 15) ** 0.5, 4)

    assert got == [squash(2), squash(2.293), squash(2.293), squash(2 * -0.74), squash(2.293 * -0.74), squash(-2 - 2 + 0.293), 0.0, 0.0]
    with pytest.raises(NotImplementedError):
        sentiment.score_sentiment(df, "id", "t", lex, "capone")
    with pytest.raises(ValueError):
        sentiment.score_sentiment(df, "id", "t", lex, "none")
    words = sentiment.word_sentiment(spark.createDataFrame([("good",), ("x",)], "word string"), "word", lex)
    assert {r.word: r.word_sentiment for r in words.collect()} == {"good": "positive", "x": "neutral"}


def _batch_files(spark, folder, order):
    for n, rows in enumerate(order):
        _values(spark, rows).coalesce(1).write.mode("append").text(f"{folder}/part={n}")


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    src, tables, checkpoint = (str(tmp_path / n) for n in ("in", "tables", "checkpoint"))
    lex = sentiment.sample_lexicon(spark)
    _batch_files(spark, src, [MESSAGES[:2]])

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{src}/*")
        en.start_enrichment(stream, tables, checkpoint, "id", lex).awaitTermination()

    run()
    for n, rows in enumerate((MESSAGES[2:4], MESSAGES[4:])):
        _values(spark, rows).coalesce(1).write.text(f"{src}/part={n + 1}")
        run()
    run()
    stored = spark.read.parquet(f"{tables}/messages")
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    assert "created_at" in stored.columns
    assert {r.id: r.sentiment for r in stored.collect()} == {1: "positive", 2: "negative", 3: "positive"}
    batch = en.counted_words(en.enrich(records.parse(_values(spark)), "id", lex), "id", lex)
    counts = sentiment.word_sentiment(en.latest_word_counts(spark, tables), "word", lex)
    assert sorted(map(tuple, counts.select("word", "movie", "count", "word_sentiment").collect())) == sorted(
        map(tuple, batch.select("word", "movie", "count", "word_sentiment").collect()))


def test_word_counts_survive_gaps_replays_and_new_runs(spark, tmp_path):
    tables = str(tmp_path)

    def add(run, batch, *words):
        en.add_word_counts(tables, run, batch, spark.createDataFrame([(i, "m", w) for i, w in enumerate(words)], "id long, movie string, word string"), "id")

    def counts():
        return {r.word: r["count"] for r in en.latest_word_counts(spark, tables).collect()}

    add("a", 0, "splendid", "dull")
    add("a", 1, "splendid")
    add("a", 1, "splendid")                     # the same batch again
    assert counts() == {"splendid": 2, "dull": 1}
    with pytest.raises(RuntimeError):
        add("a", 7, "splendid")                 # batches 2 to 6 are missing
    add("b", 0, "splendid")                     # a new checkpoint goes on from what is there
    assert counts() == {"splendid": 3, "dull": 1}
    shutil.rmtree(f"{tables}/words/version=1")  # expired, no longer needed
    add("b", 1, "dull")
    assert counts() == {"splendid": 3, "dull": 2}
    shutil.rmtree(f"{tables}/words/version=3")
    with pytest.raises(AnalysisException):
        add("b", 2, "dull")


@pytest.mark.parametrize("kind", ["pairs", "owned"])
def test_running_word_counts(spark, tmp_path, kind):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "m", "aaaa"), (2, "n", "aaaa"), (3, "m", "aaaa"), (4, "n", "bbbb")], "at long, movie string, word string").coalesce(1).write.parquet(src)
    spark.createDataFrame([(5, "m", "aaaa"), (6, "m", "bbbb"), (7, "n", "bbbb")], "at long, movie string, word string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("at long, movie string, word string").option("maxFilesPerTrigger", 1).parquet(src)
    counts = en.stream_pair_counts(stream, "at") if kind == "pairs" else en.stream_owned_counts(stream, "at")
    counts.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    if kind == "pairs":
        got = en.owners_of(rows)
    else:
        got = rows.groupBy("word").agg(F.max_by(F.struct("movie", "count"), "batch").alias("o")).select("word", "o.*")
    assert {r.word: (r.movie, r["count"]) for r in got.collect()} == {"aaaa": ("m", 3), "bbbb": ("n", 2)}


def test_stream_dedup_with_watermark(spark, tmp_path):
    rows = "(TIMESTAMP '2024-01-01 00:00:00', 'a'), (TIMESTAMP '2024-01-01 00:00:01', 'a'), (TIMESTAMP '2024-01-01 00:00:02', 'b')"
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(ts, text)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for n, args in enumerate(((), ("ts", "1 minute"))):
        q = en.stream_dedup(stream, ["text"], *args).writeStream.format("parquet").option("path", str(tmp_path / f"o{n}")).option(
            "checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.text for r in spark.read.schema(df.schema).parquet(str(tmp_path / f"o{n}")).collect()) == ["a", "b"]


def test_shared_folder_is_the_clusters(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_batch_opens_the_buckets_it_needs(spark, tmp_path, monkeypatch):
    """Stored messages are looked for in the folders of the batch's hashes alone, and a replay adds nothing."""
    from marlstone.operators import dedup

    tables, lex, plans = str(tmp_path), sentiment.sample_lexicon(spark), []
    plain = dedup.insert_if_absent

    def seen(new, target, *args):
        plans.append(target._jdf.queryExecution().executedPlan().toString())
        return plain(new, target, *args)

    monkeypatch.setattr(dedup, "insert_if_absent", seen)
    write = en.enrichment_sink(tables, "id", lex, run="r")
    write(_values(spark, MESSAGES[:2]), 0)
    write(_values(spark, MESSAGES[2:4]), 1)
    before = sorted(r.id for r in en.stored_messages(spark, tables).collect())
    write(_values(spark, MESSAGES[:4]), 1)
    assert sorted(r.id for r in en.stored_messages(spark, tables).collect()) == before and "bucket" not in en.stored_messages(spark, tables).columns
    filters = [line for line in plans[-1].splitlines() if "PartitionFilters" in line]
    assert filters and all("bucket" in line for line in filters)


def test_word_count_parts_stay_few_and_small(spark, tmp_path):
    """What a batch writes follows its size; parts are merged by size and give what one grouping gives."""
    import os
    import random

    rng, tables, rows = random.Random(3), str(tmp_path), []
    sizes = [400, *[3] * 11]
    for b, size in enumerate(sizes):
        part = [(1000 * b + i, rng.choice("mno"), f"w{rng.randrange(300) if b == 0 else rng.randrange(320)}") for i in range(size)]
        rows += part
        en.add_word_counts(tables, "a", b, spark.createDataFrame(part, "id long, movie string, word string"), "id")
    got = {r.word: (r.movie, r["count"]) for r in en.latest_word_counts(spark, tables).collect()}
    owner, count = {}, {}
    for _, movie, word in rows:
        owner.setdefault(word, movie)
        count[word] = count.get(word, 0) + (owner[word] == movie)
    assert got == {w: (owner[w], count[w]) for w in owner}
    parts = [r.part for r in spark.read.parquet(f"{tables}/words/version=11").collect()]
    assert len(parts) <= 5
    written = [spark.read.parquet(f"{tables}/words-parts/{p}").count() for p in os.listdir(f"{tables}/words-parts")]
    assert sum(n > 50 for n in written) == 1          # the large first part is never written again
