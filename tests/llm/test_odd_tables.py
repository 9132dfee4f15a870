"""Archives, toxicity, quality, lines and leaks on empty tables, repeated rows, very long texts and clashing column names."""

import hashlib

from marlstone.llm import decontaminate, lines, quality, toxicity, warc

NAMES = "id string, doc string, th string, text_ string, n string, key string, path string, row string, digest string, payload string, label string, score string, at string, line string, site string"
EXTRA = tuple("?" for _ in NAMES.split(", "))


def frame(spark, rows, schema):
    """``rows`` with the columns of ``schema`` and others named as the operators might name their own."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {NAMES}")


def test_archives_of_long_payloads_beside_clashing_names(spark):
    long = "é word " * 700_000
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, "short"), (None, None, None)]
    got = warc.round_trip(frame(spark, rows, "page_id long, url string, html string")).collect()
    sha = hashlib.sha1(long.encode()).hexdigest()
    kinds = sorted(r["record_type"] for r in got if r["payload_length"] == len(long.encode()))
    # Rows alike in id and payload are all responses.
    assert len(got) == len(rows) and kinds == ["response", "response", "revisit"]
    assert sum(r["payload_digest"].endswith(sha) for r in got) == 3
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_toxicity_of_odd_tables(spark):
    schema = "doc_id long, text string"
    rows = [(i, f"plain words of number {i} in a row " * 8 + ("vile grot " * 9 if i % 3 == 0 else "")) for i in range(60)]
    odd = [(100, "calm words here " * 200_000), (101, None), (101, None), (102, ""), (1, rows[1][1]), (None, "vile grot " * 9)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    df = frame(spark, rows + odd, schema)
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc"] == 1}) == 1
    none = frame(spark, [], schema)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_quality_of_a_very_long_text_beside_clashing_names(spark):
    schema = "doc_id long, text string, source string, lang string"
    rows = [(i, "Some good words, in a line." if i % 3 else "BAD!! JUNK!! | | |", "s", "en") for i in range(60)]
    rows += [(100, "Some good words, in a line. " * 150_000, "s", "en"), (101, None, None, None), (1, rows[1][1], "s", "en")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    df = frame(spark, rows, schema)
    kept = quality.keep_accepted(df, labels)
    assert kept.columns == df.columns and {100, 1} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_lines_and_leaks_beside_clashing_names(spark):
    schema = "doc_id long, text string, source string"
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(i, f"own line {i}\nthe same footer everywhere", f"s{i}") for i in range(40)]
    rows += [(100, "long line " * 300_000, "s1"), (101, f"{item} " * 50_000, "s2"), (102, None, None), (103, "", "s3"), (103, "", "s3")]
    df = frame(spark, rows, schema)
    cleaned = lines.drop_boilerplate(df)
    texts = {r["doc_id"]: r["text"] for r in cleaned.select("doc_id", "text").collect()}
    assert cleaned.columns == df.columns and sum("footer" in (t or "") for t in texts.values()) <= 1 and "own line 7" in texts[7] and 100 in texts
    bench = frame(spark, [(1, item), (2, None), (3, "")], "item_id long, text string")
    clean = decontaminate.drop_leaks(df, bench)
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in clean.select("doc_id").collect())
    assert clean.columns == df.columns and ids == [*range(40), 100, 102, 103, 103]
    assert decontaminate.drop_leaks(df.limit(0), bench).count() == 0 and lines.drop_boilerplate(df.limit(0)).count() == 0
