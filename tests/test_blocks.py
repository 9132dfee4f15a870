"""Look-ups by blocks of rows, batches of streams, and the memory and distances of text pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from marlstone.functions import similarity as sim
from marlstone.operators import blocks, lookup, vectorize, vocabulary
from marlstone.plans import messages, models


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    monkeypatch.setattr(blocks, "PIECE", 2)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "k long, tokens array<string>")


def test_ids_go_to_blocks_of_rows_and_tokens_stay_in_their_row(spark, small_blocks):
    docs = _docs(spark, [(1, ["a", "b", "x"]), (2, ["b", None]), (3, []), (4, None), (5, ["x"]), (None, ["a"]), (7, ["b", "a"]), (7, ["a"])])
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "word string, id long")
    ids = vocabulary.words_to_ids(docs, ["k"], "tokens", vocab)
    assert {r["k"]: r["ids"] for r in ids.collect()} == {1: [3, 4, 2], 2: [4, 2], 5: [2], None: [3], 7: [3, 4, 3]}
    assert "MapInArrow" in _plan(ids)
    assert "pos" not in ids.columns and "Generate posexplode" not in _plan(ids)
    back = vocabulary.ids_to_words(ids, ["k"], "ids", vocab)
    assert {r["k"]: r["words"] for r in back.collect()} == {1: ["a", "b"], 2: ["b"], None: ["a"], 7: ["a", "b", "a"]}


def test_replaced_tokens_with_several_forms_and_repeated_keys(spark, small_blocks):
    docs = _docs(spark, [(1, ["p", "q"]), (2, ["r"]), (2, ["p", "z"]), (3, []), (4, ["y", "y"])])
    table = spark.createDataFrame([("p", "P2"), ("p", "P1"), ("q", None), ("r", "R"), (None, "N")], "word string, form string")
    out = lookup.replace_tokens(docs, ["k"], "tokens", table, "word", "form")
    assert {r["k"]: r["tokens"] for r in out.collect()} == {1: ["P1", "P2", "q"], 2: ["P1", "P2", "R", "z"], 3: [], 4: ["y", "y"]}


def test_mean_vectors_go_to_blocks_not_to_words(spark, small_blocks):
    docs = _docs(spark, [(1, ["a", "a", "b", "x"]), (2, ["x"]), (3, None), (4, ["b"]), (4, ["c", "c"]), (None, ["a"]), (5, ["c"]), (6, ["n"])])
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, 8.0]), ("c", [0.0, None]), ("c", [3.0, 1.0]), ("n", None)], "word string, vec array<float>")
    out = vectorize.mean_word_vector(docs, "k", "tokens", vectors, 2)
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append(None if r["vec"] is None else [None if v is None else round(v, 6) for v in r["vec"]])
    both = [round((4 + 0 + 0 + 3 + 3) / 5, 6), round((8 + 1 + 1) / 5, 6)]
    assert got == {1: [[2.0, 4.0]], 2: [[0.0, 0.0]], 3: [[0.0, 0.0]], 4: [both, both], None: [[0.0, 0.0]], 5: [[1.5, 0.5]], 6: [[None, None]]}
    assert "MapInArrow" in _plan(out)


def test_a_batch_of_a_stream_is_not_one_file(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(i, f"word{i}", "src")], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    seen = []
    messages.document_stream(spark, str(tmp_path)).writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert seen == [5]


def test_word_vectors_are_fitted_on_rows_written_once(spark, monkeypatch):
    names = []
    real = models.write_cut
    monkeypatch.setattr(models, "write_cut", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(models.emb, "fit_word_vectors", lambda df, tokens, **_: df.columns)
    assert models.fitted_words(spark, "/root/testdata/sf0.001") == ["tokens"] and names == ["thinned"]


def test_pairs_are_scored_a_bounded_number_of_letters_at_a_time(monkeypatch):
    x = pd.Series(["abc", "", "abcdefgh", "ca", "x" * 50, "ab"])
    y = pd.Series(["acb", "", "badcfehg", "abc", "y" * 50, "ba"])
    sizes = []

    def score(a, b):
        sizes.append(int(a.str.len().sum() + b.str.len().sum()))
        return sim._transposition_distances(a, b)

    monkeypatch.setattr(sim, "LETTERS", 20)
    assert sim._in_slices(score, x, y).tolist() == [1, 0, 4, 2, 50, 1]
    assert sorted(sizes)[-1] == 100 and sorted(sizes)[-2] <= 20 and len(sizes) > 2
    assert len(sim._in_slices(score, x[:0], y[:0])) == 0


def _distance(a, b):
    """Every place of a transposition tried, also with letters between on both sides."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            for k in range(1, i):
                for m in range(1, j):
                    if a[i - 1] == b[m - 1] and a[k - 1] == b[j - 1]:
                        d[i, j] = min(d[i, j], d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
    return int(d[-1, -1])


def test_distances_with_rows_that_end_at_different_lengths():
    rng = random.Random(3)
    x, y = ([("".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for _ in range(300)] for _ in range(2))
    assert sim._transposition_distances(pd.Series(x), pd.Series(y)).tolist() == [_distance(a, b) for a, b in zip(x, y)]
    long = pd.Series(["ab" * 1100, "ab" * 1100]), pd.Series(["ba" * 1100, "c" * 1900])
    assert sim._transposition_distances(*long).tolist() == [2, 2200]
