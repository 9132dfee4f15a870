"""Packing against a plain encoder: every id once, sequences full."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", "two words", "  leading and  double  ", "line\nbreak \n end ", "don't it's 12 o'clock", "naïve Ünïcode ñ 日本語 😀", "<|endoftext|> x",
         "tab\tand nbsp  em", "x" * 5000, " ", "\n\n", "long " * 3000]


def test_ids_equal_the_tokenizer():
    fast, slow = packing.ByteBpe(PATH), plain()
    for text in TEXTS * 2:
        assert np.frombuffer(fast(text), np.uint32).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert fast(None) == b""


def check(rows, texts, size):
    slow = plain()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for doc, text in texts.items():
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert sum((p["ids"] for p in pieces), []) == ids and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
    holes = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        holes += at < size
    assert holes <= 1


@pytest.mark.parametrize("size,cell", [(16, 3), (64, 1000)])
def test_pack_round_trip(spark, size, cell):
    rng = np.random.default_rng(5)
    texts = dict(enumerate([*TEXTS, None] + [" ".join(["word", "of", "text,", "thing."][i] for i in rng.integers(0, 4, rng.integers(0, 90))) for _ in range(300)]))
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id long, text string, ids string, rank int").repartition(3)
    check(packing.pack(df, PATH, size=size, cell_rows=cell).collect(), texts, size)


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    got = packing.pack(df, PATH, size=8).collect()
    assert sum(r["length"] for r in got) == 3 + 3 + 2
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_least_squares_prefers_full_windows():
    histogram = np.zeros(10, np.int64)
    histogram[[3, 7, 4, 6]] = 100, 100, 50, 50
    rows, counts, left = packing.packing_plan(histogram, 10)
    assert left.sum() <= 3 and (rows[:, :].sum(axis=1) == 10).all()


def test_each_chunk_is_looked_up_once_and_white_space_stays(monkeypatch):
    slow, fast, looked = plain(), packing.ByteBpe(PATH), []

    class Counted(packing._Chunks):
        def get(self, chunk):
            looked.append(chunk)
            return super().get(chunk)

        def __contains__(self, chunk):
            looked.append(chunk)
            return super().__contains__(chunk)

        def __getitem__(self, chunk):
            looked.append(chunk)
            return super().__getitem__(chunk)

    fast.kept = Counted(fast.encode)
    texts = TEXTS + ["ends in a line\n", "a \n b", "line\n then", "then\n", " then", "then ", "a  b", "a \x1f b", "a\xa0 b", "\xa0a b", "b \xa0", "\nfirst line", "w" * 300 + " " + "v" * 300]
    want = [slow.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        assert [np.frombuffer(x, np.uint32).tolist() for x in fast.encode_all(texts)] == want
    assert [np.frombuffer(x, np.uint32).tolist() for t in reversed(texts) for x in fast.encode_all([t])] == want[::-1]
    words = "many plain words in a text that was seen before"
    fast.encode_all([words])
    looked.clear()
    fast.encode_all([words])
    assert len(looked) <= len(words.split(" "))
