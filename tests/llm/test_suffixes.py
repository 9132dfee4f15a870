"""Repeated bytes against a dictionary of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import suffixes


def brute(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(k) for k in (10, 16, 25, 40, 80)]
    texts = [None, "", "short", "ab" * 400, "é" * 300]
    for _ in range(n):
        parts = [prose(rng.integers(5, 40))]
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(0, 5)]
            cut = rng.integers(0, len(p) // 3)
            parts += [p[cut:], prose(rng.integers(0, 30))]
        texts.append(" ".join(parts))
    texts += texts[-3:]
    for t in texts[10:20]:                     # near copies
        at = int(rng.integers(0, len(t)))
        texts.append(t[:at] + "#" + t[at:])
    return texts


@pytest.mark.parametrize("length,bucket", [(400, 1 << 20), (100, 3000), (64, 2000)])
def test_equals_brute_force(spark, length, bucket):
    texts = corpus(length)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(3)
    got = {r["doc"]: r for r in suffixes.remove_repeats(df, length=length, bucket_bytes=bucket).collect()}
    data = [(t or "").encode() for t in texts]
    for i, gone in enumerate(brute(data, length)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), i
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(data[i], np.uint8)[~gone]) and got[i]["n_bytes"] == len(data[i])


def test_quicksort_and_anchors():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(500)]
    order = suffixes.multikey_quicksort(suffixes._tokens(strings, 40))
    assert [strings[i].ljust(40, b"\0") for i in order] == sorted(s.ljust(40, b"\0") for s in strings)
    text = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    spans = list(suffixes.anchors(text, 100))
    assert [s[2] for s in spans] == [0, *(s[3] + 1 for s in spans[:-1])] and spans[-1][3] == 2900
    assert all(first <= p <= first + 100 - 32 and last <= p for _, p, first, last in spans)
    moved = {(g, p - 7) for g, p, _, _ in suffixes.anchors(b"1234567" + text, 100)}
    assert {(g, p) for g, p, _, _ in spans} <= moved


def test_filter_with_hash_zero(spark):
    shift = 64 - suffixes.FILTER_BITS.bit_length() + 1
    planted = [0, 5, 1 << shift, 32768 << shift, 32769 << shift, -1]       # the first two have no upper bit set
    bits = suffixes._filter_of(spark.createDataFrame([(x,) for x in planted], "gram long"), "gram").value
    assert suffixes._may_have(bits, np.array(planted, np.int64)).all()
    assert suffixes._may_have(bits, np.array([0, 2 << shift, 32767 << shift, 32770 << shift], np.int64)).tolist() == [True, False, False, False]


def test_repeated_gram_of_hash_zero(spark, monkeypatch):
    mixed = suffixes._remixed
    monkeypatch.setattr(suffixes, "_remixed", lambda x: mixed(x) & np.uint64((1 << 36) - 1))
    passage = " ".join(str(i) for i in range(200))
    df = spark.createDataFrame([(1, "x " + passage), (2, "y " + passage)], "doc_id long, text string")
    got = suffixes.remove_repeats(df, length=100).collect()
    assert sorted(bytes(r["kept"]) for r in got) == [b"x", b"y"]


def test_anchor_hashes_fill_the_filter_evenly():
    text = bytes(np.random.default_rng(4).integers(97, 123, 400_000).astype(np.uint8))
    top = np.array([g for g, _, _, _ in suffixes.anchors(text)], np.int64).view(np.uint64) >> np.uint64(60)
    assert len(top) > 1000 and np.bincount(top.astype(np.int64), minlength=16).min() > len(top) / 32


def test_no_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.md5(b"").digest()


@pytest.mark.parametrize("seed", range(40))
def test_partners_of_one_gram_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(12, 40))
    word = lambda: bytes(rng.integers(97, 99 + seed % 2, rng.integers(0, length)).astype(np.uint8))
    stems = [(word(), word()) for _ in range(4)]
    own = {(stems[rng.integers(4)][0] + word()[:4], b"gram" + stems[rng.integers(4)][1] + word()[:4]) for _ in range(60)}
    own = sorted(own, key=lambda x: (x[1], x[0]))
    got = suffixes.group_covers([x for x, _ in own], [y for _, y in own], length)
    for i, (x, y) in enumerate(own):
        shared = [(suffixes.common_prefix(x, u), suffixes.common_prefix(y, v)) for j, (u, v) in enumerate(own) if j != i]
        shared = [(a, b) for a, b in shared if a + b >= length] or [(0, 0)]
        assert got[i] == (max(a for a, _ in shared), max(b for _, b in shared))


def test_short_passage_in_very_many_texts(spark):
    """Contexts of one gram over many buckets, and copies of one text that are a third of all rows."""
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 5, n))
    passage = noise(90)
    texts = [noise(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 8)):90 - int(rng.integers(0, 8))] + noise(int(rng.integers(0, 60))) for _ in range(400)]
    texts += [passage + noise(50)] * 200 + [None, "", passage]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, copies int").repartition(4)
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.remove_repeats(df, length=84, bucket_bytes=3000).collect()}
    for i, gone in enumerate(brute([(t or "").encode() for t in texts], 84)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        assert got[i] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def test_gram_with_many_contexts_leaves_no_strings_to_try(spark, monkeypatch):
    """A gram in many texts that fits a bucket is settled there; strings at each open offset would be up to 53 rows a context."""
    rng = np.random.default_rng(12)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 5, n))
    passages = [noise(90) for _ in range(8)]
    texts = [noise(int(rng.integers(0, 60))) + passages[i % 8][int(rng.integers(0, 8)):90 - int(rng.integers(0, 8))] + noise(int(rng.integers(0, 60))) for i in range(480)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    write, made = suffixes.write_cut, {}

    def counted(rows, name):
        made[name] = write(rows, name)
        return made[name]

    monkeypatch.setattr(suffixes, "write_cut", counted)
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.remove_repeats(df, length=84, bucket_bytes=9000).collect()}
    assert made["suffix-order"].where("kind = 2").count() > 3 and made["gram-bytes"].agg({"bytes": "max"}).first()[0] <= 9000
    assert made["open-strings"].count() == 0
    for i, gone in enumerate(brute([t.encode() for t in texts], 84)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        assert got[i] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def test_passages_before_zero_bytes(spark):
    """Texts that go on with more or fewer zero bytes differ in what they share, though padded suffixes look alike."""
    rng = np.random.default_rng(21)
    passages = ["".join(chr(97 + c) for c in rng.integers(0, 9, rng.integers(40, 60))) for _ in range(60)]
    texts = [p + "\0" * int(z) for p in passages for z in rng.permutation(10)[:4]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.remove_repeats(df, length=40).collect()}
    for i, gone in enumerate(brute([t.encode() for t in texts], 40)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        assert got[i] == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), i
