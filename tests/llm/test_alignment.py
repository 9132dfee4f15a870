"""Alignment of two tokenisers against a plain one without cuts, stores or parts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm import alignment
from marlstone.llm.packing import byte_characters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    to_byte = byte_characters()

    def groups(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []

        def ends(tokens):
            out = [0]
            for t in tokens:
                out.append(out[-1] + len(t))
            return out[1:]

        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        out, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            out.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= cut], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= cut]))
            low = cut
        return out

    def measures(texts):
        all_groups = [groups(t or "") for t in texts]
        links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in all_groups]
        count = Counter(p for own in links for p in own)
        most = Counter()
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        rows = []
        for gs, own in zip(all_groups, links, strict=True):
            string = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
            rows.append((sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(own.values()),
                         sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()),
                         hashlib.sha256(string.encode()).hexdigest() if gs else ""))
        return rows, {(*p, n, n == most[p[0]]) for p, n in count.items()}

    return measures


TEXTS = [
    None, "", " ", "a", "The quick brown fox", "The quick brown fox", "  two  spaces \n\n and\ttabs ", "Ünï 日本語 😀 ça", "has ▁ in it", "▁", "<|endoftext|> <s> </s> <unk> <0x41>",
    "x=3;y>=4 don't they'll", "=" * 900, "日本" * 300, "́ combining é", "The quick brown fox", "\r\n", "nul \x00 byte", "0123456789 " * 40, "word" * 3000, " nbsp 　wide"]


@pytest.mark.parametrize("part_bytes", [1, 60, 1 << 23])
def test_measures_and_pairs_equal_the_plain_ones(spark, plain, part_bytes):
    ids = [None if i == 4 else 7 if i in (5, 6) else 100 + i for i in range(len(TEXTS))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, part int, digest int, weight int")
    got = alignment.align_tokenizers(docs, *PATHS, part_bytes=part_bytes)
    rows, pairs = plain(TEXTS)
    order = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.measures.collect()), key=order) == sorted(((i, *r) for i, r in zip(ids, rows, strict=True)), key=order)
    assert {tuple(r) for r in got.pairs.collect()} == pairs


def test_many_copies_and_large_groups(spark, plain, monkeypatch):
    texts = ["copied text here"] * 600 + [f"own text {i} of {i * i}" for i in range(300)] + [None] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, alignment.align_tokenizers(docs, *PATHS).measures.collect()))
    assert got == [(i, *r) for i, r in enumerate(plain(texts)[0])]
    # Counting by distinct ids gives what listing the pairs gives.
    monkeypatch.setattr(alignment, "LISTED", 0)
    texts = [t for t in TEXTS if t]
    whole = alignment._Aligner(*PATHS)
    places = whole.places(texts)
    monkeypatch.setattr(alignment, "LISTED", 1 << 30)
    listed = alignment._Aligner(*PATHS)
    for own, other in zip(places, listed.places(texts), strict=True):
        for i, j in zip(own.tolist(), other.tolist(), strict=True):
            assert whole.strings[i] == listed.strings[j] and whole.numbers[4 * i:4 * i + 4] == listed.numbers[4 * j:4 * j + 4]
            assert _pairs_of(whole, i) == _pairs_of(listed, j)


def _pairs_of(aligner, i):
    out = Counter()
    for k in range(aligner.ends[i], aligner.ends[i + 1]):
        out[aligner.keys[k]] += aligner.times[k]
    return out


def test_no_rows(spark):
    got = alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert got.measures.count() == got.pairs.count() == 0
