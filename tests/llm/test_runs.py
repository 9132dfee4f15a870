"""Periodic runs against the definition."""

import zlib

import numpy as np

from marlstone.llm import queries, runs


def brute(words, min_length=runs.MIN_LENGTH):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= min_length:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, rows):
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words_are_those_of_the_definition():
    rng = np.random.default_rng(5)
    for trial in range(400):
        texts = []
        for _ in range(rng.integers(1, 5)):
            words = rng.integers(0, rng.integers(1, 4) + 1, rng.integers(0, 80)).tolist()
            unit = rng.integers(0, 2, rng.integers(1, 9)).tolist()
            texts.append(words[:20] + (unit * int(rng.integers(1, 6)) + [7] * int(trial % 2)) * int(rng.integers(1, 4)) + words[20:] if trial % 3 else words)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        for min_length in (2, 12):
            got = runs.runs_of(np.array(sum(texts, []), np.int64), starts[sizes > 0], min_length)
            want = sorted(((s + int(a), n, q) for t, a in zip(texts, starts, strict=True) for s, n, q in brute(t, min_length)), key=lambda r: (r[0], r[2]))
            assert [tuple(r) for r in got.tolist()] == want


def test_fibonacci_and_touching_stretches():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    for text in (b, "b" + "ab" * 9 + "a" + "ab" * 9 + "a" + "b" + "ab" * 20, "a" * 300, ("a" * 40 + "b") * 9 + "a" * 40):
        codes = np.array([ord(c) for c in text], np.int64)
        assert [tuple(r) for r in runs.runs_of(codes, np.zeros(1, np.int64)).tolist()] == brute(text)


def test_texts_and_their_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "a b " * 6), (3, "a b " * 6), (None, "x\x0b" * 11), (5, "x y " * 12), (6, long), (7, "one two")]
    docs = spark.createDataFrame([(i, t, "p") for i, t in texts], "doc_id long, text string, periodic string")
    for part in (1, 1 << 18):
        got = runs.find_runs(docs, part_words=part).collect()
        assert len(got) == len(texts)
        for r in got:
            words = (r["text"] or "").encode().split()
            words = [w.decode() for w in words]
            found = [tuple(x) for x in r["periodic_"]["runs"]]
            assert r["periodic_"]["n_words"] == len(words) and r["periodic_"]["collapsed"] == collapsed(words, found)
            if r["doc_id"] == 6:
                assert found == [(0, 30_000, 700)]
            else:
                assert found == brute(words)
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_query_plants_and_digests(spark, tmp_path):
    import hashlib

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 4 if i % 2 else 900, rng.integers(0, 60)))) for i in range(400)] + [(400, None), (None, "a " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            planted += 1
        found = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want = (i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
                hashlib.sha256(collapsed(words, found).encode()).hexdigest())
        assert tuple(got[i]) == want
    assert planted > 20
