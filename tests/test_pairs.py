import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import similarity as sim
from marlstone.functions import vectors as v
from marlstone.operators import pairs


def _table(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>").orderBy("i")


def test_token_scores_brute_force(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcde") for _ in range(rng.randrange(0, 8))], [rng.choice("abcde") for _ in range(rng.randrange(0, 8))]) for _ in range(200)]
    got = _table(spark, rows).select(sim.shared_words("a", "b"), sim.ochiai("a", "b"), sim.jaccard("a", "b"), sim.overlap("a", "b"), sim.unique_words("a", "b")).collect()
    for (a, b), (shared, och, jac, ovl, uniq) in zip(rows, got):
        both = set(a) & set(b)
        n = len(a) + len(b)
        assert shared == pytest.approx((sum(w in b for w in a) + sum(w in a for w in b)) / n if n else 0.0)
        assert och == (pytest.approx(len(both) / (len(a) ** 0.5 * len(b) ** 0.5)) if a and b else None)
        assert jac == (pytest.approx(len(both) / len(set(a) | set(b))) if n else None)
        assert ovl == (pytest.approx(len(both) / min(len(set(a)), len(set(b)))) if a and b else None)
        if a and b:
            assert jac <= ovl
        assert uniq == sorted(set(a) ^ set(b))


def _distance(a, b):
    """Reference recursion of the unrestricted transposition distance."""
    table, last = {}, {}
    far = len(a) + len(b)
    table[-1, -1] = far
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = far, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            table[i, j] = min(table[i - 1, j - 1] + cost, table[i, j - 1] + 1, table[i - 1, j] + 1,
                              table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return table[len(a), len(b)]


def test_edit_distances(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string").orderBy("i")
    got = df.select(sim.transposition_distance("a", "b"), sim.hamming("a", "b")).collect()
    for (a, b), (d, h) in zip(rows, got):
        assert d == _distance(a, b)
        assert h == sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def test_jaro_winkler_published(spark):
    rows = [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("DWAYNE", "DUANE", 0.84), ("abc", "xyz", 0.0), ("", "", 1.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(F.round(sim.jaro_winkler("a", "b"), 6)).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_score_names(spark):
    df = spark.createDataFrame([("a-b", None)], "a string, b string")
    assert df.select(sim.pair_score("damerau_levenshtein", "a", "b")).first()[0] == _distance("ab", "empty string")
    with pytest.raises(ValueError):
        sim.pair_score("nothing", "a", "b")


def test_pair_features(spark):
    df = spark.createDataFrame([(1, "How are you", "How are you"), (2, "", "x y")], "id int, question1 string, question2 string")
    same, empty = pairs.pair_features(df, keep_scores=True).orderBy("id").collect()
    assert (same.q1_length, same.q1_numwords, same.shared_words_norm, same.avg_similarity) == (11, 3, 1.0, 1.0)
    assert (empty.q1_length, empty.q1_numwords, empty.jaccard) == (0, 1, 0.0)


def test_min_max_scale_uses_training_extremes(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 5.0), (20.0, 7.0)], "a double, b double")
    got = pairs.min_max_scale(test, ["a", "b"], -0.25, 0.25, fitted_on=train).collect()
    assert [tuple(r) for r in got] == [(0.0, -0.25), (0.75, 0.75)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(v.cosine("a", "b")).collect()] == [pytest.approx(0.96), 0.0]
    assert [r[0] for r in df.select(v.l2_normalize("a")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_edit_distances_of_many_pairs_at_once(monkeypatch):
    """Equal ends, letters outside the first plane, empty texts, and pairs too large for a common table."""
    rng = random.Random(8)
    rows = []
    for alphabet, size in (("ab", 5), ("abc é😀", 25), ("abcdefgh ", 60)):
        for _ in range(120):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
            cut, edit = rng.randrange(len(a) + 1), "".join(rng.choice(alphabet) for _ in range(rng.randrange(4)))
            rows.append((a, a[:cut] + edit + a[cut + rng.randrange(3):]) if rng.random() < 0.5 else (a, a[::-1]))
    x, y = (pd.Series(c) for c in zip(*rows))
    want = [_distance(a, b) for a, b in rows]
    assert sim._transposition_distances(x, y).tolist() == want
    monkeypatch.setattr(sim, "CELLS", 900)
    assert sim._transposition_distances(x, y).tolist() == want
    assert sim._jaro_winklers(x, y).tolist() == pytest.approx([_jaro_winkler(a, b) for a, b in rows], abs=1e-12)


def _jaro_winkler(a, b):
    """The published formula, letter by letter."""
    if not a or not b:
        return float(a == b)
    window, free, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(range(len(b))), []
    for i, ch in enumerate(a):
        spot = next((j for j in range(max(0, i - window), min(len(b), i + window + 1)) if j in free and b[j] == ch), None)
        if spot is not None:
            free.remove(spot)
            mine.append(ch)
    if not mine:
        return 0.0
    theirs = [ch for j, ch in enumerate(b) if j not in free]
    m, half = len(mine), sum(p != q for p, q in zip(mine, theirs)) // 2
    score = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return score + prefix * 0.1 * (1 - score) if score > 0.7 else score
