"""Open-set decisions, metrics, experiment analysis."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.statistics import student_t_two_sided
from marlstone.operators import experiment as ex
from marlstone.operators import metrics, openset

PROBS = "id int, label int, probs array<struct<class:int,p:double>>"


def _probs(spark, rows, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.random((rows, 3)).round(3)
    labels = rng.integers(0, 4, rows)
    data = [(i, int(labels[i]), [(c, float(p[i, j])) for j, c in enumerate((1, 2, 4))]) for i in range(rows)]
    return spark.createDataFrame(data, PROBS).repartition(3), p, labels


def _decide(p, thresholds, rule):
    classes = np.array([1, 2, 4])
    kept = np.where((p >= thresholds) & (p > 0), p, 0)
    if rule == "argmax":
        kept = np.where(kept == kept.max(axis=1, keepdims=True), kept, 0)
    return np.where(kept > 0, classes, 0).max(axis=1)


@pytest.mark.parametrize("rule", ["max_label", "argmax"])
def test_open_set_rules_match_numpy(spark, rule):
    df, p, _ = _probs(spark, 301)
    got = {r.id: r.prediction for r in openset.open_set_predict(df, 85, rule).collect()}
    want = _decide(p, np.percentile(p, 85, axis=0), rule)
    assert [got[i] for i in range(301)] == list(want)
    assert set(want) <= {0, 1, 2, 4}


def test_scaling_and_unknown_rule(spark):
    df, p, _ = _probs(spark, 50)
    got = {r.id: [x.p for x in r.probs] for r in openset.scale_class_probs(df).collect()}
    want = p / (p.max(axis=0) - p.min(axis=0))
    assert got[7] == pytest.approx(list(want[7]))
    with pytest.raises(ValueError):
        openset.open_set_predict(df, 85, "other")


def test_sweep_matches_numpy(spark):
    df, p, labels = _probs(spark, 200, seed=3)
    best = (0.0, 0)
    got = {r.threshold: r for r in openset.threshold_sweep(df, "label").collect()}
    assert sorted(got) == list(range(50, 95))
    for q in range(50, 95):
        pred = _decide(p, np.percentile(p, float(q), axis=0), "argmax")
        tp, fp, fn = ((labels == 0) & (pred == 0)).sum(), ((labels != 0) & (pred == 0)).sum(), ((labels == 0) & (pred > 0)).sum()
        assert (got[q].tp, got[q].fp, got[q].fn) == (tp, fp, fn)
        if tp:
            f1 = 2 * tp / (2 * tp + fp + fn)
            assert got[q].f1 == pytest.approx(f1)
            if f1 > best[0] and (pred == 0).sum() / (labels == 0).sum() < 1.1:
                best = (f1, q)
    row = openset.best_threshold(openset.threshold_sweep(df, "label")).first()
    assert (row.f1, row.threshold) == (pytest.approx(best[0]), best[1])


def test_report_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, prediction int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(df, "label", "prediction").collect()}
    assert got == {0: (0.5, 0.5, 0.5, 2), 1: (pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 2), 2: (0.0, 0.0, 0.0, 1)}
    assert metrics.accuracy(df, "label", "prediction").first()[0] == pytest.approx(0.6)
    assert metrics.macro_f1(df, "label", "prediction").first()[0] == pytest.approx(1.3 / 3)
    assert metrics.unseen_accuracy(df, "label", "prediction").first().accuracy == 0.5
    loss = metrics.log_loss(spark.createDataFrame([(0.5,), (0.0,)], "p double"), F.col("p")).first()[0]
    assert loss == pytest.approx((-math.log(0.5) - math.log(1e-15)) / 2)


def test_agreement_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.randrange(4)) for _ in range(60)]
    got = metrics.cluster_agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    n = len(rows)
    both = [(rows[i][0] == rows[j][0], rows[i][1] == rows[j][1]) for i in range(n) for j in range(i)]
    tp = sum(x and y for x, y in both)
    a, b, total = sum(x for x, _ in both), sum(y for _, y in both), len(both)
    assert got.fowlkes_mallows == pytest.approx(tp / math.sqrt(a * b))
    assert got.adjusted_rand == pytest.approx((tp - a * b / total) / ((a + b) / 2 - a * b / total))
    same = metrics.cluster_agreement(spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "a int, b int"), "a", "b").first()
    assert tuple(same) == pytest.approx((1.0,) * 5)
    one = metrics.cluster_agreement(spark.createDataFrame([(0, 0), (0, 0)], "a int, b int"), "a", "b").first()
    assert tuple(one)[:4] == pytest.approx((1.0, 1.0, 1.0, 1.0))


def _robust(x, y, groups):
    x = np.column_stack([np.ones(len(y)), x])
    a = np.linalg.inv(x.T @ x)
    beta = a @ x.T @ y
    e = y - x @ beta
    s = np.array([(x[groups == g] * e[groups == g, None]).sum(axis=0) for g in np.unique(groups)])
    m, (n, k) = len(s), x.shape
    cov = a @ (s.T @ s) @ a * (m / (m - 1)) * ((n - 1) / (n - k))
    return beta, np.sqrt(np.diag(cov)), e


def test_clustered_regression_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n = 400
    groups = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))      # one hot cluster
    x = rng.normal(size=(n, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=n) + groups * 0.1
    df = spark.createDataFrame([(int(g), float(a), float(b), float(c), int(g % 2)) for g, (a, b), c in zip(groups, x, y)],
                               "g int, a double, b double, y double, half int").repartition(5)
    got = {r.term: r for r in ex.ols(df, "y", ["a", "b"], cluster="g").collect()}
    beta, se, e = _robust(x, y, groups)
    for i, term in enumerate(("intercept", "a", "b")):
        assert (got[term].estimate, got[term].std_error) == (pytest.approx(beta[i]), pytest.approx(se[i]))
        assert got[term].t_value == pytest.approx(beta[i] / se[i])
    by = {(r.half, r.term): r for r in ex.ols(df, "y", ["a", "b"], cluster="g", by=["half"]).collect()}
    for half in (0, 1):
        pick = groups % 2 == half
        beta_h, se_h, _ = _robust(x[pick], y[pick], groups[pick])
        assert (by[half, "b"].estimate, by[half, "b"].std_error) == (pytest.approx(beta_h[2]), pytest.approx(se_h[2]))
    table = ex.regression_table(df, "y", ["a", "b"]).first()
    r2 = 1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert (table.n, table.r2, table.adj_r2) == (n, pytest.approx(r2), pytest.approx(1 - (1 - r2) * (n - 1) / (n - 3)))
    plain = {r.term: r.std_error for r in ex.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(n), x])
    assert plain["a"] == pytest.approx(math.sqrt((e ** 2).sum() / (n - 3) * np.linalg.inv(design.T @ design)[1, 1]))


def test_t_distribution_known_values(spark):
    # Two-sided probabilities from published tables.
    known = ((12.706, 1, 0.05), (2.228, 10, 0.05), (1.96, 1e6, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0))
    df = spark.createDataFrame([(t, float(n), p) for t, n, p in known], "t double, n double, p double")
    for r in df.withColumn("got", student_t_two_sided("t", "n")).collect():
        assert r.got == pytest.approx(r.p, abs=2e-4)


def test_t_distribution_equals_the_integral(spark):
    """Against Simpson's rule over the density, for few and very many degrees of freedom."""
    cases = [(t, n) for t in (-8.0, -1.3, 0.001, 0.7, 2.0, 5.5, 40.0) for n in (1.0, 2.0, 3.0, 9.0, 57.0, 5000.0, 3e6)]
    df = spark.createDataFrame(cases, "t double, n double")
    for r in df.withColumn("got", student_t_two_sided("t", "n")).collect():
        u = np.linspace(0, abs(r.t), 200_001)
        f = np.exp(math.lgamma((r.n + 1) / 2) - math.lgamma(r.n / 2) - 0.5 * math.log(r.n * math.pi) - (r.n + 1) / 2 * np.log1p(u * u / r.n))
        area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (u[1] - u[0]) / 3
        assert r.got == pytest.approx(1 - 2 * area, abs=3e-8)
    odd = spark.createDataFrame([(float("nan"), 3.0), (float("inf"), 3.0), (1.0, 0.0), (1.0, -2.0)], "t double, n double")
    assert all(math.isnan(r.got) for r in odd.select(student_t_two_sided("t", "n").alias("got")).collect())


def test_profit_and_design(spark):
    df = spark.createDataFrame([("KD1", 100.0, 10.0, 1, 1, 0), ("CD2", 50.0, 0.0, 0, 0, 1)], "e string, amount double, discount double, ship int, t int, big int")
    got = df.select(ex.profit("amount", "discount", "ship").alias("p"), ex.consultant("e").alias("c")).collect()
    assert [(r.p, r.c) for r in got] == [(pytest.approx(100 - 0.45 * 110 - 6.5), "KD"), (pytest.approx(27.5), "CD")]
    design, xs = ex.interaction_design(df.withColumn("c", ex.consultant("e")), "t", "big", "c", "KD")
    assert [tuple(r) for r in design.select(*xs).collect()] == [(1.0, 0.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0, 0.0)]
