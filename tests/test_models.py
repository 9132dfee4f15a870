"""Mixtures, reductions, calibration, searches."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from marlstone.operators import classify as cl
from marlstone.operators import embeddings as emb
from marlstone.operators import metrics, mixture, onevsrest, reduction


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -1]])
    label = rng.integers(0, 3, 240)
    x = centres[label] + rng.normal(size=(240, 3)) * [1, 0.5, 0.8]
    df = spark.createDataFrame([(i, int(label[i]), [float(v) for v in x[i]]) for i in range(240)], "id int, label int, vec array<double>").repartition(4).cache()
    return df, x, label


@pytest.mark.parametrize("covariance", mixture.COVARIANCES)
def test_gaussian_mixture_finds_blobs(blobs, covariance):
    df, x, _ = blobs
    m = mixture.fit_gaussian(df, "vec", "id", 3, 3, covariance, max_iter=30)
    assert m.n == 240 and m.weights.sum() == pytest.approx(1)
    agreement = metrics.cluster_agreement(m.predict(df, "vec"), "label", "cluster").first()
    assert agreement.adjusted_rand > 0.95
    # The log-likelihood is the one of the rows under the fitted parameters.
    dens = sum(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(c), x - mu)) / math.sqrt(np.linalg.det(2 * math.pi * c))
               for w, mu, c in zip(m.weights, m.means, m.covariances))
    assert m.log_likelihood == pytest.approx(np.log(dens).sum(), rel=1e-3)
    assert m.parameters() == {"full": 18 + 9 + 2, "tied": 6 + 9 + 2, "diag": 9 + 9 + 2, "spherical": 3 + 9 + 2}[covariance]
    assert m.bic() - m.aic() == pytest.approx(m.parameters() * (math.log(240) - 2))


def test_likelihood_never_falls_without_a_floor(blobs):
    df, _, _ = blobs
    # The covariance floor moves the optimum a little, so the pure form is checked.
    m = mixture.fit_gaussian(df, "vec", "id", 3, 3, "full", reg=0.0, start="random", max_iter=12, tol=1e-9)
    assert len(m.history) == 12 and all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:]))


def test_posteriors_and_class_map(blobs):
    df, _, _ = blobs
    m = mixture.fit_gaussian(df, "vec", "id", 3, 3, "full", max_iter=20)
    post = m.posteriors(df, "vec")
    assert all(sum(r.probability) == pytest.approx(1) for r in post.collect())
    mapping = mixture.majority_labels(m.predict(df, "vec"), "cluster", "label")
    probs = mixture.class_probabilities(post, "id", "label", mapping).withColumn("pred", cl.argmax_class("probs"))
    assert metrics.accuracy(probs, "label", "pred").first()[0] > 0.95


def test_dirichlet_mixture_leaves_components_empty(blobs):
    df, _, _ = blobs
    m = mixture.fit_dirichlet(df, "vec", "id", 3, 6, "full", max_iter=60)
    assert m.weights.sum() == pytest.approx(1)
    assert (m.weights > 0.02).sum() <= 5
    again = mixture.fit_dirichlet(df.repartition(2), "vec", "id", 3, 6, "full", max_iter=60)
    assert again.log_likelihood == pytest.approx(m.log_likelihood)
    with pytest.raises(ValueError):
        mixture.fit_dirichlet(df, "vec", "id", 3, 2, "other")


def test_digamma():
    assert mixture.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert mixture.digamma(0.5) == pytest.approx(-1.9635100260, abs=1e-9)


def test_reductions_match_numpy(blobs):
    df, x, _ = blobs
    order = np.argsort([r.id for r in df.select("id").collect()])
    pca = reduction.fit_pca(df, "vec", 3, 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert pca.explained == pytest.approx(values[:2] / values.sum())
    got = np.array([r.reduced for r in pca.transform(df, "vec").collect()])[order]
    assert got.var(axis=0, ddof=1) == pytest.approx(values[:2])
    lsa = reduction.fit_lsa(df, "vec", 3, 2)
    rows = np.array([r.reduced for r in lsa.transform(df, "vec").collect()])
    assert np.linalg.norm(rows, axis=1) == pytest.approx(np.ones(240))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.abs(lsa.basis.T @ vt[:2].T) == pytest.approx(np.eye(2), abs=1e-6)


def test_one_vs_rest_and_calibration(blobs):
    df, _, _ = blobs
    rows = df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features")).cache()
    models = cl.OneVsRestScores.fit(cl.linear_svm(), rows, [0, 1, 2])
    scored = models.scores(rows, ["id", "label"]).cache()
    calibrated = cl.PlattCalibration.fit(scored, [0, 1, 2]).apply(scored)
    for probs in (calibrated, cl.sigmoid_probabilities(scored)):
        assert all(sum(x.p for x in r.probs) == pytest.approx(1) for r in probs.collect())
    accuracy = metrics.accuracy(calibrated.withColumn("prediction", cl.argmax_class("probs")), "label", "prediction").first()[0]
    assert accuracy > 0.95


def test_searches(blobs, spark):
    df, _, _ = blobs
    rows = df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features")).cache()
    grid = cl.grid_search(cl.softmax_regression(0.1, 10), {"regParam": [0.01, 100.0]}, rows, folds=2)
    assert grid.avgMetrics[0] > grid.avgMetrics[1]
    found = cl.random_search(cl.random_forest(), {"numTrees": [2, 3], "maxDepth": [2]}, 5, rows)
    assert len(found.getEstimatorParamMaps()) == 2
    out = cl.score_submission(found.bestModel, rows, "id")
    assert out.columns == ["id", "is_duplicate"] and out.count() == 240


def test_gaussian_bayes_parameters(blobs):
    df, x, label = blobs
    got = {(r["class"], r.i): (r.mean, r.variance) for r in cl.gaussian_bayes_parameters(df, "vec", "label").collect()}
    assert got[1, 2] == (pytest.approx(x[label == 1, 2].mean()), pytest.approx(x[label == 1, 2].var()))


def test_forest_in_parts_adds_the_votes(spark):
    rows = spark.createDataFrame([(i, float((i * 7 % 11) > 5), Vectors.dense([float(i % 5), float(i * 3 % 7)])) for i in range(60)], ["id", "label", "features"])
    forest = cl.fit_forest(7, rows, batch=3, depth=2)
    assert [m.getNumTrees for m in forest] == [3, 3, 1]
    votes = [{r["id"]: r["rawPrediction"].toArray() for r in m.transform(rows).collect()} for m in forest]
    got = {r["id"]: r["is_duplicate"] for r in cl.score_submission(forest, rows, "id").collect()}
    assert got == {i: int(sum(v[i] for v in votes).argmax()) for i in range(60)}


def test_forest_in_parts_has_the_trees_of_plain_fits(spark):
    rows = spark.createDataFrame([(float((i * 7 % 11) > 5), Vectors.dense([float(i % 5), float(i * 3 % 7), float(i * 5 % 13)])) for i in range(90)], ["label", "features"])
    forest = cl.fit_forest(10, rows, batch=4, bootstrap=False, seed=3)
    plain = [cl.random_forest(n, seed=3 + at).setBootstrap(False).fit(rows) for at, n in ((0, 4), (4, 4), (8, 2))]
    assert [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in forest] == [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in plain]
    assert all(m.getCacheNodeIds() for m in forest)        # else each level sends all trees to all tasks


@pytest.mark.parametrize("name,settings", [("grid_search", 21), ("random_search", 18)])
def test_searches_try_all_settings(spark, name, settings):
    import __spark_entry__ as contract

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    rows = contract.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len({r["setting"] for r in rows}) == settings


@pytest.mark.parametrize("loss", onevsrest.LOSSES)
def test_one_vs_rest_in_shared_scans(blobs, spark, loss):
    df, x, label = blobs
    odd = spark.createDataFrame([(900, None, [1.0, 2.0, 3.0]), (901, 1, None), (902, 1, [float("nan"), 0.0, 0.0]), (903, 1, [None, 0.0, 0.0])],
                                "id int, label int, vec array<double>")
    m = onevsrest.fit_one_vs_rest(df.unionByName(odd), [0, 1, 2, 7], loss, c=0.5)
    assert m.n == 240 and m.positives.tolist() == [*np.bincount(label), 0] and m.rounds < 60
    full = np.column_stack([x, np.ones(240)])
    for j, c in enumerate([0, 1, 2]):
        sign = np.where(label == c, 1, -1)
        margin = sign * (full @ m.weights[j])
        slope = -1 / (1 + np.exp(margin)) if loss == "logistic" else -2 * np.maximum(0, 1 - margin)
        gradient = 0.5 * ((slope * sign)[:, None] * full).sum(axis=0) + m.weights[j] * [1, 1, 1, 0]
        assert np.abs(gradient).max() < 1e-4
    assert m.gradient[:3].max() < 1e-7
    got = {r.id: [s.score for s in r.scores] for r in m.scores(df, ["id"]).collect()}
    ids = [r.id for r in df.select("id").collect()]
    assert np.array([got[i] for i in sorted(ids)])[:, :3] == pytest.approx((full @ m.weights.T)[:, :3])
    assert np.mean(np.argmax([got[i] for i in sorted(ids)], axis=1) == label) > 0.95
    assert onevsrest.fit_one_vs_rest(df.limit(0), [0, 1], loss).weights.shape == (2, 1)
    with pytest.raises(ValueError):
        onevsrest.fit_one_vs_rest(df, [0], "other")


def test_calibration_of_separable_scores_is_finite(spark):
    rows = [(i, float(i % 2), [(0, float(i % 2) * 4 - 2), (1, 2 - float(i % 2) * 4)] if i < 30 else [(0, 1.0)]) for i in range(31)]
    df = spark.createDataFrame(rows, "id int, label double, scores array<struct<class: int, score: double>>")
    fit = cl.PlattCalibration.fit(df, [0, 1])
    assert fit.gradient.max() < 1e-7
    a, b = fit.parameters[1]
    # All rows of a side have one score, so the fit meets both targets.
    for score, target in ((2.0, 1 / 17), (-2.0, 16 / 17)):
        assert 1 / (1 + math.exp(-(a * score + b))) == pytest.approx(target if a < 0 else 1 - target, abs=1e-6)
    assert cl.PlattCalibration.fit(df.limit(0), [0, 1]).parameters == {0: (0.0, 0.0), 1: (0.0, 0.0)}


def test_thinning_of_frequent_words(spark):
    rows = [(i, ["the"] * 60 + [f"w{i}", "rare"]) for i in range(200)] + [(900, []), (901, None), (None, ["w1", None])]
    df = spark.createDataFrame(rows, "doc long, tokens array<string>")
    got = {r.doc: r.tokens for r in emb.thin_frequent(df, "doc", "tokens", 0.01).collect()}
    n = 200 * 62 + 2 - 1
    f = 200 * 60 / n
    keep = ((f / 0.01) ** 0.5 + 1) * 0.01 / f
    assert sum(t.count("the") for t in got.values() if t) == pytest.approx(keep * 12000, rel=0.1)
    assert all(got[i][-2:] == [f"w{i}", "rare"] for i in range(200))               # 200 in 12401 are too few to go
    assert got[900] == [] and got[901] is None and got[None] == ["w1", None]
    again = {r.doc: r.tokens for r in emb.thin_frequent(df.repartition(5), "doc", "tokens", 0.01).collect()}
    assert again == got and emb.thin_frequent(df.limit(0), "doc", "tokens").count() == 0
    assert {r.doc: r.tokens for r in emb.thin_frequent(df, "doc", "tokens", 1.0).collect()} == dict(rows)
