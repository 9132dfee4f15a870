"""Fitted models over the embeddings, question pairs and documents."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import classify as cl
from ..operators import embeddings as emb
from ..operators import metrics, mixture, onevsrest, openset, reduction, sampling
from ..session import write_cut
from .catalog import query, table
from .classification import UNSEEN, embeddings
from .question_pairs import pair_matrix
from .sql import cleaned, tokens

SIZE = 64
CLASSES = tuple(c for c in range(10) if c not in UNSEEN)
PERCENTILE = 90
# Share from which the occurrences of a word are thinned out before word vectors are trained.
SAMPLE = 0.001


def split_embeddings(spark, sf_dir):
    """vec_id, label, vec, features, split (64/16/20)."""
    rows = embeddings(spark, sf_dir).select(
        "vec_id", F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    return sampling.three_way_split(rows.withColumn("features", array_to_vector("vec")), "vec_id")


def parts(spark, sf_dir):
    rows = split_embeddings(spark, sf_dir)
    train, valid, test = (rows.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    return openset.seen_only(train, "label", UNSEEN), valid, test


@query("word_vectors")
def word_vectors(spark, sf_dir):
    model = fitted_words(spark, sf_dir)
    return emb.word_table(model).select("word", F.posexplode("vec").alias("i", "x"))


def fitted_words(spark, sf_dir):
    # The fit reads its input for the vocabulary and for the training.
    tokens = write_cut(thinned(spark, sf_dir).select("tokens"), "thinned")
    return emb.fit_word_vectors(tokens, "tokens", size=100, min_count=20, window=10, iterations=5)


def thinned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", t.tokenize(t.clean_text("text")).alias("tokens"))
    return emb.thin_frequent(docs, "doc_id", "tokens", SAMPLE)


@query("thin_frequent_words", f"""
WITH t AS (SELECT doc_id, {tokens(cleaned("text"))} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
f AS (SELECT word, count(*) / (SELECT count(*) FROM u)::DOUBLE AS f FROM u GROUP BY word),
p AS (SELECT word, (sqrt(f / {SAMPLE}) + 1) * ({SAMPLE} / f) AS keep FROM f),
k AS (SELECT doc_id, i, word FROM u JOIN p USING (word) WHERE keep >= 1
  OR ('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR || ':1'), 1, 8))::BIGINT / 4294967296.0 < keep)
SELECT t.doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS tokens FROM t LEFT JOIN k USING (doc_id) GROUP BY t.doc_id""")
def thin_frequent_words(spark, sf_dir):
    """What word vectors are trained on: documents with frequent words thinned out."""
    return thinned(spark, sf_dir).select("doc_id", F.coalesce(F.concat_ws(" ", "tokens"), F.lit("")).alias("tokens"))


@query("doc_vectors")
def doc_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", t.tokenize(t.clean_text("text")).alias("tokens"))
    return emb.document_vectors(fitted_words(spark, sf_dir), docs, ["doc_id"], "tokens").select("doc_id", F.posexplode("vec").alias("i", "x"))


@query("pca")
def pca(spark, sf_dir):
    train, _, _ = parts(spark, sf_dir)
    fit = reduction.fit_pca(train, "vec", SIZE, 20)
    rows = split_embeddings(spark, sf_dir)
    return fit.transform(rows, "vec", "reduced").select("vec_id", F.posexplode("reduced").alias("i", "x"))


@query("lsa")
def lsa(spark, sf_dir):
    return reduced(spark, sf_dir).select("vec_id", "split", F.posexplode("vec").alias("i", "x"))


def reduced(spark, sf_dir):
    """All rows in 20 latent dimensions, fitted on the seen training rows."""
    train, _, _ = parts(spark, sf_dir)
    fit = reduction.fit_lsa(train, "vec", SIZE, 20)
    return fit.transform(split_embeddings(spark, sf_dir), "vec", "reduced").select(
        "vec_id", F.col("label").cast("int").alias("label"), "split", F.col("reduced").alias("vec"))


# -- pair classifiers ---------------------------------------------------------------


def pair_parts(spark, sf_dir):
    """Assembled pair features, written once, split 75/25."""
    rows = write_cut(pair_matrix(spark, sf_dir).withColumn("label", F.col("label").cast("double")), "pair-matrix")
    rows = sampling.train_test_split(rows, "id", 0.75, seed=42)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _reported(name, build):
    def run(spark, sf_dir):
        train, test = pair_parts(spark, sf_dir)
        predictions = build(train).fit(train).transform(test)
        return metrics.classification_report(predictions, "label", "prediction")

    query(name)(run)


_reported("rf_classify", lambda _: cl.random_forest(trees=20, impurity="entropy", subset="all"))
_reported("lr_l1", lambda train: cl.l1_logistic(1.0, train.count()))
_reported("linear_svc", lambda _: cl.linear_svm())
_reported("gnb_classify", lambda _: cl.gaussian_bayes())


@query("gnb_params", """
SELECT label AS class, i::INTEGER AS i, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance
FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""")
def gnb_params(spark, sf_dir):
    out = cl.gaussian_bayes_parameters(embeddings(spark, sf_dir), "embedding", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query("random_search")
def random_search(spark, sf_dir):
    train, _ = pair_parts(spark, sf_dir)
    space = {"numTrees": [10, 20, 30], "maxDepth": [4, 6, 8], "featureSubsetStrategy": ["log2", "sqrt"]}
    search = cl.random_search(cl.random_forest(), space, 18, train)
    return cl.search_table(spark, search.getEstimatorParamMaps(), search.validationMetrics)


@query("score_submission")
def score_submission(spark, sf_dir):
    train, test = pair_parts(spark, sf_dir)
    forest = cl.fit_forest(1302, train, bootstrap=False, seed=1, impurity="entropy", subset="log2")
    return cl.score_submission(forest, test, "id")


# -- open-set classifiers -----------------------------------------------------------


def margins(spark, sf_dir, loss="squared_hinge"):
    """One-vs-rest models on the seen training rows: (validation, test) raw scores."""
    _, valid, test = parts(spark, sf_dir)
    models = fitted_margins(spark, sf_dir, loss)
    keep = ("vec_id", "label")
    return models.scores(openset.seen_only(valid, "label", UNSEEN), keep), models.scores(test, keep)


def fitted_margins(spark, sf_dir, loss):
    train, _, _ = parts(spark, sf_dir)
    return onevsrest.fit_one_vs_rest(train, CLASSES, loss)


# A fit has ended where its gradient is nil next to that at zero weights.
_FITS = f"""
WITH seen AS (SELECT label FROM embeddings WHERE label NOT IN {UNSEEN}
  AND ('0x' || substr(md5(vec_id::VARCHAR || ':10'), 1, 8))::BIGINT / 4294967296.0 < 0.8
  AND ('0x' || substr(md5(vec_id::VARCHAR || ':11'), 1, 8))::BIGINT / 4294967296.0 < 0.8)
SELECT loss, class, 0.0::DOUBLE AS gradient, count(label) AS n, count(*) FILTER (label = class) AS positives
FROM (VALUES ('logistic'), ('squared_hinge')) AS l(loss), (SELECT unnest({list(CLASSES)}) AS class), seen GROUP BY 1, 2"""


@query("one_vs_rest_fits", _FITS)
def one_vs_rest_fits(spark, sf_dir):
    """Rows each class was fitted on, and the gradient where its fit ended as a share of the first one."""
    rows = []
    for loss in onevsrest.LOSSES:
        m = fitted_margins(spark, sf_dir, loss)
        rows += [(loss, c, abs(round(float(g), 6)), m.n, int(p)) for c, g, p in zip(m.classes, m.gradient, m.positives)]
    return spark.createDataFrame(rows, "loss string, class int, gradient double, n long, positives long")


# The slope of a logistic line has the sign of the covariance of margin and target.
@query("platt_fits", f"SELECT unnest({list(CLASSES)}) AS class, 0.0::DOUBLE AS gradient, TRUE AS same_sign")
def platt_fits(spark, sf_dir):
    """Where the calibration of each class ended, and its slope beside the covariance of margins and labels."""
    valid, _ = margins(spark, sf_dir)
    fit = cl.PlattCalibration.fit(valid, CLASSES)
    ends = spark.createDataFrame([(c, abs(round(float(g), 6)), fit.parameters[c][0]) for c, g in zip(CLASSES, fit.gradient)],
                                 "class int, gradient double, slope double")
    rows = valid.select("label", F.explode("scores").alias("x"))
    together = rows.groupBy(F.col("x.class").alias("class")).agg(
        F.covar_pop("x.score", (F.col("label") == F.col("x.class")).cast("double")).alias("covariance"))
    return ends.join(together, "class").select("class", "gradient", (F.signum("slope") == F.signum("covariance")).alias("same_sign"))


def _long(df):
    return df.select("vec_id", "label", F.explode("probs").alias("x")).select("vec_id", "label", "x.*")


@query("one_vs_rest")
def one_vs_rest(spark, sf_dir):
    _, test = margins(spark, sf_dir, "logistic")
    return _long(cl.sigmoid_probabilities(test))


@query("platt_calibrate")
def platt_calibrate(spark, sf_dir):
    valid, test = margins(spark, sf_dir)
    return _long(cl.PlattCalibration.fit(valid, CLASSES).apply(test))


@query("open_set_calibrated")
def open_set_calibrated(spark, sf_dir):
    """Branch one end to end: margins, calibration, scaling, percentile, report."""
    valid, test = margins(spark, sf_dir)
    probs = write_cut(cl.PlattCalibration.fit(valid, CLASSES).apply(test), "calibrated")
    decided = openset.open_set_predict(openset.scale_class_probs(probs), PERCENTILE, "max_label")
    decided = decided.withColumn("label", openset.relabel_unseen(F.col("label").cast("int"), UNSEEN))
    return metrics.classification_report(decided, "label", "prediction")


@query("grid_search")
def grid_search(spark, sf_dir):
    _, valid, _ = parts(spark, sf_dir)
    rows = openset.seen_only(valid, "label", UNSEEN).select("features", "label").persist()
    # Inverse strengths over the rows that two of three folds train on.
    n = max(1.0, rows.count() * 2 / 3)
    grid = {"regParam": [1 / (c * n) for c in (0.001, 0.01, 0.1, 0.5, 1, 2, 5)], "tol": [1e-3, 5e-4, 1e-4]}
    search = cl.grid_search(cl.softmax_regression(0.1), grid, rows, folds=3)
    table_ = cl.search_table(spark, search.getEstimatorParamMaps(), search.avgMetrics)
    rows.unpersist()
    return table_


@query("softmax_vectors")
def softmax_vectors(spark, sf_dir):
    train, _, test = parts(spark, sf_dir)
    model = cl.softmax_regression(0.1).fit(train)
    return model.transform(openset.seen_only(test, "label", UNSEEN)).select(
        "vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        F.array_max(vector_to_array("probability")).alias("p"))


# -- mixtures -----------------------------------------------------------------------

COMPONENTS = len(CLASSES)


def latent(spark, sf_dir):
    rows = write_cut(reduced(spark, sf_dir), "latent")
    train = openset.seen_only(rows.filter("split = 'train'"), "label", UNSEEN)
    return train, rows.filter("split = 'validation'"), rows.filter("split = 'test'")


@query("gmm_fit")
def gmm_fit(spark, sf_dir):
    train, _, _ = latent(spark, sf_dir)
    model = mixture.fit_gaussian(train, "vec", "vec_id", 20, COMPONENTS, "diag")
    return model.predict(train, "vec").select("vec_id", "label", "cluster")


@query("gmm_bic")
def gmm_bic(spark, sf_dir):
    train, _, _ = latent(spark, sf_dir)
    best, fits = mixture.select_gaussian(train, "vec", "vec_id", 20, COMPONENTS)
    rows = [(c, m.bic(), m.aic(), m.rounds, int(m is best)) for c, m in fits.items()]
    return spark.createDataFrame(rows, "covariance string, bic double, aic double, rounds int, is_best int")


@query("gmm_posteriors")
def gmm_posteriors(spark, sf_dir):
    """Branch two end to end: mixture, majority map, sweep on validation, test decision."""
    return decided(*latent(spark, sf_dir)).select("vec_id", "label", "prediction")


def decided(train, valid, test):
    """Test rows with the class of the open-set decision, 0 for unseen."""
    model = mixture.fit_gaussian(train, "vec", "vec_id", 20, COMPONENTS, "diag")
    mapping = write_cut(mixture.majority_labels(model.predict(train, "vec"), "cluster", "label"), "majority")

    def probabilities(rows, name):
        probs = mixture.class_probabilities(model.posteriors(rows, "vec"), "vec_id", "label", mapping)
        return write_cut(openset.scale_class_probs(write_cut(probs, name)), name).withColumn(
            "label", openset.relabel_unseen("label", UNSEEN))

    best = openset.best_threshold(openset.threshold_sweep(probabilities(valid, "posteriors-valid"), "label")).first()
    percentile = best.threshold if best else PERCENTILE
    return openset.open_set_predict(probabilities(test, "posteriors-test"), percentile, "argmax")


@query("dp_mixture")
def dp_mixture(spark, sf_dir):
    train, _, _ = latent(spark, sf_dir)
    model = mixture.fit_dirichlet(train, "vec", "vec_id", 20, COMPONENTS, "full")
    return model.predict(train, "vec").select("vec_id", "label", "cluster")


@query("recluster_unseen")
def recluster_unseen(spark, sf_dir):
    """Rows that were predicted unseen, clustered again in each covariance type."""
    train, valid, test = latent(spark, sf_dir)
    rejected = decided(train, valid, test).filter("prediction = 0").select("vec_id")
    unseen = write_cut(test.join(rejected, "vec_id", "left_semi"), "predicted-unseen")
    if unseen.isEmpty():
        return unseen.selectExpr("CAST(NULL AS STRING) AS covariance", "vec_id", "label", "0 AS cluster")
    out = None
    for covariance in mixture.COVARIANCES:
        model = mixture.fit_dirichlet(unseen, "vec", "vec_id", 20, 2, covariance, mean_precision=1.0)
        part = model.predict(unseen, "vec").select(F.lit(covariance).alias("covariance"), "vec_id", "label", "cluster")
        out = part if out is None else out.unionByName(part)
    return out


@query("recluster_scores")
def recluster_scores(spark, sf_dir):
    """How well the new clusters of each covariance type agree with the true classes."""
    rows = write_cut(recluster_unseen(spark, sf_dir), "reclustered")
    out = None
    for covariance in mixture.COVARIANCES:
        part = metrics.cluster_agreement(rows.filter(F.col("covariance") == covariance), "label", "cluster")
        part = part.select(F.lit(covariance).alias("covariance"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("silhouette")
def silhouette(spark, sf_dir):
    train, _, _ = latent(spark, sf_dir)
    model = mixture.fit_gaussian(train, "vec", "vec_id", 20, COMPONENTS, "diag")
    clusters = model.predict(train, "vec").withColumn("features", array_to_vector("vec"))
    return spark.createDataFrame([(metrics.silhouette(clusters, "features", "cluster"),)], "silhouette double")


@query("silhouette_labels", """
WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
  ORDER BY md5(vec_id::VARCHAR || ':0'), vec_id LIMIT 1000),
pairs AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS d, count(*) AS n FROM s a, s b GROUP BY 1, 2, 3),
own AS (SELECT vec_id, label, d / greatest(n - 1, 1) AS a, n FROM pairs WHERE label = other),
near AS (SELECT vec_id, min(d / n) AS b FROM pairs WHERE label <> other GROUP BY vec_id)
SELECT vec_id, label, round(CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette
FROM own LEFT JOIN near USING (vec_id)""")
def silhouette_labels(spark, sf_dir):
    """Of the given labels, on a sample of 1000 vectors."""
    return metrics.silhouette_sample(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))
