"""Open-set classification of the embeddings and its evaluation.

The scorer here is closed form (nearest seen-class centroids), so the decision
logic can be checked against SQL; fitted models are in ``models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import metrics, openset
from ..session import write_cut
from .catalog import query, table

UNSEEN = (0, 3)
SHARPNESS = 4.0
PERCENTILE = 85


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def scored(spark, sf_dir, scaled: bool = True, unseen=UNSEEN):
    """vec_id, label, probs over the seen classes (rounded, so ties are ties)."""
    emb = embeddings(spark, sf_dir)
    centroids = openset.class_centroids(openset.seen_only(emb, "label", unseen), "label", "embedding")
    probs = _rounded(openset.centroid_scores(emb, "vec_id", "label", "embedding", centroids, SHARPNESS))
    # Ranges, thresholds and decisions each read the scores: write them once.
    probs = write_cut(probs, "class-scores")
    return _rounded(openset.scale_class_probs(probs)) if scaled else probs


def _rounded(df):
    return df.withColumn("probs", F.transform("probs", lambda x: F.struct(x["class"].alias("class"), F.round(x["p"], 9).alias("p"))))


def predicted(spark, sf_dir, rule="argmax", unseen=UNSEEN):
    out = openset.open_set_predict(scored(spark, sf_dir, unseen=unseen), PERCENTILE, rule)
    return out.select("vec_id", openset.relabel_unseen("label", unseen).alias("label"), "prediction")


_U = "(0, 3)"
_PROBS = f"""dims AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
cent AS (SELECT label AS class, i, avg(x) AS m FROM dims WHERE label NOT IN {_U} GROUP BY 1, 2),
d AS (SELECT vec_id, dims.label, class, exp(-{SHARPNESS} * sum((x - m) * (x - m))) AS e FROM dims JOIN cent USING (i) GROUP BY 1, 2, 3),
raw AS (SELECT vec_id, label, class, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM d)"""
_SCALED = f"""{_PROBS}, rng AS (SELECT class, max(p) AS hi, min(p) AS lo FROM raw GROUP BY class),
probs AS (SELECT vec_id, label, class, round(p / (hi - lo), 9) AS p FROM raw JOIN rng USING (class))"""
_PRED = f"""{_SCALED}, thr AS (SELECT class, quantile_cont(p, {PERCENTILE / 100}) AS t FROM probs GROUP BY class),
kept AS (SELECT vec_id, class, p FROM probs JOIN thr USING (class) WHERE p >= t AND p > 0),
pred AS (SELECT vec_id, CASE WHEN e.label IN {_U} THEN 0 ELSE e.label END AS label,
  coalesce((SELECT class FROM kept k WHERE k.vec_id = e.vec_id ORDER BY p DESC, class DESC LIMIT 1), 0) AS prediction FROM embeddings e)"""


@query("seen_only", f"SELECT vec_id, label FROM embeddings WHERE label NOT IN {_U}")
def seen_only(spark, sf_dir):
    return openset.seen_only(embeddings(spark, sf_dir).select("vec_id", "label"), "label", UNSEEN)


@query("relabel_unseen", f"SELECT vec_id, CASE WHEN label IN {_U} THEN 0 ELSE label END AS label FROM embeddings")
def relabel_unseen(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", openset.relabel_unseen("label", UNSEEN).alias("label"))


@query("class_prob_range", f"""
WITH {_PROBS} SELECT class, round(max(p), 6) AS max_p, round(min(p), 6) AS min_p, round(max(p) - min(p), 6) AS range_p FROM raw GROUP BY class""")
def class_prob_range(spark, sf_dir):
    return openset.class_ranges(scored(spark, sf_dir, scaled=False)).select("class", *[F.round(c, 6).alias(c) for c in ("max_p", "min_p", "range_p")])


@query("scale_class_probs", f"WITH {_SCALED} SELECT vec_id, class, round(p, 6) AS p FROM probs")
def scale_class_probs(spark, sf_dir):
    return openset.long_probabilities(scored(spark, sf_dir), "probs", "vec_id").withColumn("p", F.round("p", 6))


@query("class_percentile", f"""
WITH {_SCALED} SELECT class, round(quantile_cont(p, {PERCENTILE / 100}), 6) AS threshold FROM probs GROUP BY class""")
def class_percentile(spark, sf_dir):
    return openset.class_thresholds(scored(spark, sf_dir), [PERCENTILE]).select("class", F.round("quantile", 6).alias("threshold"))


@query("open_set_max_label", f"""
WITH {_PRED} SELECT p.vec_id, p.label, coalesce((SELECT max(class) FROM kept k WHERE k.vec_id = p.vec_id), 0) AS prediction FROM pred p""")
def open_set_max_label(spark, sf_dir):
    return predicted(spark, sf_dir, "max_label")


@query("open_set_argmax", f"WITH {_PRED} SELECT vec_id, label, prediction FROM pred")
def open_set_argmax(spark, sf_dir):
    return predicted(spark, sf_dir, "argmax")


_QS = ", ".join(str(q / 100) for q in range(50, 95))
_SWEEP = f"""{_SCALED},
thr AS (SELECT class, unnest(range(50, 95))::INTEGER AS threshold, unnest(quantile_cont(p, [{_QS}])) AS t FROM probs GROUP BY class),
kept AS (SELECT threshold, vec_id, arg_max(class, p * 1000000000 * 100 + class) AS prediction FROM probs JOIN thr USING (class) WHERE p >= t AND p > 0 GROUP BY 1, 2),
every AS (SELECT h.threshold, CASE WHEN e.label IN {_U} THEN 0 ELSE e.label END AS label, coalesce(prediction, 0) AS prediction
  FROM embeddings e CROSS JOIN (SELECT DISTINCT threshold FROM thr) h LEFT JOIN kept k ON k.vec_id = e.vec_id AND k.threshold = h.threshold),
c AS (SELECT threshold, count(*) FILTER (label = 0 AND prediction = 0) AS tp, count(*) FILTER (label <> 0 AND prediction = 0) AS fp,
  count(*) FILTER (label = 0 AND prediction > 0) AS fn FROM every GROUP BY threshold),
s AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, (tp + fp) / nullif(tp + fn, 0)::DOUBLE AS ratio FROM c),
f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM s)"""


def sweep(spark, sf_dir):
    labelled = scored(spark, sf_dir).withColumn("label", openset.relabel_unseen("label", UNSEEN))
    return openset.threshold_sweep(labelled, "label")


# Settings with one, two and three classes that are never seen.
SETTINGS = ("(0)", "(0, 3)", "(0, 3, 7)")


@query("open_set_settings", " UNION ALL ".join(
    f"SELECT * FROM (WITH {_PRED.replace(_U, u)} SELECT {n} AS unseen, label, prediction, count(*) AS n FROM pred GROUP BY 2, 3)" for n, u in enumerate(SETTINGS, 1)))
def open_set_settings(spark, sf_dir):
    """Decisions by true class in each setting."""
    out = None
    for n, classes in enumerate(((0,), (0, 3), (0, 3, 7)), 1):
        part = predicted(spark, sf_dir, unseen=classes).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(n).alias("unseen"), "label", "prediction", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("threshold_sweep", f"""
WITH {_SWEEP} SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(ratio, 6) AS ratio, CASE WHEN f1 IS NOT NULL AND ratio < 1.1 THEN 1 ELSE 0 END AS eligible FROM f""")
def threshold_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ratio")})


@query("best_threshold", f"""
WITH {_SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM f WHERE f1 > 0 AND ratio < 1.1 ORDER BY f.f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return openset.best_threshold(sweep(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query("accuracy", f"WITH {_PRED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred")
def accuracy(spark, sf_dir):
    return metrics.accuracy(predicted(spark, sf_dir), "label", "prediction").withColumn("accuracy", F.round("accuracy", 6))


_REPORT = f"""{_PRED}, t AS (SELECT label AS class, count(*) AS n FROM pred GROUP BY 1), q AS (SELECT prediction AS class, count(*) AS n FROM pred GROUP BY 1),
h AS (SELECT label AS class, count(*) AS n FROM pred WHERE label = prediction GROUP BY 1),
r AS (SELECT class, coalesce(h.n / q.n::DOUBLE, 0) AS precision, coalesce(h.n / t.n::DOUBLE, 0) AS recall, coalesce(t.n, 0) AS support
  FROM t FULL JOIN q USING (class) LEFT JOIN h USING (class)),
report AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r)"""


@query("classification_report", f"""
WITH {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""")
def classification_report(spark, sf_dir):
    report = metrics.classification_report(predicted(spark, sf_dir), "label", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("report_averages", f"""
WITH {_REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM report""")
def report_averages(spark, sf_dir):
    report = metrics.classification_report(predicted(spark, sf_dir), "label", "prediction")
    out = metrics.report_averages(report)
    return out.select(*[c if c == "support" else F.round(c, 6).alias(c) for c in out.columns])


@query("macro_f1", f"WITH {_REPORT} SELECT round(avg(f1), 6) AS macro_f1 FROM report")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(predicted(spark, sf_dir), "label", "prediction").withColumn("macro_f1", F.round("macro_f1", 6))


@query("confusion_matrix", f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predicted(spark, sf_dir), "label", "prediction")


@query("log_loss", f"""
WITH {_PROBS} SELECT round(-avg(ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM raw WHERE label = class""")
def log_loss(spark, sf_dir):
    seen = openset.seen_only(scored(spark, sf_dir, scaled=False), "label", UNSEEN)
    own = openset.long_probabilities(seen, "probs", "label").filter("label = class")
    return metrics.log_loss(own, F.col("p")).withColumn("log_loss", F.round("log_loss", 6))


@query("unseen_f1", f"""
WITH {_PRED}, c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tp, count(*) FILTER (label <> 0 AND prediction = 0) AS fp,
  count(*) FILTER (label = 0 AND prediction > 0) AS fn FROM pred)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
  round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 6) AS f1 FROM c""")
def unseen_f1(spark, sf_dir):
    out = metrics.unseen_f1(predicted(spark, sf_dir), "label", "prediction")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("unseen_accuracy", f"""
WITH {_PRED} SELECT count(*) AS n_unseen, round(avg(CASE WHEN prediction = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred WHERE label = 0""")
def unseen_accuracy(spark, sf_dir):
    return metrics.unseen_accuracy(predicted(spark, sf_dir), "label", "prediction").withColumn("accuracy", F.round("accuracy", 6))


@query("cluster_composition", f"WITH {_PRED} SELECT prediction AS cluster, label, count(*) AS n FROM pred GROUP BY 1, 2")
def cluster_composition(spark, sf_dir):
    return agg.composition(predicted(spark, sf_dir).withColumnRenamed("prediction", "cluster"), "cluster", "label")


_AGREE = f"""{_PRED}, nij AS (SELECT count(*)::DOUBLE AS n FROM pred GROUP BY label, prediction), a AS (SELECT count(*)::DOUBLE AS n FROM pred GROUP BY label),
b AS (SELECT count(*)::DOUBLE AS n FROM pred GROUP BY prediction), z AS (SELECT count(*)::DOUBLE AS n FROM pred),
e AS (SELECT (SELECT -sum(a.n / z.n * ln(a.n / z.n)) FROM a, z) AS hl, (SELECT -sum(b.n / z.n * ln(b.n / z.n)) FROM b, z) AS hc,
  (SELECT -sum(nij.n / z.n * ln(nij.n / z.n)) FROM nij, z) AS hb,
  (SELECT sum(n * (n - 1) / 2) FROM nij) AS p, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
  (SELECT n * (n - 1) / 2 FROM z) AS pz)"""


@query("v_measure", f"""
WITH {_AGREE}, v AS (SELECT (hl + hc - hb) / hl AS h, (hl + hc - hb) / hc AS c FROM e)
SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM v""")
def v_measure(spark, sf_dir):
    return agreement(spark, sf_dir, "homogeneity", "completeness", "v_measure")


def agreement(spark, sf_dir, *columns):
    out = metrics.cluster_agreement(predicted(spark, sf_dir), "label", "prediction")
    return out.select(*[F.round(c, 6).alias(c) for c in columns])


@query("adjusted_rand", f"WITH {_AGREE} SELECT round((p - pa * pb / pz) / ((pa + pb) / 2 - pa * pb / pz), 6) AS adjusted_rand FROM e")
def adjusted_rand(spark, sf_dir):
    return agreement(spark, sf_dir, "adjusted_rand")


@query("fowlkes_mallows", f"WITH {_AGREE} SELECT round(p / sqrt(pa * pb), 6) AS fowlkes_mallows FROM e")
def fowlkes_mallows(spark, sf_dir):
    return agreement(spark, sf_dir, "fowlkes_mallows")
