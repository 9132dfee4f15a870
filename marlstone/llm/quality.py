"""Quality: a document classifier combined with the posteriors of its host and path (hierarchical empirical Bayes)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, quoted, text_hash
from marlstone.session import write_cut

# Labelled rows the classifier is fitted on, at most; larger label tables are sampled by the hash of the id.
MAX_FIT_ROWS = 50_000
CLOSE = 1e-4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ"
_MARKS = "!#$%&*|<>{}[]=\\/~^_+@"


def _share(text: Column, characters: str, size: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))) / size


def features(text: Column) -> list[Column]:
    """Numbers between 0 and about 1 that describe the form of a text, as native expressions; zeros for no text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, r"\s+")
    n = F.greatest(F.size(words), F.lit(1))
    return [
        _share(text, _UPPER, size), _share(text, _MARKS, size), _share(text, "0123456789", size), _share(text, ".,;:", size) * 5,
        _share(text, "|", size) * 5, _share(text, "!", size) * 5,
        F.size(F.array_distinct(words)) / n, F.least(F.log1p(n.cast("double")) / 8, F.lit(1.5)),
        F.least(n / size * 3, F.lit(3.0)), F.least(_share(text, "\n", size) * 20, F.lit(3.0)),
    ]


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _inside(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLOSE)), F.lit(1 - CLOSE))


def fit_weights(labelled: DataFrame, label: str) -> list[float]:
    """Intercept and weights of a logistic regression on the column ``x``, or a constant where a class is missing."""
    counts = labelled.agg(F.sum(F.col(label).cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).first()
    good, n = counts["good"] or 0, counts["n"]
    if good in (0, n):
        return [0.0 if not n else 10.0 if good else -10.0]
    fitted = LogisticRegression(featuresCol="v", labelCol=label, regParam=1e-4, maxIter=100, aggregationDepth=2).fit(
        labelled.select(array_to_vector("x").alias("v"), F.col(label).cast("double").alias(label)))
    return [fitted.intercept, *fitted.coefficients.toArray().tolist()]


def _strength(mean: Column, variance: Column) -> Column:
    """Pseudo-rows of a Beta prior with this mean and variance between groups, within reason."""
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(variance, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0))


def _posteriors(scored: DataFrame) -> tuple[DataFrame, Column]:
    """Sums of the classifier's probabilities by path and host, with the prior each group shrinks to.

    Moments of the group means, weighted by rows and less what single rows would scatter by themselves,
    give the strength of the priors: hosts shrink to the mean of all documents, paths to their host.
    """
    paths = write_cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")),
                      "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hss").alias("ss"), F.count(F.lit(1)).alias("k"),
                      F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("between"))
    mean = _inside(F.col("s") / F.col("n"))
    noise = F.col("ss") / F.col("n") - mean * mean
    world = total.select(F.struct(mean.alias("mean"), _strength(mean, F.greatest(
        F.col("between") / F.col("n") - mean * mean - noise * F.col("k") / F.col("n"), F.lit(0.0))).alias("strength")).alias("v")).scalar()
    with_host = (paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
                 .select("p.host", "p.path", "p.n", "p.s", "h.hn", "h.hs"))
    within = with_host.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"),
                           F.sum(F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), F.lit(2)) * F.col("n")).alias("d"))
    m = _inside(F.col("s") / F.col("n"))
    path_strength = within.select(_strength(m, F.greatest(F.col("d") / F.col("n") - m * (1 - m) * F.col("k") / F.col("n") * 0.1, F.lit(0.0)))).scalar()
    return with_host.select("host", "path", "n", "s", "hn", "hs", path_strength.alias("path_strength")), world


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
                  path: Column | None = None, label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row per document: doc, th (text hash), p_document, p_host, p_path, p_quality, accepted.

    The logistic regression over ``features`` is fitted on the labelled rows, ``max_fit_rows`` at most.
    Its probabilities, summed by host and path over all documents, give posterior means: a host with few
    rows stays near the mean of the corpus, a path with few near its host.  A document's own probability
    is left out of its groups.  The logit of ``p_quality`` is that of the document plus what its path
    is above or below the corpus mean.  0.5 or more is accepted.

    ``host`` defaults to the column ``source``, ``path`` to ``lang``.  Null hosts are one host, null paths
    one path.  A null or empty text says nothing: its own probability is the corpus mean.  Labels that are
    null or of unknown documents are not used; without labels of both classes the classifier is constant
    (0.5 without any, else near the only class); without documents there are no rows.
    """
    host = quoted("source") if host is None else host
    path = quoted("lang") if path is None else path
    text = quoted(text_col)
    rows = write_cut(docs.select(quoted(id_col).alias("doc"), text_hash(text).alias("th"), host.alias("host"), path.alias("path"),
                                 (F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank"), F.array(*features(text)).alias("x")), "quality-features")
    known = labels.select(quoted(id_col).alias("doc"), quoted(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    total = known.count()
    if total > max_fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int((1 << 20) * max_fit_rows / total))
    weights = fit_weights(rows.where(~F.col("blank")).join(known, "doc").select("x", "label"), "label")
    z = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        z = z + F.lit(w) * F.col("x")[i]
    scored = rows.select("doc", "th", "host", "path", F.when(~F.col("blank"), _inside(1 / (1 + F.exp(-z)))).alias("own"))
    mean = scored.agg(F.coalesce(F.avg("own"), F.lit(0.5))).scalar()
    scored = scored.withColumn("p", F.coalesce("own", mean))
    groups, world = _posteriors(scored)
    joined = scored.alias("d").join(groups.alias("g"), F.col("d.host").eqNullSafe(F.col("g.host")) & F.col("d.path").eqNullSafe(F.col("g.path")))
    joined = joined.select("d.doc", "d.th", "d.p", "g.n", "g.s", "g.hn", "g.hs", "g.path_strength", world.alias("world"))
    joined = joined.withColumn("p_host", (F.col("world.mean") * F.col("world.strength") + F.col("hs") - F.col("p")) / (F.col("world.strength") + F.col("hn") - 1))
    joined = joined.withColumn("p_path", _inside((F.col("p_host") * F.col("path_strength") + F.col("s") - F.col("p")) / (F.col("path_strength") + F.col("n") - 1)))
    combined = _logit(F.col("p")) + _logit(F.col("p_path")) - _logit(F.col("world.mean"))
    return (joined.withColumn("p_quality", 1 / (1 + F.exp(-combined)))
            .select("doc", "th", F.col("p").alias("p_document"), "p_host", "p_path", "p_quality", (F.col("p_quality") >= 0.5).alias("accepted")))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    doc, th = free_name(docs, "rejected"), free_name(docs, "rejected_text")
    rejected = (score_quality(docs, labels, id_col, text_col, **options).where(~F.col("accepted"))
                .select(F.col("doc").alias(doc), F.col("th").alias(th)).distinct())
    return docs.join(rejected, quoted(id_col).eqNullSafe(F.col(doc)) & (text_hash(quoted(text_col)) == F.col(th)), "left_anti")
