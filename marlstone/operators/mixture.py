"""Gaussian and Dirichlet-process mixtures by distributed EM.

Every round is one Spark job: tasks compute the responsibilities of their rows
with NumPy and return weighted sums per component (counts, sums, cross
products); the totals, k (1 + d + d d) numbers, are added by a grouping and the
small parameter update runs on the driver.  Rows are cached once and never
collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import map_rows, moments, partition_sums
from .sampling import hash_share

COVARIANCES = ("spherical", "tied", "diag", "full")


def _log_density(x: np.ndarray, means: np.ndarray, chols: np.ndarray) -> np.ndarray:
    """Log normal density of each row under each component (precision factors)."""
    d = x.shape[1]
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, chols)):
        z = (x - m) @ c
        out[:, j] = np.log(np.diag(c)).sum() - 0.5 * (d * math.log(2 * math.pi) + (z * z).sum(axis=1))
    return out


def _responsibilities(log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = log_w.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log_w - top).sum(axis=1))
    return np.exp(log_w - total[:, None]), total


def _factor(cov: np.ndarray) -> np.ndarray:
    """Upper factor C of the precision: C C' is the inverse covariance."""
    lower = np.linalg.cholesky(cov)
    return np.linalg.solve(lower, np.eye(len(cov))).T


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


@dataclass
class Mixture:
    """Fitted mixture: ``log_weights`` and component densities score any row."""

    covariance: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray            # k full matrices, whatever the type
    log_offset: np.ndarray             # added to the log density of each component
    n: int
    log_likelihood: float
    rounds: int
    converged: bool
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.means)

    def parameters(self) -> int:
        k, d = self.means.shape
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.covariance]
        return cov + k * d + k - 1

    def bic(self) -> float:
        return -2 * self.log_likelihood + self.parameters() * math.log(self.n)

    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.parameters()

    def posteriors(self, df: DataFrame, vec: str, name: str = "probability") -> DataFrame:
        """Adds the component probabilities of every row as an array."""
        means, offset = self.means, self.log_offset
        chols = np.stack([_factor(c) for c in self.covariances])

        return map_rows(df, vec, name, lambda x: _responsibilities(_log_density(x, means, chols) + offset)[0])

    def predict(self, df: DataFrame, vec: str, name: str = "cluster") -> DataFrame:
        """Adds the most probable component."""
        scored = self.posteriors(df, vec, "_p")
        return scored.withColumn(name, (F.array_position("_p", F.array_max("_p")) - 1).cast("int")).drop("_p")


def _statistics(df: DataFrame, vec: str, k: int, d: int, extra: list[str], responsibilities) -> tuple:
    """(counts, sums, cross products, log-likelihood) of one pass."""
    def fn(x: np.ndarray, *start: np.ndarray) -> np.ndarray:
        resp, total = responsibilities(x, *start)
        cross = np.einsum("nk,ni,nj->kij", resp, x, x, optimize=True)
        return np.concatenate((resp.sum(axis=0), (resp.T @ x).ravel(), cross.ravel(), [total.sum()]))

    flat = partition_sums(df, vec, extra, fn)
    counts = flat[:k]
    sums = flat[k:k + k * d].reshape(k, d)
    cross = flat[k + k * d:-1].reshape(k, d, d)
    return counts, sums, cross, float(flat[-1])


def _shaped(scatter: np.ndarray, counts: np.ndarray, covariance: str, reg: float) -> np.ndarray:
    """Per-component covariances of the wanted type from per-component scatter."""
    k, d, _ = scatter.shape
    if covariance == "tied":
        return np.repeat((scatter.sum(axis=0) / counts.sum() + reg * np.eye(d))[None], k, axis=0)
    cov = scatter / counts[:, None, None]
    if covariance == "diag":
        cov = np.stack([np.diag(np.diag(c)) for c in cov])
    elif covariance == "spherical":
        cov = np.stack([np.eye(d) * np.diag(c).mean() for c in cov])
    return cov + reg * np.eye(d)


def _random_start(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Hash-drawn responsibilities, the same for a row wherever it is read."""
    draws = F.array(*[hash_share(key, seed * 1000 + j) + 1e-3 for j in range(k)])
    return df.withColumn("_start", draws)


def _kmeans_start(df: DataFrame, vec: str, k: int, seed: int) -> DataFrame:
    """One-hot responsibilities of a k-means clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_features", array_to_vector(vec))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_c").fit(rows)
    hot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("_c")).cast("double"))
    return model.transform(rows).withColumn("_start", hot).drop("_features", "_c")


def _started(x: np.ndarray, start: np.ndarray):
    return start / start.sum(axis=1, keepdims=True), np.zeros(len(x))


def _run(df: DataFrame, vec: str, key: str, d: int, k: int, start: str, seed: int, update, max_iter: int, tol: float):
    """EM rounds until the mean log-likelihood moves less than ``tol``."""
    begun = _kmeans_start(df, vec, k, seed) if start == "kmeans" else _random_start(df, key, k, seed)
    begun = begun.select(vec, "_start").persist()
    try:
        stats = _statistics(begun, vec, k, d, ["_start"], _started)
        history: list[float] = []
        state = update(*stats[:3])
        converged = False
        for _ in range(max_iter):
            means, chols, offset = state["means"], np.stack([_factor(c) for c in state["covariances"]]), state["log_offset"]

            def scored(x, means=means, chols=chols, offset=offset):
                return _responsibilities(_log_density(x, means, chols) + offset)

            counts, sums, cross, total = _statistics(begun, vec, k, d, [], scored)
            history.append(total)
            n = counts.sum()
            if len(history) > 1 and abs(history[-1] - history[-2]) / n < tol:
                converged = True
                break
            state = update(counts, sums, cross)
        return state, int(round(n)), history, converged
    finally:
        begun.unpersist()


def fit_gaussian(df: DataFrame, vec: str, key: str, size: int, k: int, covariance: str = "full", reg: float = 1e-3,
                 max_iter: int = 1350, tol: float = 1e-3, seed: int = 0, start: str = "kmeans") -> Mixture:
    """Maximum-likelihood mixture in one of four covariance types."""
    if covariance not in COVARIANCES:
        raise ValueError(f"unknown covariance type {covariance}")

    def update(counts, sums, cross):
        counts = counts + 10 * np.finfo(float).eps
        means = sums / counts[:, None]
        scatter = cross - np.einsum("k,ki,kj->kij", counts, means, means)
        weights = counts / counts.sum()
        return {"means": means, "covariances": _shaped(scatter, counts, covariance, reg), "weights": weights, "log_offset": np.log(weights)}

    state, n, history, converged = _run(df, vec, key, size, k, start, seed, update, max_iter, tol)
    return Mixture(covariance, state["weights"], state["means"], state["covariances"], state["log_offset"], n, history[-1],
                   len(history), converged, history)


def fit_dirichlet(df: DataFrame, vec: str, key: str, size: int, k: int, covariance: str = "full", reg: float = 1e-6,
                  max_iter: int = 1500, tol: float = 1e-3, seed: int = 0, start: str = "random",
                  mean_precision: float = 0.8, concentration: float | None = None) -> Mixture:
    """Truncated stick-breaking mixture by variational EM (Blei and Jordan 2006).

    Normal-Wishart priors: prior mean and covariance are the data's, degrees of
    freedom d, concentration 1/k unless given.  Components without support
    shrink to weights near zero.
    """
    if covariance not in COVARIANCES:
        raise ValueError(f"unknown covariance type {covariance}")
    n_rows, total, second = moments(df, vec, size)
    prior_mean = total / n_rows
    data_cov = (second - n_rows * np.outer(prior_mean, prior_mean)) / max(n_rows - 1, 1)
    gamma = 1.0 / k if concentration is None else concentration
    d = size
    prior_cov = _shaped(data_cov[None], np.ones(1), covariance, 0.0)[0]

    def update(counts, sums, cross):
        counts = counts + 10 * np.finfo(float).eps
        mean_prec = mean_precision + counts
        means = (mean_precision * prior_mean + sums) / mean_prec[:, None]
        xbar = sums / counts[:, None]
        gap = xbar - prior_mean
        scatter = cross - np.einsum("k,ki,kj->kij", counts, xbar, xbar)
        shift = np.einsum("k,ki,kj->kij", counts * mean_precision / mean_prec, gap, gap)
        if covariance == "tied":
            freedom = np.full(k, d + counts.sum() / k)
            cov = np.repeat(((prior_cov + (scatter.sum(axis=0) / k) + shift.sum(axis=0) / k) / freedom[0])[None], k, axis=0)
        else:
            freedom = d + counts
            cov = _shaped((prior_cov[None] + scatter + shift), freedom, covariance, 0.0)
        cov = cov + reg * np.eye(d)
        # Expected log stick lengths.
        a = 1 + counts
        b = gamma + np.append(np.cumsum(counts[::-1])[-2::-1], 0.0)
        both = np.array([digamma(x + y) for x, y in zip(a, b)])
        log_stick = np.array([digamma(x) for x in a]) - both
        log_rest = np.array([digamma(y) for y in b]) - both
        log_weights = log_stick + np.append(0.0, np.cumsum(log_rest)[:-1])
        # The Wishart expectation turns the plug-in density into the expected one.
        log_lambda = np.array([d * math.log(2) + sum(digamma(0.5 * (v - i)) for i in range(d)) for v in freedom])
        offset = log_weights + 0.5 * (log_lambda - d * np.log(freedom) - d / mean_prec)
        stick = a / (a + b)
        weights = stick * np.append(1.0, np.cumprod(1 - stick)[:-1])
        return {"means": means, "covariances": cov, "weights": weights / weights.sum(), "log_offset": offset}

    state, n, history, converged = _run(df, vec, key, size, k, start, seed, update, max_iter, tol)
    return Mixture(covariance, state["weights"], state["means"], state["covariances"], state["log_offset"], n, history[-1],
                   len(history), converged, history)


def select_gaussian(df: DataFrame, vec: str, key: str, size: int, k: int, **options) -> tuple[Mixture, dict[str, Mixture]]:
    """All four covariance types; the one with the lowest BIC first."""
    fits = {c: fit_gaussian(df, vec, key, size, k, c, **options) for c in COVARIANCES}
    return min(fits.values(), key=Mixture.bic), fits


def majority_labels(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """The most common label of each component (ties: the smaller label)."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(cluster).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias("class"))


def class_probabilities(posteriors: DataFrame, key: str, label: str, mapping: DataFrame, name: str = "probability") -> DataFrame:
    """Component posteriors as class probabilities (components of one class add up)."""
    table = mapping.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "class"))).alias("m")).scalar()
    rows = posteriors.select(key, label, F.posexplode(name).alias("cluster", "p")).withColumn("class", F.try_element_at(table, F.col("cluster")))
    sums = rows.groupBy(key, label, "class").agg(F.sum("p").alias("p"))
    return sums.filter("class IS NOT NULL").groupBy(key, label).agg(F.array_sort(F.collect_list(F.struct("class", "p"))).alias("probs"))
