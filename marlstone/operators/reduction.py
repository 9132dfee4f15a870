"""Principal components and latent semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.vectors import l2_normalize
from .matrix import moments, project


@dataclass
class Reduction:
    """A fitted linear map; ``transform`` applies it to any table."""

    basis: np.ndarray
    explained: np.ndarray
    centre: np.ndarray | None
    normalise: bool

    def transform(self, df: DataFrame, vec: str, name: str = "reduced") -> DataFrame:
        out = project(df, vec, self.basis, name, self.centre)
        return out.withColumn(name, l2_normalize(name)) if self.normalise else out


def _fixed_signs(basis: np.ndarray) -> np.ndarray:
    """The largest component of each direction is positive."""
    top = np.abs(basis).argmax(axis=0)
    return basis * np.sign(basis[top, np.arange(basis.shape[1])])


def fit_pca(df: DataFrame, vec: str, size: int, k: int = 20) -> Reduction:
    """Directions of largest variance about the mean; explained variance ratios."""
    n, total, cross = moments(df, vec, size)
    mean = total / n
    values, vectors = np.linalg.eigh((cross - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1][:k]
    return Reduction(_fixed_signs(vectors[:, order]), values[order] / values.sum(), mean, False)


def fit_lsa(df: DataFrame, vec: str, size: int, k: int = 20) -> Reduction:
    """Truncated singular vectors without centring; rows come out with length 1.

    Fit on the training rows and use the same map for every other set.
    """
    n, total, cross = moments(df, vec, size)
    values, vectors = np.linalg.eigh(cross)
    basis = _fixed_signs(vectors[:, np.argsort(values)[::-1][:k]])
    covariance = cross / n - np.outer(total / n, total / n)
    kept = np.einsum("ij,ik,kj->j", basis, covariance, basis)
    return Reduction(basis, kept / np.trace(covariance), None, True)
