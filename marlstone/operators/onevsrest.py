"""One-vs-rest linear models, all classes fitted in the same scans.

A round is one pass over the rows that sums loss, gradient and curvature of
every class; the driver turns the sums into Newton steps.  What it and each
task hold is classes x d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_cut
from .matrix import map_rows, partition_sums

LOSSES = ("logistic", "squared_hinge")
# Share of the promised decrease that a step must bring, else it is halved.
DECREASE = 1e-4


def _loss(name: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its slope and its curvature at the margins (true class: positive)."""
    if name == "logistic":
        wrong = 0.5 * (1 - np.tanh(margin / 2))
        return np.logaddexp(0, -margin), -wrong, wrong * (1 - wrong)
    short = np.maximum(0, 1 - margin)
    return short ** 2, -2 * short, 2.0 * (short > 0)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, tolerance: float,
           max_rounds: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Several independent convex problems, a row of ``w`` each, all moved on by one call of ``sums`` a round.

    ``sums`` gives values, gradients and curvatures.  A problem ends when its gradient is at most
    ``tolerance`` of that at the start, or when no step lowers its value any more.  Returns the last ``w``,
    the gradients' norms as a share of those at the start, and the number of calls.
    """
    w = w.copy()
    value, gradient, bends = sums(w)
    start = np.maximum(np.linalg.norm(gradient, axis=1), np.finfo(float).tiny)
    step, length, rounds = np.zeros_like(w), np.zeros(len(w)), 1
    going = np.linalg.norm(gradient, axis=1) > tolerance * start
    while going.any() and rounds < max_rounds:
        for j in np.flatnonzero(going & (length == 0)):
            step[j], length[j] = -np.linalg.lstsq(bends[j], gradient[j], rcond=None)[0], 1.0
        tried = w + step * (going * length)[:, None]
        new_value, new_gradient, new_bends = sums(tried)
        rounds += 1
        promised = DECREASE * length * (gradient * step).sum(axis=1)
        # Near the end the values no longer differ in their last digits; there the gradient tells.
        level = (new_value <= value + 1e-12 * np.abs(value)) & (np.linalg.norm(new_gradient, axis=1) < np.linalg.norm(gradient, axis=1))
        lower = (new_value <= value + promised) | level
        for j in np.flatnonzero(going):
            if lower[j]:
                w[j], value[j], gradient[j], bends[j], length[j] = tried[j], new_value[j], new_gradient[j], new_bends[j], 0.0
            else:
                length[j] /= 2
        going &= (np.linalg.norm(gradient, axis=1) > tolerance * start) & ((length == 0) | (length > 1e-10))
    return w, np.linalg.norm(gradient, axis=1) / start, rounds


@dataclass
class OneVsRestLinear:
    """``weights`` has a row per class, the intercept last.

    ``gradient`` is the norm of each class's gradient where the fit ended, as a
    share of the norm at zero weights; ``n`` and ``positives`` count the rows.
    """

    classes: list[int]
    weights: np.ndarray
    gradient: np.ndarray
    n: int
    positives: np.ndarray
    rounds: int

    def scores(self, df: DataFrame, keep: Sequence[str], vec: str = "vec", name: str = "scores") -> DataFrame:
        """``keep`` and ``array<struct<class, score>>`` with each class's margin."""
        slopes, shift = self.weights[:, :-1].T, self.weights[:, -1]
        classes = F.array(*[F.lit(c) for c in self.classes])
        return map_rows(df, vec, "_margins", lambda x: x @ slopes + shift).select(*keep, F.transform(
            "_margins", lambda x, i: F.struct(F.element_at(classes, i + 1).alias("class"), x.alias("score"))).alias(name))


def fit_one_vs_rest(df: DataFrame, classes: Sequence[int], loss: str = "logistic", c: float = 1.0, vec: str = "vec", label: str = "label",
                    tolerance: float = 1e-8, max_rounds: int = 100) -> OneVsRestLinear:
    """Minimises ``|w|^2 / 2 + c * sum(loss)`` of each class against the rest, the intercept free.

    Ends when the gradient of every class is at most ``tolerance`` of that at zero weights, or no step
    lowers its objective any more; after ``max_rounds`` passes the model says by its ``gradient`` how far it
    came.  Rows without a label, or whose vector is null or holds null or non-finite numbers, are left out.  A class without rows is one the others are never
    in; without any rows all weights are zero.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss}")
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.array(F.col(label).cast("double")).alias("y"))
    rows = write_cut(rows.where(F.col("y")[0].isNotNull() & F.forall("x", lambda v: F.abs(v) < float("inf"))), "one-vs-rest")
    first = rows.select(F.size("x").alias("d")).first()
    names, k = np.array(classes, float), len(classes)
    d = first["d"] + 1 if first else 1
    if first is None:
        return OneVsRestLinear(list(classes), np.zeros((k, d)), np.zeros(k), 0, np.zeros(k, int), 0)

    def passed(w: np.ndarray) -> tuple[np.ndarray, ...]:
        def fn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.column_stack([x, np.ones(len(x))])
            sign = np.where(y == names, 1.0, -1.0)
            value, slope, bend = _loss(loss, sign * (x @ w.T))
            bends = [(x * bend[:, [j]]).T @ x for j in range(k)]
            return np.concatenate([[len(x)], (sign > 0).sum(axis=0), value.sum(axis=0), ((slope * sign).T @ x).ravel(), np.ravel(bends)])

        flat = partition_sums(rows, "x", ["y"], fn)
        n, positives, value, gradient, bends = np.split(flat, np.cumsum([1, k, k, k * d]))
        slopes = np.ones(d)
        slopes[-1] = 0
        return (int(n[0]), positives.astype(int), c * value + 0.5 * (w ** 2 * slopes).sum(axis=1),
                c * gradient.reshape(k, d) + w * slopes, c * bends.reshape(k, d, d) + np.diag(slopes))

    w, gradient, rounds = newton(lambda w: passed(w)[2:], np.zeros((k, d)), tolerance, max_rounds)
    n, positives = passed(w)[:2]
    return OneVsRestLinear(list(classes), w, gradient, n, positives, rounds + 1)
