"""Least squares with cluster-robust errors from one pass of sums.

Everything a fit needs is a sum of products: per cluster first (combined on the
map side, so one huge event costs no more than a small one), then over
clusters.  The score of a cluster is X'y - X'X b of its own sums, so residuals
never need a second scan of the rows.  The solves are p by p, one per subgroup.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import student_t_two_sided

# Wholesale share of the full price and cost of one free parcel.
WHOLESALE_SHARE = 0.45
SHIPPING_COST = 6.50


def profit(amount, discount, free_shipping) -> Column:
    a, d, s = (F.col(c) if isinstance(c, str) else c for c in (amount, discount, free_shipping))
    return a - WHOLESALE_SHARE * (a + d) - s * SHIPPING_COST


def consultant(event_id) -> Column:
    """The first two characters of an event id."""
    return F.substring(event_id, 1, 2)


def _moments(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key: X'X (row by row), X'y, y'y, sum of y and n, with a constant first."""
    design = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    p = len(design)
    out = F.col(y).cast("double")
    sums = [F.sum(design[i] * design[j]).alias(f"a_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(design[i] * out).alias(f"b_{i}") for i in range(p)]
    sums += [F.sum(out * out).alias("yy"), F.sum(out).alias("ys"), F.count(F.lit(1)).alias("n")]
    return df.dropna(subset=[y, *xs]).groupBy(*keys).agg(*sums)


def _sum_names(p: int) -> list[str]:
    return [f"a_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"b_{i}" for i in range(p)] + ["yy", "ys", "n"]


def _xtx(p: int) -> Column:
    return F.array(*[F.col(f"a_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])


def _fit_udf(p: int):
    def fit(xtx: pd.Series, xty: pd.Series) -> pd.DataFrame:
        beta, inverse = [], []
        for a, b in zip(xtx, xty):
            inv = np.linalg.pinv(np.asarray(a, dtype=float).reshape(p, p), hermitian=True)
            inverse.append(inv.ravel().tolist())
            beta.append((inv @ np.asarray(b, dtype=float)).tolist())
        return pd.DataFrame({"beta": beta, "inverse": inverse})

    return F.pandas_udf(fit, "beta array<double>, inverse array<double>")


def _test_udf(p: int):
    def test(beta: pd.Series, inverse: pd.Series, middle: pd.Series, scale: pd.Series) -> pd.Series:
        rows = []
        for b, inv, mid, s in zip(beta, inverse, middle, scale):
            a = np.asarray(inv, dtype=float).reshape(p, p)
            cov = s * (a if mid is None else a @ np.asarray(mid, dtype=float).reshape(p, p) @ a)
            se = np.sqrt(np.maximum(np.diag(cov), 0.0))
            t = [x / e if e > 0 else float("nan") for x, e in zip(b, se)]
            rows.append([[x, float(e), u] for x, e, u in zip(b, se, t)])
        return pd.Series(rows)

    return F.pandas_udf(test, "array<array<double>>")


def _fits(df: DataFrame, y: str, xs: Sequence[str], keys: list[str], cluster: str | None):
    p = len(xs) + 1
    per_cluster = _moments(df, y, xs, [*keys, cluster] if cluster else keys)
    totals = per_cluster.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _sum_names(p)], F.count(F.lit(1)).alias("m"))
    fit = _fit_udf(p)(_xtx(p), F.array(*[F.col(f"b_{i}") for i in range(p)]))
    fitted = totals.withColumn("_f", fit)
    # Residual sum of squares: y'y - b'X'y.
    ssr = F.col("yy") - sum((F.col("_f.beta")[i] * F.col(f"b_{i}") for i in range(p)), F.lit(0.0))
    return p, per_cluster, fitted.select(*keys, "_f.beta", "_f.inverse", "n", "m", ssr.alias("ssr"),
                                         (F.col("yy") - F.col("ys") * F.col("ys") / F.col("n")).alias("sst"))


def _keys(df: DataFrame, by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(1)), ["_all"])


def ols(df: DataFrame, y: str, xs: Sequence[str], cluster: str | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """One row per coefficient (and subgroup): estimate, std_error, t_value, p_value, n.

    With ``cluster`` the covariance is A (sum of score outer products) A times
    M/(M-1) (N-1)/(N-K); otherwise residual variance times A.  Degrees of
    freedom are N-K.
    """
    df, keys = _keys(df, by)
    p, per_cluster, fitted = _fits(df, y, xs, keys, cluster)
    n, dof = F.col("n"), F.col("n") - p
    if cluster:
        scores = per_cluster.join(fitted.select(*keys, "beta"), keys)
        score = [F.col(f"b_{i}") - sum((F.col(f"a_{min(i, j)}_{max(i, j)}") * F.col("beta")[j] for j in range(p)), F.lit(0.0))
                 for i in range(p)]
        scores = scores.select(*keys, *[score[i].alias(f"s_{i}") for i in range(p)])
        middle = scores.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")) for i in range(p) for j in range(p)]).alias("middle"))
        scale = F.try_divide("m", F.col("m") - 1) * F.try_divide(n - 1, dof)
        ready = fitted.join(middle, keys).withColumn("scale", scale)
    else:
        ready = fitted.withColumn("middle", F.lit(None).cast("array<double>")).withColumn("scale", F.try_divide("ssr", dof))
    tested = ready.select(*keys, "n", _test_udf(p)("beta", "inverse", "middle", F.col("scale").cast("double")).alias("_r"))
    names = F.array(*[F.lit(t) for t in ("intercept", *xs)])
    rows = tested.select(*keys, "n", F.posexplode("_r").alias("_i", "v"))
    out = rows.select(*[k for k in keys if k != "_all"], F.get(names, F.col("_i")).alias("term"), "n",
                      *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("estimate", "std_error", "t_value"))])
    return out.withColumn("p_value", student_t_two_sided("t_value", F.col("n") - p))


def regression_table(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """n, R squared and adjusted R squared per subgroup."""
    df, keys = _keys(df, by)
    p, _, fitted = _fits(df, y, xs, keys, None)
    r2 = 1 - F.try_divide("ssr", "sst")
    return fitted.select(*[k for k in keys if k != "_all"], "n", r2.alias("r2"),
                         (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - p)).alias("adj_r2"))


def interaction_design(df: DataFrame, treatment: str, large: str, group: str, level: str) -> tuple[DataFrame, list[str]]:
    """Treatment, event size, a group dummy and both interactions with treatment."""
    out = df.withColumns({"treat": F.col(treatment).cast("double"), "large": F.col(large).cast("double"),
                          "group": F.when(F.col(group) == level, 1.0).otherwise(0.0)})
    out = out.withColumns({"large_treat": F.col("large") * F.col("treat"), "group_treat": F.col("group") * F.col("treat")})
    return out, ["treat", "large", "group", "large_treat", "group_treat"]
