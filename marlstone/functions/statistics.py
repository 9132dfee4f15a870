"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Published coefficients of the Lanczos approximation (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x) -> Column:
    """Logarithm of the gamma function for x of 0.5 and more."""
    z = _col(x) - 1
    series = sum((F.lit(c) / (z + k) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(z + 7.5) - (z + 7.5) + F.log(series)


def _continued_fraction(x: Column, a: Column, b: Column) -> Column:
    """Of the incomplete beta function, by the modified Lentz method; terms in proportion to the root of the larger parameter are enough."""
    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def times(s: Column, factor: Column) -> Column:
        return F.transform(F.array(F.struct((1 / safe(1 + factor * s["d"])).alias("d"), safe(1 + factor / s["c"]).alias("c"), s["h"].alias("h"))),
                           lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["h"] * n["c"] * n["d"]).alias("h")))[0]

    def term(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.transform(F.array(times(s, even)), lambda n: times(n, odd))[0]

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    terms = F.sequence(F.lit(1), (100 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(terms, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), lambda s, m: term(s, m.cast("double")), lambda s: s["h"])


def student_t_two_sided(t, dof) -> Column:
    """P(|T| > |t|) with ``dof`` degrees of freedom; NaN where either is not a number or there are none."""
    def tail(s: Column) -> Column:
        front = F.exp(log_gamma(s["a"] + s["b"]) - log_gamma(s["a"]) - log_gamma(s["b"]) + s["a"] * F.log(s["x"]) + s["b"] * F.log1p(-s["x"])) / s["a"]
        value = F.when(s["x"] <= 0, 0.0).otherwise(front * _continued_fraction(s["x"], s["a"], s["b"]))
        return F.when(s["flip"], 1 - value).otherwise(value)

    def prepared(s: Column) -> Column:
        x, a = s["dof"] / (s["dof"] + s["t"] * s["t"]), s["dof"] / 2
        flip = x > (a + 1) / (a + 2.5)
        return F.struct(flip.alias("flip"), F.when(flip, s["t"] * s["t"] / (s["dof"] + s["t"] * s["t"])).otherwise(x).alias("x"),
                        F.when(flip, 0.5).otherwise(a).alias("a"), F.when(flip, a).otherwise(0.5).alias("b"))

    t, dof = _col(t).cast("double"), _col(dof).cast("double")
    # Each step is handed on as a lambda's argument, or it would be worked out again wherever it is used.
    given = F.transform(F.array(F.struct(t.alias("t"), dof.alias("dof"))), prepared)
    valid = ~F.isnan(t) & (F.abs(t) < float("inf")) & (dof > 0)
    return F.when(valid, F.transform(given, tail)[0]).otherwise(float("nan"))
