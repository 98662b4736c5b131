"""Inference on paired outcomes, as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
ALPHA = 0.05


def mcnemar_exact(n01: Column, n10: Column) -> Column:
    """The exact two-sided p of discordant counts: twice the lower binomial tail at one half, 1 at most, and 1 without any.

    Coefficients are carried as logarithms, so no count over- or underflows on the way.
    """
    n, k = (n01 + n10).cast("double"), F.least(n01, n10).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lc"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        lc = acc["lc"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(lc.alias("lc"), (acc["s"] + F.exp(lc)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval within [0, 1]; null for n = 0."""
    p, m = F.try_divide(successes.cast("double"), n), n.cast("double")
    denominator = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denominator
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denominator
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def cohens_h(a: Column, b: Column) -> Column:
    """Effect size of two shares."""
    return 2 * F.asin(F.sqrt(b)) - 2 * F.asin(F.sqrt(a))


def verdict(p: Column, difference: Column, alpha: float = ALPHA) -> Column:
    return F.when((p < alpha) & (difference > 0), "IMPROVES").when((p < alpha) & (difference < 0), "WORSENS").otherwise("NO CHANGE")
