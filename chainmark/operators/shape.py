"""Shapes of residuals: distance from a distribution, score of a sample, tails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges


def kolmogorov(df: DataFrame, by: list[str], value: str, key: str, cdf: Column) -> DataFrame:
    """(by, n, ks): greatest distance of the empirical distribution from ``cdf``, a column of each row; ranks by range parts."""
    rows = df.where(F.col(value).isNotNull()).withColumn("__f", cdf)
    ranked = ranges.numbered(rows, by, [value, key], "__i")
    n = ranked.groupBy(*by).agg(F.count("*").alias("n"))
    met = ranked.alias("a").join(F.broadcast(n.alias("b")), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]) if by else ranked.crossJoin(F.broadcast(n))  # one row a group
    gap = F.greatest(F.abs((F.col("__i") + 1) / F.col("n") - F.col("__f")), F.abs(F.col("__f") - F.col("__i") / F.col("n")))
    names = [F.col(f"a.{c}").alias(c) for c in by]
    return met.groupBy(*names).agg(F.first("n").alias("n"), F.max(gap).alias("ks"))


def empirical_crps(samples: DataFrame, by: list[str], value: str, key: str, outcomes: DataFrame, y: str) -> DataFrame:
    """(by, n, crps): the score of a group's sample for its outcome.

    The mean distance between two draws is a sum over ranks, so no pair of draws is formed.
    """
    rows = samples.where(F.col(value).isNotNull()).join(outcomes.select(*by, F.col(y).cast("double").alias("__y")), by)
    ranked = ranges.numbered(rows, by, [value, key], "__i")
    v = F.col(value).cast("double")
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.abs(v - F.col("__y"))).alias("__d"), F.sum(v * (2 * F.col("__i") + 1)).alias("__r"), F.sum(v).alias("__s"))
    n = F.col("n").cast("double")
    return sums.select(*by, "n", (F.col("__d") / n - (F.col("__r") - n * F.col("__s")) / (n * n)).alias("crps"))


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def _degrees(mean: float, now: float) -> float:
    """Degrees of freedom at which the expected weight equation holds; ``mean`` is the mean of log w - w."""
    f = lambda v: -_digamma(v / 2) + math.log(v / 2) + 1 + mean + _digamma((now + 1) / 2) - math.log((now + 1) / 2)
    low, high = 0.2, 1000.0
    if f(high) > 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def student(df: DataFrame, value: str, weight: str | None = None, rounds: int = 60, enough: float = 1e-4) -> dict[str, float]:
    """{mean, scale, df, n} of Student's t by expectation-maximisation; one aggregate of the rows a round.

    Heavy values get small expected weights; the driver sees five sums a round.
    Equal values are taken together first.
    """
    w0 = F.col(weight) if weight else F.lit(1.0)
    x = F.col("x")
    points = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(w0).alias("n")).cache()
    try:
        n, mean, var = points.agg(F.sum("n"), F.sum(x * F.col("n")) / F.sum("n"), F.sum(x * x * F.col("n")) / F.sum("n")).first()
        if not n:
            return {"mean": math.nan, "scale": math.nan, "df": math.nan, "n": 0.0}
        scale, degrees = max(1e-12, var - mean * mean) ** 0.5, 10.0
        for _ in range(rounds):
            z2 = ((x - mean) / scale) * ((x - mean) / scale)
            w = (degrees + 1) / (degrees + z2)
            r = points.agg(*[F.sum(F.col("n") * c) for c in (w, w * x, w * x * x, F.log(w) - w)]).first()
            new = r[1] / r[0]
            spread = max(1e-24, (r[2] - 2 * new * r[1] + new * new * r[0]) / n)
            after = _degrees(r[3] / n, degrees)
            still = abs(after - degrees) <= enough * degrees and abs(new - mean) <= enough * scale
            mean, scale, degrees = new, spread**0.5, after
            if still:
                break
        return {"mean": float(mean), "scale": float(scale), "df": float(degrees), "n": float(n)}
    finally:
        points.unpersist()


def soft_clip(x: Column, limit: float) -> Column:
    """x near zero, never beyond the limit: limit * tanh(x / limit)."""
    return F.lit(float(limit)) * F.tanh(x / limit)


