"""Discrete score distributions: exact probabilities instead of draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import normal_cdf, once

#: Margins a distribution covers, and the edges of its buckets of |mu|.
REACH = 80
BUCKETS = (0.0, 3.5, 7.5, 14.5, 21.5)


def bucket_of(mu: Column) -> Column:
    n = F.lit(0)
    for edge in BUCKETS[1:]:
        n = n + (F.abs(mu) >= edge).cast("int")
    return n


def key_number_kernel(df: DataFrame, mu: str, outcome: str, min_count: int = 5, min_rows: int = 40) -> DataFrame:
    """(bucket, kernel): offset from the rounded mean -> weight, mean weight 1.

    Buckets with fewer than ``min_rows`` rows use all rows' kernel (bucket -1).
    Offsets seen fewer than ``min_count`` times weigh 1.
    """
    offset = (F.bround(F.col(outcome)) - F.bround(F.col(mu))).cast("int")
    rows = df.where(F.col(mu).isNotNull() & F.col(outcome).isNotNull()).select(F.explode(F.array(bucket_of(F.col(mu)), F.lit(-1))).alias("bucket"), offset.alias("offset"))
    counts = rows.groupBy("bucket", "offset").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket")
    raw = F.when(F.col("n") >= min_count, F.col("n") / F.avg("n").over(w)).otherwise(1.0)
    weighed = counts.withColumn("weight", raw).withColumn("weight", F.col("weight") / F.avg("weight").over(w)).withColumn("rows", F.sum("n").over(w))
    kernel = F.map_from_entries(F.sort_array(F.collect_list(F.struct("offset", "weight"))))
    return weighed.where((F.col("rows") >= min_rows) | (F.col("bucket") == -1)).groupBy("bucket").agg(kernel.alias("kernel"))


def pmf(mu: Column, sigma: Column, kernel: Column | None = None, reach: int = REACH) -> Column:
    """array<struct(k, p)>: normal mass on whole numbers, times the kernel, summing to one."""
    s = F.greatest(sigma, F.lit(1e-8))
    weight = lambda k: F.lit(1.0) if kernel is None else F.coalesce(F.try_element_at(kernel, (k - F.bround(mu)).cast("int")), F.lit(1.0))
    # every edge's distribution function once; each step goes through an array of one, so nothing is computed again inside a lambda
    cdf = F.transform(F.sequence(F.lit(-reach), F.lit(reach + 1)), lambda k: once((k - 0.5 - mu) / s, normal_cdf))
    mass = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2 * reach)), lambda i: (F.get(c, i + 1) - F.get(c, i)) * weight(i - reach))
    share = lambda x: F.transform(x["raw"], lambda m, i: F.struct((i - reach).alias("k"), (m / x["total"]).alias("p")))
    summed = lambda r: F.struct(r.alias("raw"), F.aggregate(r, F.lit(0.0), lambda a, m: a + m).alias("total"))
    return once(once(once(cdf, mass), summed), share)


def probability(dist: Column, holds: Callable[[Column], Column]) -> Column:
    """Mass of the outcomes for which ``holds(k)`` is true."""
    return F.aggregate(dist, F.lit(0.0), lambda a, x: a + F.when(holds(x["k"]), x["p"]).otherwise(0.0))


def cover(dist: Column, line: Column) -> tuple[Column, Column]:
    """(probability that the home side covers, given no push; probability of a push)."""
    push = probability(dist, lambda k: k + line == 0)
    return F.try_divide(probability(dist, lambda k: k + line > 0), 1 - push), push


def normal_cover(mu: Column, sigma: Column, line: Column, reach: int = REACH) -> tuple[Column, Column]:
    """``cover`` of ``pmf`` without a kernel: sums over neighbouring whole numbers are differences of two edges."""
    s = F.greatest(sigma, F.lit(1e-8))
    cdf = lambda edge: normal_cdf((edge - mu) / s)
    held = lambda k: F.greatest(F.lit(-reach - 0.5), F.least(F.lit(reach + 0.5), k))
    total = cdf(F.lit(reach + 0.5)) - cdf(F.lit(-reach - 0.5))
    push = F.when(line == F.floor(line), F.try_divide(cdf(held(0.5 - line)) - cdf(held(-0.5 - line)), total)).otherwise(0.0)
    above = F.try_divide(cdf(F.lit(reach + 0.5)) - cdf(held(F.floor(-line) + 0.5)), total)
    return F.try_divide(above, 1 - push), push


def residual_correlation(x: Column, y: Column, limit: float = 0.95) -> Column:
    """Aggregate: Pearson correlation of residuals within limits."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(F.corr(x, y), F.lit(0.0))))


def mixture(df: DataFrame, keys: list[str], mu: str, sigma: str) -> DataFrame:
    """(keys, mu, sigma) over draws of the inputs, by the law of total variance."""
    return df.groupBy(*keys).agg(F.avg(mu).alias("mu"), F.sqrt(F.avg(F.col(sigma) * F.col(sigma)) + F.var_pop(mu)).alias("sigma"))
