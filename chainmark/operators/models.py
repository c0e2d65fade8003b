"""Stacking, calibration, priors and simulation as aggregates; no model library runs inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from . import inference, ranges
from .distribution import once


def out_of_fold(df: DataFrame, block: Column, y: str, name: str = "oof") -> DataFrame:
    """Adds the mean of ``y`` over all earlier blocks, null in the first: expanding training, one row a block."""
    sums = df.groupBy(block.alias("__b")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # blocks are few
    before = sums.select("__b", F.try_divide(F.sum("__s").over(w), F.sum("__n").over(w)).alias(name))
    return df.withColumn("__b", block).join(F.broadcast(before), "__b").drop("__b")


def stack_two(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """(by, n, w, rmse): the weight in [0, 1] of a against b with the least squared error; closed form from one aggregate."""
    d, e = F.col(a) - F.col(b), F.col(y) - F.col(b)
    m = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(d * d).alias("__dd"), F.sum(d * e).alias("__de"), F.sum(e * e).alias("__ee"))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("__de"), F.col("__dd")), F.lit(0.5))))
    m = m.withColumn("w", w)
    loss = F.col("__ee") - 2 * F.col("w") * F.col("__de") + F.col("w") * F.col("w") * F.col("__dd")
    return m.select(*by, "n", "w", F.sqrt(F.greatest(F.lit(0.0), loss) / F.col("n")).alias("rmse"))


def ensemble_sigma(members: list[Column], sigma: Column) -> Column:
    """Deviation of an ensemble: its members' spread and the predicted deviation together; null members do not count."""
    there = F.filter(F.array(*members), lambda x: x.isNotNull())
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    spread = once(there, lambda xs: once(mean(xs), lambda m: mean(F.transform(xs, lambda x: (x - m) * (x - m)))))
    return F.when(F.size(there) > 0, F.sqrt(spread + sigma * sigma))


def credible(df: DataFrame, by: list[str], members: list[str], least: float = 1e-12) -> DataFrame:
    """Members that do not vary within a group are null there, and ``reason`` names them."""
    w = Window.partitionBy(*by)
    flat = {m: F.coalesce(F.stddev_pop(m).over(w) <= least, F.lit(True)) for m in members}
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in flat.items()]), lambda x: x.isNotNull()), ",")
    return df.withColumns({"reason": reasons} | {m: F.when(~c, F.col(m)) for m, c in flat.items()})


def pit(y: Column, mu: Column, sigma: Column) -> Column:
    return numbers.normal_cdf((y - mu) / F.greatest(sigma, F.lit(1e-8)))


def pit_map(df: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """(by, grid, mapped, gap): the recalibration map on a grid, and how far it is from the diagonal; one aggregate."""
    grid = [i / bins for i in range(1, bins)]
    sums = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*[F.avg((F.col(value) <= g).cast("double")).alias(f"g{i}") for i, g in enumerate(grid)])
    each = F.array(*[F.struct(F.lit(g).alias("grid"), F.col(f"g{i}").alias("mapped")) for i, g in enumerate(grid)])
    return sums.select(*by, F.inline(each)).withColumn("gap", F.abs(F.col("mapped") - F.col("grid")))


def chance_band(df: DataFrame, prediction: str, label: str, key: str, replicates: int = 20, seed: str = "p") -> DataFrame:
    """(mae, low, high, inside): the error with labels shuffled between groups of equal keys, against its band.

    Every replicate moves labels by a hash of its number, so any engine repeats it; pairs of replicate and row are one join each.
    """
    rows = df.select(prediction, label, key)
    n = rows.count()
    own = ranges.numbered(rows, [], [key], "__i")
    moved = own.select(F.col("__i").alias("__j"), F.col(label).alias("__y"))
    reps = own.select("__i", prediction, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    shift = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"))), 1, 8), 16, 10).cast("long") % max(1, n - 1) + 1
    errors = reps.withColumn("__j", (F.col("__i") + shift) % max(1, n)).join(moved, "__j").groupBy("rep").agg(F.avg(F.abs(F.col(prediction) - F.col("__y"))).alias("m"))
    band = errors.agg((F.avg("m") - 2 * F.stddev_samp("m")).alias("low"), (F.avg("m") + 2 * F.stddev_samp("m")).alias("high"))
    true = rows.agg(F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"))
    return true.crossJoin(band).withColumn("inside", F.col("mae").between(F.col("low"), F.col("high")))


def prior_design(ratings: DataFrame, season: str, team: str, group: str, rating: str, carry: float = 0.5) -> DataFrame:
    """Adds prior: last season's rating pulled to its group's mean; null without a last season."""
    w = Window.partitionBy(team).orderBy(season)
    before = F.when(F.lag(season).over(w) == F.col(season) - 1, F.lag(rating).over(w))
    middle = F.avg(rating).over(Window.partitionBy(group, season))
    rows = ratings.withColumns({"__before": before, "__m": middle})
    last = rows.select(F.col(group).alias("__g"), (F.col(season) + 1).alias("__s"), F.col("__m").alias("__lm")).distinct()
    both = rows.join(last, (F.col(group) == F.col("__g")) & (F.col(season) == F.col("__s")), "left")
    return both.withColumn("prior", carry * F.col("__before") + (1 - carry) * F.col("__lm")).drop("__before", "__m", "__g", "__s", "__lm")


def prior_fit(design: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """(by, n, a, b1, b2): least squares of the rating on its prior and one more input."""
    return inference.two_predictor_ols(design, by, y, x1, x2)


def blended(prior: Column, prior_var: Column, seen: Column, seen_var: Column) -> tuple[Column, Column]:
    """(mean, variance) of a prior and an observation by precision; either alone where the other is null."""
    a, b = 1 / prior_var, 1 / seen_var
    both = prior.isNotNull() & seen.isNotNull()
    return F.when(both, (a * prior + b * seen) / (a + b)).otherwise(F.coalesce(prior, seen)), F.when(both, 1 / (a + b)).when(prior.isNotNull(), prior_var).otherwise(seen_var)


def draws(df: DataFrame, key: str, n: int, seed: str = "d") -> DataFrame:
    """``n`` uniform draws a row, from md5 of seed, key and number: reruns and other engines agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("draw").cast("string"))), 1, 8)
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", (F.conv(digits, 16, 10).cast("double") + 0.5) / 2**32)


def artifact(df: DataFrame, keys: list[str], name: str, order: list[str], fields: list[str]) -> DataFrame:
    """(keys, json): a nested document of each key's rows in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(*keys).agg(F.to_json(F.struct(*[F.first(k).alias(k) for k in keys], F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name))).alias("json"))
