"""Ordered computations per key as window expressions.

Orders must be total: give the time first and a unique column last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, half_life: float, name: str = "ewma") -> DataFrame:
    """One row a key: s1 = x1, s = a x + (1 - a) s with a = 1 - 0.5 ** (1 / half_life).

    Closed form: each value's weight follows from its place, so it is one sum.
    """
    a = 1 - 0.5 ** (1 / half_life)
    place = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = df.where(F.col(value).isNotNull()).withColumns({"__i": F.row_number().over(place), "__k": F.row_number().over(back) - 1})
    weight = F.pow(F.lit(1 - a), F.col("__k")) * F.when(F.col("__i") == 1, 1.0).otherwise(a)
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias(name))


def last_n_delta(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3, name: str = "delta") -> DataFrame:
    """Mean of the last n values less the mean of all."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("__k", F.row_number().over(back))
    return rows.groupBy(*keys).agg((F.avg(F.when(F.col("__k") <= n, F.col(value))) - F.avg(value)).alias(name))


def prior_mean(value: str, keys: list[str], order: list[str]) -> Column:
    """Mean of all earlier rows of the key, null for its first."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def gap(value: str, keys: list[str], order: list[str]) -> Column:
    """The previous row's value."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run`` (1, 2, ... by key) and ``run_pos`` for stretches of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).drop("__new")
    return rows.withColumn("run_pos", F.row_number().over(Window.partitionBy(*keys, "run").orderBy(*order)))


def tenures(df: DataFrame, keys: list[str], holder: str, season: str) -> DataFrame:
    """Adds ``tenure``: consecutive seasons of the holder up to each row."""
    w = Window.partitionBy(*keys, holder).orderBy(season)
    rows = df.withColumn("__island", F.col(season) - F.row_number().over(w))
    return rows.withColumn("tenure", F.row_number().over(Window.partitionBy(*keys, holder, "__island").orderBy(season))).drop("__island")


def streak_alarm(df: DataFrame, keys: list[str], order: list[str], z: str, limit: float = 2.0, length: int = 3) -> DataFrame:
    """Adds ``alarm``: the ``length``-th of consecutive same-sign z beyond ``limit``; counting restarts after it."""
    side = F.when(F.col(z) > limit, 1).when(F.col(z) < -limit, -1).otherwise(0)
    marked = runs(df.withColumn("__side", side), keys, order, "__side")
    return marked.withColumn("alarm", (F.col("__side") != 0) & (F.col("run_pos") % length == 0)).drop("__side", "run", "run_pos")


def drawdown(df: DataFrame, keys: list[str], order: list[str], change: str, start: float) -> DataFrame:
    """(keys, final, max_drawdown) of a running balance."""
    rows = ranges.running(df, keys, order, {"__b": F.col(change)}).withColumn("__b", F.lit(float(start)) + F.col("__b"))
    peaks = ranges.highest(rows, keys, order, "__b", float(start), "__peak")
    last = F.max_by("__b", F.struct(*order))
    return peaks.groupBy(*keys).agg(last.alias("final"), F.max((F.col("__peak") - F.col("__b")) / F.col("__peak")).alias("max_drawdown"))


def zscore(value: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Spearman's: Pearson correlation of average ranks, by key."""

    def average_rank(c: str) -> Column:
        same = F.count("*").over(Window.partitionBy(*keys, c))
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (same - 1) / 2

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": average_rank(x), "__y": average_rank(y)})
    return rows.groupBy(*keys).agg(F.corr("__x", "__y").alias(name))


def pick_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key by an explicit total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every member of a key that occurs more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def mode_smallest(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of a key; ties to the smallest."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    first = F.min_by(F.struct(F.col(value), F.col("__n")), F.struct(-F.col("__n"), F.col(value)))
    return counted.groupBy(*keys).agg(first.alias("m")).select(*keys, F.col(f"m.{value}").alias(name), F.col("m.__n").alias("n"))


def permute_in_group(df: DataFrame, keys: list[str], value: str, row: str, seed: str, name: str = "permuted") -> DataFrame:
    """Values dealt anew within each key; the order comes from md5, so any engine can repeat it."""
    a = ranges.numbered(df, keys, [row], "__i")
    b = ranges.numbered(df.select(*keys, F.col(value).alias(name), F.md5(F.concat(F.lit(seed), F.col(row).cast("string"))).alias("__h"), F.col(row).alias("__r")), keys, ["__h", "__r"], "__i")
    return a.join(b.drop("__h", "__r"), [*keys, "__i"]).drop("__i")
