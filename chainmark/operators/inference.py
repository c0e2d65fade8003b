"""Resampling, regression and calibration statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_sums(df: DataFrame, block: list[str], value: Column) -> DataFrame:
    """(block number from 0, s, n): all that a bootstrap of a mean needs from the rows.

    One task numbers the blocks: one row of three numbers a block (weeks, months), not a row of data.
    """
    sums = df.where(value.isNotNull()).groupBy(*block).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return sums.withColumn("__b", (F.row_number().over(Window.orderBy(*block)) - 1).cast("long")).select("__b", "s", "n")


def draw(blocks: Column, replicate: Column, slot: Column, seed: str) -> Column:
    """Block number of one draw: eight hexadecimal digits of md5, modulo the blocks."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate.cast("string"), slot.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % blocks


def block_bootstrap(df: DataFrame, block: list[str], value: Column, replicates: int = 2000, seed: str = "b", level: float = 0.95) -> DataFrame:
    """(estimate, low, high, p_not_positive): mean with whole blocks resampled.

    Rows are reduced to sums by block first; replicates then only touch those.
    """
    sums = block_sums(df, block, value)
    blocks, estimate = sums.agg(F.count("*"), F.sum("s") / F.sum("n")).first()
    draws = df.sparkSession.range(replicates).select(F.col("id").alias("rep"), F.lit(estimate).alias("estimate"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long"))).alias("slot"))
    picked = draws.withColumn("__b", draw(F.lit(max(blocks, 1)), F.col("rep"), F.col("slot"), seed)).join(sums, "__b")
    means = picked.groupBy("rep", "estimate").agg((F.sum("s") / F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    bad = F.count_if(F.col("m") <= 0)
    return means.groupBy("estimate").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), ((bad + 1) / (F.count("*") + 1)).alias("p_not_positive"))


def bootstrap(df: DataFrame, by: list[str], block: list[str], sums: dict[str, Column], statistics: dict[str, Column], replicates: int = 500, seed: str = "b", level: float = 0.95) -> DataFrame:
    """(by, statistic, n_blocks, estimate, se, low, high, p): any statistic of sums, with whole blocks resampled.

    ``sums`` are what rows add up to (counts, moments, cross products);
    ``statistics`` are expressions over these sums (a mean, a slope, a
    correlation), so they merge over any blocks. Rows are read once, down to one
    vector a block; a replicate adds vectors by how often it drew their block.
    ``p`` is two-sided: twice the smaller share of replicates on one side of
    zero, the estimate counted as one of them.
    """
    each = df.groupBy(*by, *block).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*by)  # one row a block
    each = each.withColumns({"__b": F.row_number().over(w.orderBy(*block)) - 1, "__n": F.count("*").over(w)})
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), c.cast("double").alias("value")) for n, c in statistics.items()])).alias("x")
    totals = [F.sum(n).alias(n) for n in sums]
    whole = each.groupBy(*by).agg(F.first("__n").alias("n_blocks"), *totals).select(*by, "n_blocks", names).select(*by, "n_blocks", "x.statistic", F.col("x.value").alias("estimate"))
    slots = each.select(*by, F.col("__b").alias("__slot"), F.col("__n").alias("__of")).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = slots.withColumn("__b", draw(F.col("__of"), F.col("__rep"), F.col("__slot"), seed)).groupBy(*by, "__rep", "__b").agg(F.count("*").alias("__times"))
    again = drawn.join(each.drop("__n", *block), [*by, "__b"]).groupBy(*by, "__rep").agg(*[F.sum(F.col(n) * F.col("__times")).alias(n) for n in sums])
    values = again.select(*by, names).select(*by, "x.statistic", "x.value")
    tail, n = (1 - level) / 2, F.count("value") + 1
    spread = values.groupBy(*by, "statistic").agg(
        F.stddev_samp("value").alias("se"), F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"),
        F.least(F.lit(1.0), 2 * F.least((F.count_if(F.col("value") <= 0) + 1) / n, (F.count_if(F.col("value") >= 0) + 1) / n)).alias("p"),
    )
    return whole.join(spread, [*by, "statistic"]).select(*by, "statistic", "n_blocks", "estimate", "se", "low", "high", "p")


def block_bootstraps(df: DataFrame, by: list[str], block: list[str], value: Column, replicates: int = 500, seed: str = "b", level: float = 0.95) -> DataFrame:
    """(by, n, delta, low, high, p): the mean of ``value`` in each group."""
    rows = df.withColumn("__v", value).where(F.col("__v").isNotNull())
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    found = bootstrap(rows, by, block, {"__s": F.col("__v"), "__m": F.lit(1)}, {"mean": F.col("__s") / F.col("__m")}, replicates, seed, level)
    return n.join(found, by).select(*by, "n", F.col("estimate").alias("delta"), "low", "high", "p")


#: Sums of a straight line y = a + b x, and what they amount to.
LINE = {"n": lambda x, y: F.lit(1), "sx": lambda x, y: x, "sy": lambda x, y: y, "sxx": lambda x, y: x * x, "sxy": lambda x, y: x * y, "syy": lambda x, y: y * y}


def line_bootstrap(df: DataFrame, by: list[str], block: list[str], x: Column, y: Column, replicates: int = 500, seed: str = "ols", level: float = 0.95) -> DataFrame:
    """Slope, intercept and correlation of least squares, with bootstrap errors by whole blocks."""
    rows = df.withColumns({"__x": x.cast("double"), "__y": y.cast("double")}).where("__x is not null and __y is not null")
    n, sx, sy, sxx, sxy, syy = map(F.col, LINE)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    statistics = {"slope": slope, "intercept": (sy - slope * sx) / n, "correlation": F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))}
    return bootstrap(rows, by, block, {k: f(F.col("__x"), F.col("__y")) for k, f in LINE.items()}, statistics, replicates, seed, level)


def two_predictor_ols(df: DataFrame, keys: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """(keys, n, a, b1, b2): least squares by moments, one aggregate."""
    rows = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    c = lambda p, q: F.covar_pop(p, q)
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), c(x1, x1).alias("c11"), c(x2, x2).alias("c22"), c(x1, x2).alias("c12"), c(x1, y).alias("c1y"), c(x2, y).alias("c2y"))
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    b1 = F.try_divide(F.col("c1y") * F.col("c22") - F.col("c2y") * F.col("c12"), det)
    b2 = F.try_divide(F.col("c2y") * F.col("c11") - F.col("c1y") * F.col("c12"), det)
    return m.withColumns({"b1": b1, "b2": b2}).select(*keys, "n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("a"), "b1", "b2")


def reliability(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): equal-width bins, the last closed on the right."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.where(p.isNotNull() & y.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("rate"))


def stability_index(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(bin, expected, actual, psi) over the expected sample's quantile bins."""
    cuts = expected.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = F.lit(0)
        for c in cuts:
            b = b + (F.col(value) > c).cast("int")
        n = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
        return n.select("bin", F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy()), F.lit(floor)).alias(name))

    both = shares(expected, "expected").join(shares(actual, "actual"), "bin", "full").fillna(floor, ["expected", "actual"])
    return both.withColumn("psi", (F.col("actual") - F.col("expected")) * F.ln(F.col("actual") / F.col("expected")))


def conformal_threshold(df: DataFrame, keys: list[str], score: str, alpha: float, order: str) -> DataFrame:
    """(keys, n, threshold): the ceil((n + 1)(1 - alpha))-th smallest score, the largest if there are too few."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(score).isNotNull()).withColumns({"__i": F.row_number().over(w.orderBy(score, order)), "n": F.count("*").over(w)})
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("__i") == k, F.col(score))).alias("threshold"))


def interval_score(lo: Column, hi: Column, y: Column) -> Column:
    """Conformal score of a quantile band: how far outside, negative inside."""
    return F.greatest(lo - y, y - hi)
