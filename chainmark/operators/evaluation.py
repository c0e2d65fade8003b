"""Forecast evaluation: outcomes, slices, intervals, market baselines, economics, gates. One aggregate each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from . import ranges

# Normal quantiles of the usual central intervals, the plausibility limit, the usual two-way price.
LEVELS = {0.5: 0.6744897501960817, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}
PLAUSIBLE_Z = 3.0
FAIR = 0.5
ML_NOT_COMPUTED, ML_PRICES, ML_GIVEN = "NOT_COMPUTED", "DEVIGGED_AMERICAN", "PROVIDED"
TOLERANCE = 1e-12


def won(home: Column, away: Column) -> Column:
    """1 if the home side won, 0 if it lost, null for ties."""
    return F.when(home > away, 1.0).when(home < away, 0.0)


def covered(margin: Column, spread: Column) -> Column:
    """1 if the home side covers its spread, 0 if not, null for pushes."""
    edge = margin + spread
    return F.when(F.abs(edge) > TOLERANCE, (edge > 0).cast("double"))


def over(total: Column, line: Column) -> Column:
    return F.when(F.abs(total - line) > TOLERANCE, (total > line).cast("double"))


def accuracy(p: Column, y: Column) -> Column:
    """Aggregate: share of decided rows whose side had p of at least a half."""
    return F.avg(F.when(y.isNotNull() & p.isNotNull(), ((p >= 0.5) == (y == 1)).cast("double")))


def plausibility(df: DataFrame, by: list[str], p: Column, y: Column, z: float = PLAUSIBLE_Z) -> DataFrame:
    """(by, n, rate, low, high, plausible): accuracy against the band of a fair coin, by regime."""
    sums = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), accuracy(p, y).alias("rate"))
    half = z * F.sqrt(F.lit(0.25) / F.col("n"))
    return sums.withColumns({"low": 0.5 - half, "high": 0.5 + half}).withColumn("plausible", F.col("rate").between(F.col("low"), F.col("high")))


def interval_coverage(df: DataFrame, y: str, mu: str, sigma: str) -> DataFrame:
    """(level, n, coverage, mean_width) of normal intervals at every usual level."""
    s = F.greatest(F.col(sigma), F.lit(1e-8))
    half = F.col("z") * s
    levels = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(z).alias("z")) for level, z in LEVELS.items()])
    rows = df.where(F.col(y).isNotNull() & F.col(mu).isNotNull() & F.col(sigma).isNotNull()).select(y, mu, sigma, F.inline(levels))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(mu) - half, F.col(mu) + half).cast("double")).alias("coverage"), F.avg(2 * half).alias("mean_width"))


def slices(df: DataFrame, families: dict[str, Column], error: Column) -> DataFrame:
    """(family, value, n, mae, rmse, bias): each family of slices, stacked, in one pass."""
    named = F.array(*[F.struct(F.lit(f).alias("family"), c.cast("string").alias("value")) for f, c in families.items()])
    rows = df.withColumn("__e", error).where("__e is not null").select("__e", F.inline(named))
    e = F.col("__e")
    return rows.groupBy("family", "value").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def market_moneyline(df: DataFrame, home: str, away: str, given: str) -> DataFrame:
    """Adds p_market and status: fair prices where any row has both, else the given probability unless it is a constant half."""
    prices = numbers.fair_proportional(numbers.implied(F.col(home)), numbers.implied(F.col(away)))
    facts = df.agg(F.count(prices).alias("__prices"), F.count(given).alias("__given"), F.max(F.abs(F.col(given) - FAIR)).alias("__off"))
    status = F.when(F.col("__prices") > 0, ML_PRICES).when((F.col("__given") > 0) & (F.col("__off") > TOLERANCE), ML_GIVEN).otherwise(ML_NOT_COMPUTED)
    both = df.crossJoin(F.broadcast(facts.select(status.alias("status"))))  # one row
    return both.withColumn("p_market", F.when(F.col("status") == ML_PRICES, prices).when(F.col("status") == ML_GIVEN, F.col(given)))


def calibration_slope(df: DataFrame, p: str, y: str, rounds: int = 25) -> tuple[float, float]:
    """(intercept, slope) of the logistic regression of y on logit p; each Newton step is one aggregate."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("y"))
    a, b = 0.0, 1.0
    for _ in range(rounds):
        m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, e, x = m * (1 - m), F.col("y") - m, F.col("x")
        g0, g1, h00, h01, h11 = rows.agg(F.sum(e), F.sum(e * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
        det = h00 * h11 - h01 * h01 if g0 is not None else 0.0
        if not det:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-12:
            break
    return a, b


def economics(df: DataFrame, by: list[str], order: list[str], stake: str, profit: str) -> DataFrame:
    """(by, bets, roi, final, max_drawdown, sharpe): a bankroll of one under stakes that are shares of it.

    ``profit`` is the profit of a unit staked. The bankroll is a running product,
    kept as a sum of logarithms over range parts.
    """
    gain = F.col(stake) * F.col(profit)
    rows = df.where(gain > -1)
    sums = rows.groupBy(*by).agg(F.count("*").alias("bets"), (F.sum(gain) / F.sum(stake)).alias("roi"), F.try_divide(F.avg(gain), F.stddev_samp(gain)).alias("sharpe"))
    walked = ranges.path(rows, by, order, F.log1p(gain)).select(*by, F.exp("final").alias("final"), (1 - F.exp(-F.col("fall"))).alias("max_drawdown"))
    out = sums.join(walked, by).select(*by, "bets", "roi", "final", "max_drawdown", "sharpe")
    return out


def settle(bets: DataFrame, closes: DataFrame, consensus: DataFrame, key: list[str], book: str) -> DataFrame:
    """Bets with the same book's close, else the consensus close and its flag; bets with neither are left out."""
    own = closes.select(*key, book, F.col("fair").alias("__own"), F.col("row_id").alias("__row"))
    other = consensus.select(*key, F.col("fair").alias("__all"))
    both = bets.join(own, [*key, book], "left").join(other, key, "left").where("__own is not null or __all is not null")
    return both.withColumns({"close_fair": F.coalesce("__own", "__all"), "close_source": F.when(F.col("__own").isNotNull(), "same_book").otherwise("consensus"), "headline": F.col("__own").isNotNull()}).drop("__own", "__all", "__row")


def translated(bet_line: Column, close_line: Column, fair: Column, alternate: Column, model_bet: Column, model_close: Column) -> tuple[Column, Column]:
    """(fair probability at the bet's line, how): the same line, an alternate quote, the model's shift, or points only."""
    same = F.abs(bet_line - close_line) <= TOLERANCE
    value = F.when(same, fair).when(alternate.isNotNull(), alternate).when(model_bet.isNotNull() & model_close.isNotNull(), F.least(F.greatest(fair + model_bet - model_close, F.lit(0.0)), F.lit(1.0)))
    how = F.when(same, "same_line").when(alternate.isNotNull(), "alternate_quote").when(model_bet.isNotNull() & model_close.isNotNull(), "model_dist").otherwise("points_only")
    return value, how


def shopping(df: DataFrame, keys: list[str], fair: str) -> DataFrame:
    """(keys, best, consensus, capture): what the best price gives over the median of all books."""
    return df.groupBy(*keys).agg(F.min(fair).alias("best"), F.median(fair).alias("consensus")).withColumn("capture", F.col("consensus") - F.col("best"))


def confirmation(market: Column, line: Column, now: Column, stale: Column, limit: float = 0.5) -> Column:
    """void if stale or if a spread or total moved past the limit, else ok."""
    moved = market.isin("spread", "total") & (F.abs(now - line) > limit + 1e-9)
    return F.when(stale, "void_stale").when(F.coalesce(moved, F.lit(False)), "void_moved").otherwise("ok")


def mix_weight(df: DataFrame, y: str, a: str, b: str, steps: int = 100) -> DataFrame:
    """(w, mae): the first weight on the grid that minimises the error of w * a + (1 - w) * b; one aggregate of all points."""
    grid = [i / steps for i in range(steps + 1)]
    sums = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*[F.avg(F.abs(F.col(y) - w * F.col(a) - (1 - w) * F.col(b))).alias(f"m{i}") for i, w in enumerate(grid)])
    each = F.array(*[F.struct(F.round(f"m{i}", 9).alias("mae"), F.lit(w).alias("w")) for i, w in enumerate(grid)])
    return sums.select(F.array_min(each).alias("best")).select("best.w", "best.mae")


def random_effects(df: DataFrame, effect: str, variance: str) -> DataFrame:
    """(k, q, i2, tau2, pooled, se): Cochran's Q and the DerSimonian-Laird pooled effect over groups."""
    w = 1 / F.col(variance)
    one = df.agg(F.count("*").alias("k"), F.sum(w).alias("s1"), F.sum(w * w).alias("s2"), F.sum(w * F.col(effect)).alias("sx"), F.sum(w * F.col(effect) * F.col(effect)).alias("sxx"))
    one = one.withColumn("q", F.col("sxx") - F.col("sx") * F.col("sx") / F.col("s1"))
    tau = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k") - 1), F.col("s1") - F.col("s2") / F.col("s1")))
    facts = one.select("k", "q", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / F.col("q"))).otherwise(0.0).alias("i2"), F.coalesce(tau, F.lit(0.0)).alias("tau2"))
    v = 1 / (F.col(variance) + F.col("tau2"))
    rows = df.crossJoin(F.broadcast(facts))  # one row
    return rows.groupBy("k", "q", "i2", "tau2").agg((F.sum(v * F.col(effect)) / F.sum(v)).alias("pooled"), (1 / F.sqrt(F.sum(v))).alias("se"))


def power_n(n0: Column, se0: Column, target: float, z: float = 2.8015852) -> Column:
    """Rows needed to see ``target`` with the standard error that n0 rows gave; z for 5 % two-sided and 80 % power."""
    return F.ceil(n0 * F.pow(se0 * z / target, F.lit(2)))


def disagreement(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """(by, n, mean_signed, mean_abs, error_gap, share_worse) of forecast a against b."""
    gap = F.abs(F.col(y) - F.col(a)) - F.abs(F.col(y) - F.col(b))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(a) - F.col(b)).alias("mean_signed"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs"), F.avg(gap).alias("error_gap"), F.avg((gap > 0).cast("double")).alias("share_worse"))


def comparison(df: DataFrame, y: str, forecasts: list[str]) -> DataFrame:
    """(forecast, n, mae, rmse) of several forecasts on the rows that all of them have."""
    full = F.col(y).isNotNull()
    for f in forecasts:
        full = full & F.col(f).isNotNull()
    each = F.array(*[F.struct(F.lit(f).alias("forecast"), (F.col(y) - F.col(f)).alias("e")) for f in forecasts])
    return df.where(full).select(F.inline(each)).groupBy("forecast").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def sigma_deciles(df: DataFrame, sigma: str, error: str, bins: int = 10) -> DataFrame:
    """(decile, n, predicted, realised): does the predicted deviation say anything?"""
    rows = df.where(F.col(sigma).isNotNull() & F.col(error).isNotNull())
    cuts = rows.agg(F.percentile(sigma, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []
    b = F.lit(0)
    for c in cuts:
        b = b + (F.col(sigma) > c).cast("int")
    return rows.groupBy(b.alias("decile")).agg(F.count("*").alias("n"), F.avg(sigma).alias("predicted"), F.stddev_pop(error).alias("realised"))


def jarque_bera(df: DataFrame, by: list[str], e: str) -> DataFrame:
    """(by, n, skewness, excess, jb) of residuals."""
    sums = df.where(F.col(e).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("excess"))
    return sums.withColumn("jb", F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("excess") * F.col("excess") / 4))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def coherent(q10: Column, mu: Column, q90: Column) -> Column:
    """The interval as a struct, null unless it lies around the mean."""
    return F.when((q10 < mu) & (mu < q90), F.struct(q10.alias("q10"), q90.alias("q90")))


def tier_histogram(df: DataFrame, by: list[str], tier: str, strong: str = "strong_lean", bottom: str = "toss_up") -> DataFrame:
    """(by, n, strong_share, bottom_share, degenerate): more than half strong, or less than one in twenty undecided."""
    out = df.where(F.col(tier).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(tier) == strong).cast("double")).alias("strong_share"), F.avg((F.col(tier) == bottom).cast("double")).alias("bottom_share"))
    return out.withColumn("degenerate", (F.col("strong_share") > 0.5) | (F.col("bottom_share") < 0.05))


def block_gates(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, feature, n, sd, zero_rate, flat): features that say nothing within a block."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), *[x for c in columns for x in (F.stddev_pop(c).alias(f"{c}__d"), F.avg((F.col(c) == 0).cast("double")).alias(f"{c}__z"))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__d").alias("sd"), F.col(f"{c}__z").alias("zero_rate")) for c in columns])
    return sums.select(*by, "n", F.inline(each)).withColumn("flat", F.coalesce(F.col("sd") <= 1e-12, F.lit(True)))


def top_correlated(df: DataFrame, columns: list[str], label: str, k: int) -> list[str]:
    """The k columns with the largest absolute correlation, ties by name; one aggregate."""
    row = df.agg(*[F.abs(F.corr(c, label)).alias(c) for c in columns]).first()
    known = [(0.0 if row[c] is None or math.isnan(row[c]) else row[c], c) for c in columns]
    return [c for _, c in sorted(known, key=lambda x: (-round(x[0], 12), x[1]))[:k]]


def bonferroni_gate(df: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Adds the corrected limit of each family and whether all its members pass."""
    w = Window.partitionBy(*by)
    return df.withColumn("limit", alpha / F.count("*").over(w)).withColumn("promoted", F.bool_and(F.col(p) <= F.col("limit")).over(w))


def rates(df: DataFrame, by: list[str], hit: Column, z: float = 1.959963984540054) -> DataFrame:
    """(by, n, rate): rate is a struct (value, low, high) by Wilson, so it cannot be had without its bounds."""
    sums = df.where(hit.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("__r"))
    n, r = F.col("n"), F.col("__r")
    middle, half = r + z * z / (2 * n), z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return sums.select(*by, "n", F.struct(r.alias("value"), ((middle - half) / scale).alias("low"), ((middle + half) / scale).alias("high")).alias("rate"))
