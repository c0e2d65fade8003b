"""Edges, stakes, filters, settlement and publication grades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import expected_value, kelly
from . import ranges

# Names and limits of the tiers, from the strongest down, and the band against flapping.
TIERS = (("strong_lean", 0.85), ("clear_lean", 0.70), ("lean", 0.575))
BOTTOM = "toss_up"
BAND = 0.03


def reasons(*checks: tuple[str, Column]) -> Column:
    """Names of all checks that hold, as an array."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())


def stakes(df: DataFrame, period: list[str], order: list[str], p: str, decimal: str, weekly: float = 0.10, team: str | None = None, per_team: float = 0.05) -> DataFrame:
    """Adds edge, stake and placed: quarter Kelly until the period's or the team's exposure is used up.

    What is placed on a row depends on what was placed before it, on the team
    and in all, so each period's bets (a week's, sorted) are settled in order.
    """
    rows = df.withColumns({"edge": expected_value(F.col(p), F.col(decimal)), "stake": kelly(F.col(p), F.col(decimal))})
    if team is None:
        w = Window.partitionBy(*period).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("stake").over(w), F.lit(0.0))
        return rows.withColumn("placed", F.greatest(F.lit(0.0), F.least(F.col("stake"), F.lit(weekly) - before)))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, total, placed = pdf.sort_values(order, kind="stable"), {}, 0.0, []
        for t, stake in zip(pdf[team].astype(object).where(pdf[team].notna(), ""), pdf["stake"].astype(float), strict=True):
            now = max(0.0, min(stake, weekly - total, per_team - used.get(t, 0.0)))
            total, used[t] = total + now, used.get(t, 0.0) + now
            placed.append(now)
        return pdf.assign(placed=placed)

    # one period's bets are one group; each is placed in constant time
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*period).applyInPandas(settle, f"{schema}, placed double")


def best_price(df: DataFrame, keys: list[str], decimal: str, order: str) -> DataFrame:
    """Row with the highest price of each key, the first in order on ties."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(decimal), -F.col(order)))
    return df.groupBy(*keys).agg(best.alias("r")).select("r.*")


def closing_value(df: DataFrame, bet_fair: str, close_fair: str, bet_row: str, close_row: str) -> DataFrame:
    """Adds clv; null where there is no close or the close is the bet's own quote."""
    own = F.col(bet_row).eqNullSafe(F.col(close_row))
    return df.withColumn("clv", F.when(~own, F.col(close_fair) - F.col(bet_fair)))


def strata(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, positive, low, high): strata are never pooled."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive"), F.stddev_samp(value).alias("__sd"))
    half = 1.96 * F.col("__sd") / F.sqrt("n")
    return sums.select(*by, "n", "mean", "positive", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def tier(p: Column) -> Column:
    out = F.lit(BOTTOM)
    for name, least in reversed(TIERS):
        out = F.when(p >= least, name).otherwise(out)
    return F.when(p.isNotNull(), out)


def held_tier(p: Column, previous: Column) -> Column:
    """The tier after ``previous``: it holds until p falls short of its limit by the band; a higher limit lifts it at once.

    Only the bottom tier is left no sooner than its upper limit and the band.
    """
    raw = tier(p)
    out = F.when((previous == BOTTOM) & (p < round(TIERS[-1][1] + BAND, 9)), BOTTOM)
    for name, least in TIERS:
        out = out.when((previous == name) & (p >= round(least - BAND, 9)), F.when(p >= least, raw).otherwise(name))
    return out.otherwise(raw)


NAMES = (BOTTOM, *(name for name, _ in reversed(TIERS)))


def _next_tiers(p: np.ndarray) -> np.ndarray:
    """Tier number after each p, from each tier number and, last, from none."""
    limits = np.array([least for _, least in reversed(TIERS)])
    raw = (p[:, None] >= limits).sum(axis=1)
    out = np.repeat(raw[:, None], len(NAMES) + 1, axis=1)
    for i, least in enumerate(limits, 1):
        held = p >= round(least - BAND, 9)
        out[:, i] = np.where(held, np.maximum(raw, i), raw)
    out[:, 0] = np.where(p < round(limits[0] + BAND, 9), 0, raw)
    return out


def tier_history(df: DataFrame, keys: list[str], order: list[str], p: str) -> DataFrame:
    """Adds tier with hysteresis, row by row in ``order``; rows without ``p`` are left out.

    The rule of ``held_tier`` has as many states as tiers, so a key's rows are
    folded in range parts, however many there are.
    """
    rows = df.where(F.col(p).isNotNull()).withColumn("__p", F.col(p).cast("double"))
    found = ranges.fold(rows, keys, order, "__p", len(NAMES), _next_tiers, "__tier")
    return found.withColumn("tier", F.get(F.array(*map(F.lit, NAMES)), F.col("__tier"))).select(*df.columns, "tier")


def graded(publishes: DataFrame, games: DataFrame, game: str, ts: str, kickoff: str, precedence: str) -> DataFrame:
    """Each game with its best publish strictly before kickoff: precedence first, then the latest."""
    before = publishes.join(games.select(game, F.col(kickoff).alias("__k")), game).where(F.col(ts) < F.col("__k")).drop("__k")
    best = before.groupBy(game).agg(F.max_by(F.struct(*[c for c in publishes.columns if c != game]), F.struct(precedence, ts)).alias("publish"))
    return games.join(best, game, "left").withColumn("status", F.when(F.col("publish").isNull(), "no_pre_kickoff_publish").otherwise("graded"))
