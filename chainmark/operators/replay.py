"""Walk-forward replay: a job a step, its state a committed version, restarted at any step.

A step reads the states that the step before committed and nothing else of the
past; what it returns is written into its attempt's folder and committed once.
A replay that was killed goes on at the first step without a commit and gives
what an unbroken one gives. Another specification is another replay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.store import kept
from . import ratings

States = dict[str, DataFrame]
Advance = Callable[[object, States], tuple[DataFrame, States]]


class Replay:
    """Steps in order; ``spec`` names everything else that decides the result."""

    def __init__(self, ledger: Ledger, name: str, steps: list, spec: str) -> None:
        self.ledger, self.steps = ledger, steps
        self.name = f"{name}-{hashlib.sha256(spec.encode()).hexdigest()[:12]}"

    def _key(self, i: int) -> str:
        return f"{self.name}-{i:05d}"

    def states(self, i: int, first: States) -> States:
        """States after step i - 1."""
        if not i:
            return first
        done = self.ledger.get(self._key(i - 1))
        return {n: self.ledger.spark.read.parquet(f"{done['folder']}/states/{n}") for n in done["states"]}

    def run(self, first: States, advance: Advance, most: int | None = None) -> list[bool]:
        """For each step, whether it ran now; ``most`` steps at most."""
        ran = []
        for i, step in enumerate(self.steps[:most]):

            def work(folder: str, i: int = i, step: object = step) -> dict:
                rows, states = advance(step, self.states(i, first))
                rows.write.parquet(f"{folder}/rows")
                for n, df in states.items():
                    df.write.parquet(f"{folder}/states/{n}")
                return {"step": str(step), "states": sorted(states)}

            ran.append(self.ledger.run_once(self._key(i), work)[1])
        return ran

    def rows(self) -> DataFrame:
        """Rows of all committed steps, with the number of the step."""
        out = None
        for i in range(len(self.steps)):
            done = self.ledger.get(self._key(i))
            if done is None:
                break
            some = self.ledger.spark.read.parquet(f"{done['folder']}/rows").withColumn("step", F.lit(i))
            out = some if out is None else out.unionByName(some)
        if out is None:
            raise KeyError(f"{self.name} has no committed step")
        return out


FIT = "n double, sx double, sy double, sxx double, sxy double, syy double"


def line(fit: DataFrame) -> DataFrame:
    """(a, b, sd, n) of least squares from sums; null below three rows or without spread."""
    n, sx, sy, sxx, sxy, syy = map(F.col, ("n", "sx", "sy", "sxx", "sxy", "syy"))
    b = F.when(n >= 3, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))
    a = F.try_divide(sy - b * sx, n)
    rest = F.greatest(F.lit(0.0), syy - a * sy - b * sxy)
    return fit.select(a.alias("a"), b.alias("b"), F.sqrt(F.try_divide(rest, n)).alias("sd"), "n")


def elo_walk(games: DataFrame) -> tuple[list[int], States, Advance]:
    """Steps (seasons), first states and the advance of a forecast of margins.

    A season's games are rated in order; each forecast is a line on the rating
    gap, fitted on the rated games of earlier seasons only (sums in the state).
    """
    spark = games.sparkSession
    steps = sorted(r[0] for r in games.select("season").distinct().collect())  # one row a season
    group = ratings.groups_of(games)  # of all seasons: a state's league stays where its games are
    first = {"ratings": spark.createDataFrame([], ratings.ELO_STATE), "fit": spark.createDataFrame([(0.0,) * 6], FIT)}

    def advance(step: object, states: States) -> tuple[DataFrame, States]:
        now = games.where(F.col("season") == step)
        done = kept(ratings.elo_step(states["ratings"], now, group=group), "walk")
        rated = done.where(F.col("game").isNotNull()).select("league", "game", "home_before", "away_before", "p_home", "seen_before")
        rows = rated.join(now.select("game", "ts", "season", "margin"), "game").withColumn("gap", F.col("home_before") - F.col("away_before"))
        x, y = F.col("gap"), F.col("margin").cast("double")
        new = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(f"d{i}") for i, c in enumerate((F.lit(1.0), x, y, x * x, x * y, y * y))])
        names = [f.split()[0] for f in FIT.split(", ")]
        fit = states["fit"].crossJoin(F.broadcast(new)).select(*[(F.col(n) + F.col(f"d{i}")).alias(n) for i, n in enumerate(names)])  # one row each
        out = rows.crossJoin(F.broadcast(line(states["fit"]))).withColumn("forecast", F.col("a") + F.col("b") * F.col("gap"))
        return out.select("league", "game", "season", "ts", "margin", "p_home", "gap", "forecast", F.col("sd").alias("forecast_sd"), "seen_before"), {"ratings": done.where(F.col("team").isNotNull()).select(*[f.split()[0] for f in ratings.ELO_STATE.split(", ")]), "fit": fit}

    return steps, first, advance


def information_audit(rows: DataFrame, inputs: DataFrame, league: str, ts: str, key: str, recorded: str, flag: Column | None = None) -> DataFrame:
    """(key, recorded, possible, status) of every forecast.

    ``possible`` is recomputed from the inputs: the latest result strictly
    before the forecast's own time. A forecast that records a later one has
    looked ahead; one that records an earlier one has missed inputs.
    """
    times = inputs.select(F.col(league).alias("__l"), F.col(ts).alias("__t")).distinct()
    w = Window.partitionBy("__l").orderBy("__t")
    possible = times.withColumn("possible", F.lag("__t").over(w))
    met = rows.join(possible, (F.col(league) == F.col("__l")) & (F.col(ts) == F.col("__t")), "left")
    status = F.when(F.col(recorded) >= F.col(ts), "ahead").when(F.col(recorded).eqNullSafe(F.col("possible")), "ok").when(F.col(recorded).isNull() | (F.col(recorded) < F.col("possible")), "missed").otherwise("ahead")
    return met.select(key, recorded, "possible", (status if flag is None else F.when(flag, status)).alias("status"))
