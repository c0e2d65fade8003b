"""Efficiency aggregates, expectation tables and opponent adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def metric_block(prefix: str, keep: Column, value: Column, success: Column, weight: Column) -> list[Column]:
    """Conditional metrics of one split, all partial aggregates of one pass."""
    w = F.when(keep & value.isNotNull(), weight)
    hit = keep & success
    return [
        F.count_if(keep).alias(f"{prefix}_n"),
        ratio(F.sum(w * value), F.sum(w)).alias(f"{prefix}_mean"),
        ratio(F.sum(F.when(hit, 1.0)), F.sum(F.when(keep & success.isNotNull(), 1.0))).alias(f"{prefix}_success"),
        F.avg(F.when(hit, value)).alias(f"{prefix}_explosive"),
    ]


def over_expectation(df: DataFrame, situation: list[Column], outcome: Column, entity: list[str], default: float) -> DataFrame:
    """(entity, n, observed, expected, over): outcome rate against its situation's rate."""
    keys = [f"__s{i}" for i in range(len(situation))]
    rows = df.withColumns(dict(zip(keys, situation, strict=True)) | {"__y": outcome.cast("double")})
    table = rows.groupBy(*keys).agg(F.avg("__y").alias("__p"))
    joined = rows.join(table, keys, "left").withColumn("__p", F.coalesce("__p", F.lit(default)))
    return joined.groupBy(*entity).agg(F.count("*").alias("n"), F.avg("__y").alias("observed"), F.avg("__p").alias("expected"), (F.avg("__y") - F.avg("__p")).alias("over"))


def ridge_adjust(games: DataFrame, by: list[str], offense: str, defense: str, home: str, y: str, penalty: float = 5.0) -> DataFrame:
    """(by, entity, off, def, hfa): y = off - def + hfa * home, ridge on every coefficient.

    ``by`` names the league (or date and metric) that is fitted by itself. Spark
    sums each league's normal equations: counts by entity, by pair, and with
    home. One task solves one league: its rows are pairs of its teams, however
    many plays there are, so leagues must be bounded, not the table.
    """
    rows = games.select(*by, F.col(offense).cast("string").alias("o"), F.col(defense).cast("string").alias("d"), F.col(home).cast("double").alias("h"), F.col(y).cast("double").alias("y")).where("o is not null and d is not null and y is not null")
    pairs = rows.groupBy(*by, "o", "d").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("h").alias("sh"), F.sum(F.col("h") * F.col("h")).alias("shh"), F.sum(F.col("h") * F.col("y")).alias("shy"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["o"], *pdf["d"]})
        at = {x: i for i, x in enumerate(names)}
        n, k = len(names), 2 * len(names)
        o, d = pdf["o"].map(at).to_numpy(), pdf["d"].map(at).to_numpy() + n
        c, sh = pdf["n"].to_numpy(float), pdf["sh"].to_numpy(float)
        gram, right = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for i, j, v in ((o, o, c), (d, d, c), (o, d, -c), (d, o, -c), (o, k, sh), (k, o, sh), (d, k, -sh), (k, d, -sh)):
            np.add.at(gram, (i, j), v)
        gram[k, k] = pdf["shh"].sum()
        np.add.at(right, o, pdf["sy"].to_numpy(float))
        np.add.at(right, d, -pdf["sy"].to_numpy(float))
        right[k] = pdf["shy"].sum()
        b = np.linalg.solve(gram + penalty * np.eye(k + 1), right)
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "entity": names, "off": b[:n], "def": b[n:k], "hfa": b[k]})

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.groupBy(*by).applyInPandas(solve, f"{kinds}, entity string, off double, def double, hfa double")


def adjusted(games: DataFrame, ratings: DataFrame, by: list[str], offense: str, defense: str, home: str, y: str) -> DataFrame:
    """Adds adj_off and adj_def, each game's value freed of the opponent and the venue."""
    mine = ratings.select(*[F.col(c).alias(f"__m_{c}") for c in by], F.col("entity").alias("__o"), F.col("off").alias("__off"))
    theirs = ratings.select(*[F.col(c).alias(f"__t_{c}") for c in by], F.col("entity").alias("__d"), F.col("def").alias("__def"), F.col("hfa").alias("__h"))
    on = lambda side, team, name: [F.col(c) == F.col(f"__{side}_{c}") for c in by] + [F.col(team).cast("string") == F.col(name)]
    rows = games.join(mine, on("m", offense, "__o"), "left").join(theirs, on("t", defense, "__d"), "left")
    edge = F.col("__h") * F.col(home).cast("double")
    extra = [f"__{s}_{c}" for s in "mt" for c in by]
    return rows.withColumns({"adj_off": F.col(y) + F.col("__def") - edge, "adj_def": F.col("__off") - F.col(y) + edge}).drop("__o", "__d", "__off", "__def", "__h", *extra)
