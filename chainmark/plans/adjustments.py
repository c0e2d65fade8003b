"""Opponent-adjusted families on line items read as plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, features
from ..sources.store import kept
from .features import _DRIVES, _EFFICIENCY, _METRICS, _PLAYS, _drives, _plays
from .registry import query, r6


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a game and offence with all twelve metrics."""
    played = features.game_efficiency(_plays(spark, sf_dir))
    drives = features.drive_metrics(_drives(spark, sf_dir))
    return played.join(drives, ["game_id", "offense_id"], "left").withColumn("home", (F.col("game_id") + F.col("offense_id")) % 2 == 0)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(adjust.observations(_games(spark, sf_dir), ["game_id", "offense_id", "defense_id", "home"], adjust.METRICS), "observations")


_LONG = "o AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, game_id, offense_id, defense_id, (game_id + offense_id) % 2 = 0 AS home, CAST({c} AS DOUBLE) AS y FROM g WHERE {c} IS NOT NULL" for m, c in adjust.METRICS.items()) + ")"


# SQL names every unknown and its rows; each normal equation must come out as zero
@query(f"""
    WITH {_PLAYS}, {_EFFICIENCY}, {_DRIVES}, {_METRICS}, g AS (SELECT * FROM e LEFT JOIN dm USING (game_id, offense_id)), {_LONG}
    SELECT measure, 'off' AS side, CAST(offense_id AS VARCHAR) AS entity, count(*) AS n, 0.0 AS residual FROM o GROUP BY ALL
    UNION ALL SELECT measure, 'def', CAST(defense_id AS VARCHAR), count(*), 0.0 FROM o GROUP BY ALL
    UNION ALL SELECT measure, 'home', NULL, count(*), 0.0 FROM o GROUP BY ALL""")
def opponent_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of twelve measures after conjugate gradients, recomputed from the games."""
    obs = _observations(spark, sf_dir)
    found = kept(adjust.solve(obs, ["measure"], "offense_id", "defense_id", "home", "y"), "solved")
    rest = adjust.residuals(obs, ["measure"], "offense_id", "defense_id", "home", "y", found)
    return rest.select("measure", "side", "entity", "n", (r6("residual") + 0.0).alias("residual"))


@query()
def adjusted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy-two adjusted features of every team: two sides, twelve metrics, three forms."""
    found = adjust.family(_observations(spark, sf_dir), "offense_id", "defense_id", "home", ["game_id"], adjust.METRICS)
    return found.select("entity", *[r6(c).alias(c) for c in found.columns if c != "entity"])
