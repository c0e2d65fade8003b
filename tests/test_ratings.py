"""Every order is rated, in many bounded leagues; a tuning row covers all of them."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.catalog import QUERIES
from chainmark.operators import ratings
from chainmark.plans.analytics import _games

from .oracle import SF, from_sql


def test_every_order_is_a_game(spark: SparkSession) -> None:
    want = from_sql("SELECT count(*) AS n, max(k) AS k FROM (SELECT count(*) OVER (PARTITION BY o_custkey // 50) AS k FROM orders)").iloc[0]
    for name in ("elo_fold", "joint_filter"):
        found = QUERIES[name](spark, SF)
        assert found.select("game").distinct().count() == found.count() == want.n, name
    sizes = [r["count"] for r in _games(spark, SF).groupBy("league").count().collect()]
    assert len(sizes) > 1 and max(sizes) == want.k


def test_tuning_covers_all_leagues(spark: SparkSession) -> None:
    games = _games(spark, SF)
    rows = {(r.k, r.factor): (r.n, r.log_loss) for r in ratings.elo_grid(games, [20, 30], [2.8]).collect()}
    assert len(rows) == 2
    p = ratings.elo(games, k=30.0).join(games.select("game", "margin"), "game").where("margin <> 0")
    q = F.when(F.col("margin") > 0, F.col("p_home")).otherwise(1 - F.col("p_home"))
    want = p.agg(F.count("*").alias("n"), F.avg(-F.log(q)).alias("loss")).first()
    assert rows[30.0, 2.8][0] == want.n
    assert math.isclose(rows[30.0, 2.8][1], want.loss, rel_tol=1e-9)
