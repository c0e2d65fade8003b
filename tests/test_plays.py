"""Play flags on labelled plays, and operators that have no SQL against plain Python."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.functions import plays
from chainmark.operators import efficiency, evaluation, ratings
from chainmark.streaming import captures

# label, down, distance, yards, period, margin, wp -> rush, pass, special, penalty, havoc, success, garbage
PLAYS = [
    ("Rush", 1, 10, 5, 1, 0, None, True, False, False, False, False, True, False),
    ("Rush", 1, 10, 4, 1, 29, None, True, False, False, False, False, False, True),
    ("Rushing Touchdown", 2, 10, 7, 2, 24, None, True, False, False, False, False, True, False),
    ("Pass Reception", 2, 10, 6, 2, -25, None, False, True, False, False, False, False, True),
    ("Pass Incompletion", 3, 2, 0, 3, 21, 0.5, False, True, False, False, False, False, False),
    ("Passing Touchdown", 4, 0, 0, 5, 17, None, False, True, False, False, False, True, True),
    ("Sack", 3, 8, -7, 4, 16, 0.981, False, True, False, False, True, False, True),
    ("Interception", 1, 10, None, 4, 40, 0.98, False, True, False, False, True, None, False),
    ("Pass Interception Return", 1, 10, 0, 6, None, None, False, True, False, False, True, False, False),
    ("Interception Return Touchdown", 1, 10, 0, None, 60, None, False, True, False, False, True, False, False),
    ("Fumble Recovery (Opponent)", 2, 5, 1, 4, 0, 0.019, False, False, False, False, True, False, True),
    ("Fumble Return Touchdown", 2, 5, 9, 4, 0, 0.02, False, False, False, False, True, True, False),
    ("Blocked Punt Touchdown", 4, 5, 0, 1, 0, None, False, False, True, False, False, False, False),
    ("Kickoff", 0, 10, 20, 1, 0, None, False, False, True, False, False, None, False),
    ("Safety", 3, None, -2, 1, 0, None, False, False, True, False, False, None, False),
    ("Penalty", 1, 10, -5, 1, 0, None, False, False, False, True, False, False, False),
    ("Defensive Penalty", 1, 10, 5, 1, 0, None, False, False, False, False, False, True, False),
    (None, 1, 10, 5, 1, 0, None, False, False, False, False, False, True, False),
]


def test_labelled_plays(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, *p[:7]) for i, p in enumerate(PLAYS)], "i int, label string, down int, distance int, yards int, period int, margin int, wp double")
    c = F.col("label")
    flag, rule = plays.garbage_time(F.col("margin"), F.col("period"), F.col("wp"))
    found = df.select("i", plays.is_rush(c), plays.is_pass(c), plays.is_special(c), plays.is_penalty(c), plays.havoc(c), plays.success(F.col("yards"), F.col("distance"), F.col("down")), flag, rule).orderBy("i").collect()
    for row, play in zip(found, PLAYS, strict=True):
        assert tuple(row)[1:8] == play[7:], play
        assert row[8] == ("connelly_fallback" if play[6] is None else "wp")


def test_ridge_solves_every_league(spark: SparkSession) -> None:
    r = random.Random(3)
    rows = [(g, f"t{r.randrange(12)}", f"t{r.randrange(12)}", float(r.random() < 0.5), r.gauss(0, 1)) for g in (1, 2, 3) for _ in range(200)]
    df = spark.createDataFrame(rows, "league long, o string, d string, h double, y double")
    found = {(x.league, x.entity): (x.off, x["def"], x.hfa) for x in efficiency.ridge_adjust(df, ["league"], "o", "d", "h", "y").collect()}
    for g in (1, 2, 3):
        mine = [x for x in rows if x[0] == g]
        names = sorted({x[1] for x in mine} | {x[2] for x in mine})
        a = np.zeros((len(mine), 2 * len(names) + 1))
        for i, x in enumerate(mine):
            a[i, names.index(x[1])], a[i, len(names) + names.index(x[2])], a[i, -1] = 1, -1, x[3]
        b = np.linalg.solve(a.T @ a + 5 * np.eye(a.shape[1]), a.T @ np.array([x[4] for x in mine]))
        for i, name in enumerate(names):
            assert np.allclose(found[g, name], (b[i], b[len(names) + i], b[-1]))
    adjusted = efficiency.adjusted(df, efficiency.ridge_adjust(df, ["league"], "o", "d", "h", "y"), ["league"], "o", "d", "h", "y")
    assert adjusted.count() == len(rows)
    assert adjusted.where("abs(adj_off + adj_def) < -1").count() == 0


def test_filter_step_equals_the_textbook() -> None:
    """An update within the limit is Kalman's; beyond it the innovation counts as 2.5 deviations with more noise."""
    f, g = (ratings.Filter(["a", "b"], 10.0, 2.5, 1.0) for _ in range(2))
    h = np.array([[1.0, 0, 0, -1, 0.5], [0, 1.0, -1, 0, -0.5]])
    rows = [{0: 1.0, 3: -1.0, 4: 0.5}, {1: 1.0, 2: -1.0, 4: -0.5}]
    z, _ = f.measure(rows, [20.0, 10.0], [100.0, 100.0])
    s = h @ g.cov @ h.T + 100 * np.eye(2)
    k = g.cov @ h.T @ np.linalg.inv(s)
    assert np.allclose(f.mean, g.mean + k @ (np.array([20.0, 10.0]) - h @ g.mean))
    assert np.allclose(f.cov, (np.eye(5) - k @ h) @ g.cov)
    assert np.all(np.abs(z) < 2.5)
    wild = ratings.Filter(["a", "b"], 10.0, 2.5, 1.0)
    z, _ = wild.measure(rows, [200.0, 10.0], [100.0, 100.0])
    r = np.diag([100 * (z[0] / 2.5) ** 2, 100.0])
    e = np.array([2.5 * np.sqrt(s[0, 0]), 10.0 - (h @ g.mean)[1]])
    assert np.allclose(wild.mean, g.mean + g.cov @ h.T @ np.linalg.inv(h @ g.cov @ h.T + r) @ e)
    wild.project()
    assert abs(wild.mean[:2].sum()) < 1e-9
    assert abs(wild.mean[2:4].sum()) < 1e-9


def test_filter_finds_planted_ratings(spark: SparkSession) -> None:
    r = random.Random(5)
    off, deff = ([r.gauss(0, 8) for _ in range(8)] for _ in range(2))
    games = []
    for i in range(400):
        a, b = r.sample(range(8), 2)
        games.append(("L", i, i, 1, i // 20, f"t{a}", f"t{b}", off[a] - deff[b] + 1.25 + r.gauss(0, 3), off[b] - deff[a] - 1.25 + r.gauss(0, 3), False))
    df = spark.createDataFrame(games, "league string, game long, ts long, season int, week int, home string, away string, home_value double, away_value double, neutral boolean")
    last = {}
    for x in sorted(ratings.joint_filter(df, noise=9.0, drift=0.01).collect(), key=lambda x: x.game):
        last[games[x.game][5]] = x.home_rating
    want = [off[i] + deff[i] for i in range(8)]
    assert np.corrcoef([last[f"t{i}"] for i in range(8)], want)[0, 1] > 0.98


def test_drain_keeps_keys_of_earlier_batches(spark: SparkSession, tmp_path) -> None:
    """Two runs over one place: the second batch does not name all keys; an empty stream gives no rows."""
    schema, source, at = "k string, i long, miss double", f"{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: captures.adaptive_alpha(spark.readStream.schema(schema).parquet(f"file://{source}"), "k", "i", F.col("miss"))
    spark.createDataFrame([], schema).write.parquet(f"file://{source}")
    assert captures.drain(stream(), "update", ["k"], at).count() == 0
    for rows in ([("a", 1, 1.0), ("b", 1, 0.0)], [("a", 2, 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        found = {x.k: (x.n, round(x.alpha, 6)) for x in captures.drain(stream(), "update", ["k"], at).collect()}
    assert found == {"a": (2, 0.06), "b": (1, 0.105)}


def test_calibration_slope_and_top_correlated(spark: SparkSession) -> None:
    r = random.Random(7)
    rows = []
    for _ in range(4000):
        x = r.gauss(0, 1)
        rows.append((1 / (1 + np.exp(-x)), float(r.random() < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))), x + r.gauss(0, 1), r.gauss(0, 1)))
    df = spark.createDataFrame([tuple(map(float, x)) for x in rows], "p double, y double, u double, v double")
    a, b = evaluation.calibration_slope(df, "p", "y")
    assert abs(a - 0.3) < 0.15
    assert abs(b - 0.8) < 0.15
    assert evaluation.top_correlated(df, ["v", "u", "p"], "y", 2) == ["p", "u"]
    gates = evaluation.bonferroni_gate(spark.createDataFrame([("a", 0.02), ("a", 0.03), ("b", 0.04)], "f string, q double"), ["f"], "q")
    assert {(x.f, x.limit, x.promoted) for x in gates.collect()} == {("a", 0.025, False), ("b", 0.05, True)}
