"""Work and memory that grow no faster than the tables: parts by rows, groups by part, one sort for all measures, rows dealt over tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmark.catalog import QUERIES
from chainmark.operators import betting, distribution, features, ranges, ratings

from .oracle import SF


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(ranges, "ROWS", 50)


def test_more_rows_make_more_parts(spark: SparkSession, small_parts: None) -> None:
    rows = ranges.ranged(spark.range(1000).select(F.lit("hot").alias("k"), "id"), ["k"], ["id"])
    assert rows.select(ranges.PART).distinct().count() >= 15
    assert max(r["count"] for r in rows.groupBy(ranges.PART).count().collect()) < 200
    assert ranges.dealt(rows).rdd.getNumPartitions() >= 15


def test_tiers_are_folded_by_part_not_by_key(spark: SparkSession, small_parts: None) -> None:
    """Many short keys and a hot one; a group is a part."""
    r = random.Random(7)
    rows = [(k, i, round(0.5 + r.random() / 2, 2)) for k in [None, *range(40)] for i in range(3)] + [(99, i, round(0.5 + r.random() / 2, 2)) for i in range(300)]
    found = betting.tier_history(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], ["i"], "v")
    assert "FlatMapCoGroupsInPandas [__part" in plan(found)
    step, names, want = betting._next_tiers, betting.NAMES, {}
    for k in {x[0] for x in rows}:
        now = len(names)
        for _, i, p in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            now = int(step(betting.np.array([p]))[0, now])
            want[k, i] = names[now]
    assert {(None if x.k is None or x.k != x.k else int(x.k), x.i): x.tier for x in found.collect()} == want


def test_entity_values_over_parts(spark: SparkSession, small_parts: None) -> None:
    """Means, weighted means and last-three differences of a hot entity equal plain loops; nulls are no games."""
    r = random.Random(5)
    rows = [(k, i, *(None if r.random() < 0.3 else round(r.uniform(-3, 3), 3) for _ in "xy")) for k, n in (("hot", 400), ("a", 2), (None, 3)) for i in range(n)] + [("none", 1, None, 1.5)]
    found = features.entity_values(spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(5), "k", ["i"], {"x": 6.5, "y": 4.0})
    # one window within parts, one over parts, whatever the number of measures
    assert plan(found).split("== Initial Plan ==")[-1].count("Window [") == 2
    got = {x.k: x for x in found.collect()}
    for k in {x[0] for x in rows}:
        for at, m, half in ((2, "x", 6.5), (3, "y", 4.0)):
            values = [x[at] for x in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]) if x[at] is not None]
            if not values:
                assert got[k][f"{m}_std"] is got[k][f"{m}_ewma"] is got[k][f"{m}_l3d"] is None
                continue
            a, ewma, mean = 1 - 0.5 ** (1 / half), values[0], sum(values) / len(values)
            for v in values[1:]:
                ewma += a * (v - ewma)
            assert got[k][f"{m}_std"] == pytest.approx(len(values) / (len(values) + 8) * mean)
            assert got[k][f"{m}_ewma"] == pytest.approx(ewma) and got[k][f"{m}_l3d"] == pytest.approx(sum(values[-3:]) / len(values[-3:]) - mean)


def test_covers_of_a_normal_margin_need_no_list(spark: SparkSession) -> None:
    """Differences of edges equal sums over the whole distribution, for whole, half and far lines."""
    rows = spark.createDataFrame([(m, s) for m in (-90.0, -30.2, 0.0, 2.5, 60.0) for s in (0.5, 14.0)], "mu double, sigma double").where("abs(mu) < 80 or sigma > 1")
    dist = distribution.pmf(F.col("mu"), F.col("sigma"))
    for line in (0.0, -3.0, 2.5, 79.0, -95.0):
        both = zip(distribution.cover(dist, F.lit(line)), distribution.normal_cover(F.col("mu"), F.col("sigma"), F.lit(line)), strict=True)
        names = [(a.alias(f"a{i}"), b.alias(f"b{i}")) for i, (a, b) in enumerate(both)]
        for x in rows.select(*[c for pair in names for c in pair]).collect():
            assert x.b0 == pytest.approx(x.a0, abs=1e-9) and x.b1 == pytest.approx(x.a1, abs=1e-9), line
    assert "transform" not in plan(QUERIES["margin_distribution"](spark, SF))
    assert QUERIES["kernel_distribution"](spark, SF).rdd.getNumPartitions() > 1


def test_roots_are_found_in_many_tasks(spark: SparkSession) -> None:
    """The table of parts is one block of one file; its rows are dealt out before the bisection."""
    assert QUERIES["devig_roots"](spark, SF).rdd.getNumPartitions() > 1


def test_leagues_filtered_together_equal_the_plain_filter(spark: SparkSession) -> None:
    """Leagues of different sizes and lengths in one group: each as by itself with dense products and projections."""
    r = random.Random(11)
    rows = []
    for league, (teams, n) in {"a": (6, 40), "b": (3, 60), "c": (2, 1), "d": (6, 25)}.items():
        for i in range(n):
            h, w = r.sample(range(teams), 2)
            rows.append((league, i, i // 2, 1 + i // 20, i // 3, f"t{h}", f"t{w}", 28 + r.gauss(0, 30), 21 + r.gauss(0, 10), i % 5 == 0))
    df = spark.createDataFrame(rows, "league string, game long, ts long, season int, week int, home string, away string, home_value double, away_value double, neutral boolean")
    found = ratings.joint_filter(df, 90.0, 0.5, 0.8)
    assert "league" not in plan(found).split("FlatMapGroupsInPandas [")[1].split("]")[0]
    got = {(x.league, x.game): x for x in found.collect()}
    for league in "abcd":
        games = [x for x in rows if x[0] == league]
        names = sorted({t for x in games for t in x[5:7]})
        f, n, season, week = ratings.Filter(names, 10.0, 2.5, 1.0), len(names), None, None
        for _, game, _, s, k, h, w, y, x, neutral in games:
            if season is not None and s != season:
                f.carry(0.8, 5.0)
            elif week is not None and k != week:
                f.drift(0.5)
            season, week, i, j, home = s, k, f.at[h], f.at[w], 0.0 if neutral else 0.5
            z, likelihood = f.measure([{i: 1.0, n + j: -1.0, 2 * n: home}, {j: 1.0, n + i: -1.0, 2 * n: -home}], [y, x], [90.0, 90.0])
            f.project()
            want = [f.mean[i] + f.mean[n + i], f.mean[j] + f.mean[n + j], max(0.0, f.cov[i, i] + f.cov[n + i, n + i]) ** 0.5, f.mean[-1], *z, likelihood]
            assert list(got[league, game])[2:] == pytest.approx(want, abs=1e-9)


def results(spark: SparkSession) -> DataFrame:
    """Leagues of two seasons; the last one plays in the first only."""
    r = random.Random(3)
    rows = [(f"L{k}", 100 * k + i, 1 + i // 16, *r.sample("abcd", 2), r.randrange(-9, 10), i % 4 == 0) for k in range(5) for i in range(16 if k == 4 else 30)]
    return spark.createDataFrame(rows, "league string, game long, season int, home string, away string, margin int, neutral boolean").withColumn("ts", F.timestamp_seconds(F.floor(F.col("game") % 100 / 2) * 86_400).cast("timestamp_ntz"))


def test_leagues_share_groups_and_points_their_rows(spark: SparkSession) -> None:
    games = results(spark)
    grid = ratings.elo_grid(games, [20, 30], [2.8])
    assert "Generate" not in plan(grid) and "league" not in plan(grid).split("FlatMapGroupsInPandas [")[1].split("]")[0]
    together = {(x.league, x.game): tuple(x)[2:] for x in ratings.elo(games).collect()}
    for k in range(5):  # a league by itself has the same ratings
        alone = ratings.elo(games.where(F.col("league") == f"L{k}")).collect()
        assert len(alone) == (16 if k == 4 else 30) and all(together[x.league, x.game] == tuple(x)[2:] for x in alone)


def test_steps_of_a_replay_group_leagues(spark: SparkSession) -> None:
    """Season by season as in one fold; a league without games keeps its state; only earlier instants are seen."""
    games = results(spark)
    want = {x.game: x.p_home for x in ratings.elo(games).collect()}
    state, group, got = spark.createDataFrame([], ratings.ELO_STATE), ratings.groups_of(games), {}
    for s in (1, 2):
        done = ranges.kept(ratings.elo_step(state, games.where(F.col("season") == s), group=group))
        got |= {x.game: x for x in done.where("game is not null").collect()}
        state = done.where("team is not null").select("league", "team", "rating", "season", "seen")
    step = plan(ratings.elo_step(state, games, group=group))
    assert "league" not in step.split("FlatMapCoGroupsInPandas [")[1].split("]")[0]
    assert {g: x.p_home for g, x in got.items()} == want
    assert {x.season for x in state.where("league = 'L4'").collect()} == {1} and state.where("league = 'L4'").count() > 1
    times = {x.game: (x.league, x.ts) for x in games.collect()}
    for g, x in got.items():
        assert x.seen_before == max((t for league, t in times.values() if league == times[g][0] and t < times[g][1]), default=None)
