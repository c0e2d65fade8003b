"""Growing leagues: the update against dense textbook matrices, planted ratings of teams that arrive late, planted noise found."""

from __future__ import annotations

import math
import types

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import leagues

NAN = math.nan


def game(i: int, season: int, week: int, home: str, away: str, **more: object) -> dict:
    g = {"league": "L", "season": season, "week": week, "game": i, "ts": np.datetime64("2020-01-01") + np.timedelta64(10 * week + 400 * season, "D"), "home": home, "away": away, "home_epa": NAN, "away_epa": NAN, "home_plays": 70.0, "away_plays": 70.0, "home_st": NAN, "away_st": NAN, "pace": NAN, "margin": NAN, "neutral": False, "home_lower": False, "away_lower": False}
    return g | more


def frame(spark: SparkSession, games: list[dict]):
    names = [f.split()[0] for f in leagues.GAME.split(", ")]

    def plain(n: str, x: object) -> object:
        x = x.astype("datetime64[us]").item() if n == "ts" else getattr(x, "item", lambda: x)()
        return None if isinstance(x, float) and x != x else x

    rows = [tuple(plain(n, g[n]) for n in names) for g in games]
    return spark.createDataFrame(rows, leagues.GAME)


def test_update_equals_dense_matrices() -> None:
    r = np.random.default_rng(3)
    c = leagues.Config()
    league = leagues.League(c)
    league.admit(["a", "b", "c"], {"b": (np.array([0.1, -0.1, 0.02, 0.0]), np.full(4, 0.02))})
    for i in range(6):
        league.week({"a": 5.0} if i == 2 else {})
        g = types.SimpleNamespace(**game(i, 1, i, "abc"[i % 3], "abc"[(i + 1) % 3], home_epa=r.normal(0, 0.3), away_epa=r.normal(0, 0.3), home_st=0.1, away_st=-0.2, pace=75.0, margin=float(r.integers(-40, 40)), neutral=i == 4))
        rows = league.rows(g)
        n = len(league.mean)
        h = np.zeros((len(rows), n))
        for k, (_, places, _, _) in enumerate(rows):
            for at, v in places.items():
                h[k, at] = v
        y, R = np.array([x[2] for x in rows]), np.diag([x[3] for x in rows])
        m0, p0 = league.mean.copy(), league.cov.copy()
        s = h @ p0 @ h.T + R
        sd = np.sqrt(np.diag(s))
        z = (y - h @ m0) / sd
        R = R * np.where(abs(z) > 2.5, abs(z) / 2.5, 1) ** 2
        k = p0 @ h.T @ np.linalg.inv(h @ p0 @ h.T + R)
        left = np.eye(n) - k @ h
        mean, cov = m0 + k @ (np.clip(z, -2.5, 2.5) * sd), left @ p0 @ left.T + k @ R @ k.T
        proj = np.eye(n)
        for d in (0, 1):
            some = list(range(2 + d, n, leagues.BLOCK))
            proj[np.ix_(some, some)] -= 1 / len(some)
        league.measure(rows)
        assert [x[0] for x in rows] == ["home_epa", "away_epa", "st", "pace", "margin"]
        assert np.allclose(league.mean, proj @ mean, atol=1e-12) and np.allclose(league.cov, proj @ cov @ proj.T, atol=1e-12)
        assert abs(league.mean[2 :: leagues.BLOCK].mean()) < 1e-12


def test_admission_keeps_what_is_known() -> None:
    league = leagues.League(leagues.Config())
    league.admit(["a", "b"], {})
    league.measure([("margin", {0: 80.0, 2: 80.0, 8: -80.0}, 10.0, 324.0)])
    mean, cov = league.mean.copy(), league.cov.copy()
    league.admit(["x"], {"x": (np.zeros(4), np.full(4, 0.5))})
    assert league.at == {"a": 0, "b": 1, "x": 2} and league.cov.shape == (17, 17)
    # no team's slots but those that the centring moves have changed
    assert np.allclose(league.cov[4:7, 4:7], cov[4:7, 4:7]) and np.allclose(league.mean[[0, 1, 4, 5, 6]], mean[[0, 1, 4, 5, 6]])
    assert np.linalg.eigvalsh(league.cov).min() > -1e-12


def planted(seed: int, scale: float = 1.0, teams: int = 10, weeks: int = 10, seasons: int = 2) -> tuple[list[dict], dict]:
    """Two seasons; the last three teams only play in the second, and one opponent is of the lower division."""
    r = np.random.default_rng(seed)
    c = leagues.Config()
    truth = {f"t{i}": r.normal(0, 0.15, 2) for i in range(teams)}
    out, i = [], 0
    for s in range(1, seasons + 1):
        names = [f"t{k}" for k in range(teams if s > 1 else teams - 3)]
        for w in range(1, weeks + 1):
            for t in truth:
                truth[t] = truth[t] + r.normal(0, math.sqrt(0.0025 * scale), 2)
            order = list(r.permutation(names))
            for h, a in zip(order[::2], order[1::2], strict=False):
                i += 1
                net = truth[h][0] - truth[a][1] - truth[a][0] + truth[h][1] + 0.025
                out.append(game(i, s, w, h, a, home_epa=truth[h][0] - truth[a][1] + 0.025 + r.normal(0, 0.12), away_epa=truth[a][0] - truth[h][1] + r.normal(0, 0.12), margin=80 * net + r.normal(0, 5.0), pace=70.0))
    return out, truth


def test_recovers_planted_ratings_of_late_teams(spark: SparkSession) -> None:
    games, truth = planted(5)
    games.append(game(9000, 2, 10, "t1", "small", home_epa=0.2, away_lower=True))
    found = leagues.kept(leagues.run(frame(spark, games)))
    assert found.count() == len(games)
    last = {}
    for g in found.orderBy("season", "week", "game").collect():
        last[g.home], last[g.away] = g.home_rating, g.away_rating
    assert last["small"] is None
    names = sorted(truth)
    want = np.array([truth[t].sum() for t in names])
    got = np.array([last[t] for t in names])
    assert np.corrcoef(want, got)[0, 1] > 0.9
    late = [names.index(f"t{i}") for i in (7, 8, 9)]
    assert np.abs((got - got.mean()) - (want - want.mean()))[late].max() < 0.3
    assert found.where("season = 1 and (home in ('t7', 't8', 't9') or away in ('t7', 't8', 't9'))").count() == 0


def test_events_and_priors_change_doubt_and_level(spark: SparkSession) -> None:
    games = frame(spark, [game(1, 1, 1, "a", "b", margin=7.0), game(2, 1, 2, "c", "d", margin=3.0)])
    plain = {r.game: r for r in leagues.run(games).collect()}
    priors = spark.createDataFrame([("L", 1, "a", 0.2, 0.1, 0.0, 0.0, 0.01)], "league string, season int, team string, off_epa double, def_epa double, st_value double, pace double, var double")
    events = spark.createDataFrame([("L", 1, 1, "b", "qb_change"), ("L", 1, 1, "c", "7")], "league string, season int, week int, team string, event string")
    told = {r.game: r for r in leagues.run(games, priors=priors).collect()}
    assert told[1].home_rating > plain[1].home_rating and told[1].home_sd < plain[1].home_sd
    told = {r.game: r for r in leagues.run(games, events=events).collect()}
    assert told[1].away_sd > plain[1].away_sd and told[2].home_sd > plain[2].home_sd


def test_order_of_rows_changes_nothing(spark: SparkSession) -> None:
    games, _ = planted(6, teams=6, weeks=4)
    a = leagues.run(frame(spark, games)).orderBy("game").collect()
    b = leagues.run(frame(spark, games[::-1]).repartition(3)).orderBy("game").collect()
    assert a == b


def test_tuning_finds_the_planted_noise(spark: SparkSession) -> None:
    """Three leagues whose ratings drift sixteen times as much as assumed: the search leaves the small scales."""
    rows = []
    for k in range(3):
        games, _ = planted(20 + k, scale=16.0, teams=8, weeks=8, seasons=1)
        rows += [g | {"league": f"L{k}"} for g in games]
    games = leagues.kept(frame(spark, rows))
    best, score, trials = leagues.tune(games, scales=(0.25, 1.0, 16.0))
    assert best.noise["off_epa"] == pytest.approx(0.0025 * 16) and len(trials) == 15
    assert score == max(t["log_likelihood"] for t in trials)
    alone = leagues.run(games, best).agg(F.sum("log_likelihood")).first()[0]
    assert math.isclose(alone, score, rel_tol=1e-9)


def alone(c: leagues.Config, games: list[dict], priors: dict, events: dict) -> tuple[dict, dict]:
    """A league by itself, game by game: (numbers and names by game, (teams, mean, covariance) by season it plays in)."""
    league, rows, states = leagues.League(c), {}, {}
    for s in range(min(g["season"] for g in games), 4):
        some = sorted((g for g in games if g["season"] == s), key=lambda g: (g["ts"], g["game"]))
        if rows:
            league.between_seasons(priors.get(s, {}))
        league.admit(sorted({g[n] for g in some for n in ("home", "away") if not g[f"{n}_lower"]}), priors.get(s, {}))
        week = None
        for g in map(lambda g: types.SimpleNamespace(**g), some):
            if g.week != week:
                league.week(events.get((s, g.week), {}))
                week = g.week
            used = league.rows(g)
            m, d, z, likelihood = league.measure(used) if used else ([], [], [], 0.0)
            own = []
            for t, lower in ((g.home, g.home_lower), (g.away, g.away_lower)):
                b = None if lower else league.base(t)
                own.append((NAN, NAN) if b is None else (league.mean[b] + league.mean[b + 1], math.sqrt(max(0.0, league.cov[b, b] + league.cov[b + 1, b + 1] + 2 * league.cov[b, b + 1]))))
            last = (m[-1], d[-1]) if used and used[-1][0] == "margin" else (NAN, NAN)
            rows[g.game] = [*last, likelihood, own[0][0], own[1][0], own[0][1], own[1][1], league.mean[0], league.mean[1], *z], [x[0] for x in used]
        if some:
            states[s] = list(league.at), league.mean.copy(), (league.cov + league.cov.T) / 2
    return rows, states


def test_leagues_together_equal_each_by_itself(spark: SparkSession) -> None:
    """Leagues of different sizes and lengths in one group, with gaps of every kind, all seasons in one job and season by season."""
    r, c, rows = np.random.default_rng(8), leagues.Config(), []
    for league, (teams, n, seasons) in {"a": (7, 30, (1, 2, 3)), "b": (3, 50, (1, 3)), "c": (2, 4, (2, 3)), "d": (12, 25, (1, 2)), "one": (1, 6, (1, 2))}.items():
        for s in seasons:
            names = [f"t{k}" for k in range(max(1, teams - 2 * (s == 1)))]
            for k in range(n):
                h, a = r.choice(names, 2, replace=False) if len(names) > 1 else (names[0], "far")
                gap = lambda x: NAN if k % 7 == 3 or r.random() < 0.2 else float(x)  # noqa: B023, E731
                values = dict(home_epa=gap(r.normal(0, 0.4)), away_epa=gap(r.normal(0, 0.4)), home_plays=gap(r.integers(0, 90)), home_st=gap(r.normal(0, 0.3)), away_st=gap(r.normal(0, 0.3)), pace=gap(r.integers(55, 85)), margin=gap(r.integers(-60, 60)))
                rows.append(game(len(rows), s, k // 4, str(h), str(a), league=league, neutral=k % 5 == 0, home_lower=bool(len(names) > 1 and r.random() < 0.1), away_lower=bool(len(names) == 1 or r.random() < 0.1), **values))
    priors = [("a", 1, "t1", 0.2, 0.1, 0.0, 0.05, 0.01), ("a", 2, "t1", 0.1, 0.0, 0.1, 0.0, 0.02), ("b", 3, "t2", -0.2, 0.1, 0.0, 0.0, 0.03)]
    events = [("a", 1, 2, "t3", "qb_change"), ("a", 1, 2, "t3", "3"), ("b", 3, 0, "t0", "7"), ("d", 2, 5, "t11", "coordinator_change"), ("d", 1, 0, "t11", "9")]
    p = spark.createDataFrame(priors, "league string, season int, team string, off_epa double, def_epa double, st_value double, pace double, var double")
    e = spark.createDataFrame(events, "league string, season int, week int, team string, event string")
    df = frame(spark, rows)
    found = leagues.replay(df, c, p, e, covariance=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow [__group" in plan and plan.count("Exchange") == 1  # one job, groups of leagues
    whole, state, steps = found.collect(), leagues.start(spark), []
    for s in (1, 2, 3):
        done = leagues.kept(leagues.season(state, *[x.where(F.col("season") == s) if x is not c else c for x in (df, c, p, e)]))
        state, steps = leagues.state_of(done), steps + done.collect()
    for league in "a", "b", "c", "d", "one":
        told: dict = {}
        for _, s, week, t, kind in (x for x in events if x[0] == league):
            factors = told.setdefault((s, week), {})
            factors[t] = factors.get(t, 1.0) * (leagues.EVENTS[kind] if kind in leagues.EVENTS else float(kind))
        given = {s: {x[2]: (np.array(x[3:7]), np.full(4, x[7])) for x in priors if x[:2] == (league, s)} for s in (1, 2, 3)}
        want, states = alone(c, [g for g in rows if g["league"] == league], given, told)
        for some in (whole, steps):
            got = {x.game: x for x in some if x.teams is None and x.league == league}
            assert got.keys() == want.keys()
            for g, (numbers, names) in want.items():
                x = got[g]
                mine = [x.mu, x.sd, x.log_likelihood, x.home_rating, x.away_rating, x.home_sd, x.away_sd, x.hfa, x.scoring, *x.z]
                assert x.names == names and [NAN if v is None else v for v in mine] == pytest.approx(numbers, abs=1e-9, nan_ok=True), (league, g)
        mine = {x.season: x for x in whole if x.teams is not None and x.league == league}
        assert mine.keys() == states.keys()
        for s, (teams, mean, cov) in states.items():
            assert mine[s].teams == teams and mine[s].asymmetry < 1e-12
            assert np.allclose(mine[s]["mean"], mean, atol=1e-9) and np.allclose(np.reshape(mine[s]["cov"], cov.shape), cov, atol=1e-9)


def test_lots_of_leagues_are_bounded() -> None:
    some = [leagues.Known(str(k), np.zeros(2), np.eye(2), {str(t): t for t in range(n)}) for k, n in enumerate([3, 400, 20, 3, 25, 150])]
    lots = leagues._lots(some)
    assert sorted(k.league for lot in lots for k in lot) == sorted(k.league for k in some)
    assert all(len(lot) == 1 or len(lot) * (2 + 3 * max(len(k.teams) for k in lot)) ** 2 <= leagues.HELD for lot in lots) and len(lots) > 1
