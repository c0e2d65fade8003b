"""Team ratings that a season's games update one after the other.

A league is one sequence: its rows are games (thousands), not plays. Some dozens
of leagues are a group, and groups run beside each other; everything that is not
sequential stays outside.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELO_START, ELO_K, ELO_HOME, ELO_MARGIN = 1500.0, 30.0, 55.0, 2.8


def elo_expected(difference: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -difference / 400))


def _elo(pdf: pd.DataFrame, k: float, home: float, factor: float, carry: float, before: dict[str, tuple[dict[str, float], int | None]] | None = None) -> pd.DataFrame:
    """Ratings of any number of leagues, by league and in order.

    ``before`` has, by league, what its teams have before the first game and
    that season; it is left as they have it after the last.
    """
    pdf = pdf.sort_values(["league", "ts", "game"], kind="stable")
    before = {} if before is None else before
    out, last, rating, season = [], None, {}, None
    for league, now, h, w, margin, neutral in zip(*[pdf[c].tolist() for c in ("league", "season", "home", "away", "margin", "neutral")], strict=True):
        if not out or league != last:
            if out:
                before[last] = rating, season
            last, (rating, season) = league, before.get(league, ({}, None))
        if season is not None and now != season and rating:
            middle = sum(rating.values()) / len(rating)
            for t, r in rating.items():
                rating[t] = r + carry * (middle - r)
        season = now
        a, b = rating.get(h, ELO_START), rating.get(w, ELO_START)
        gap = a - b + (0.0 if neutral else home)
        p = 1 / (1 + 10 ** (-gap / 400))
        won = 0.5 if margin == 0 else float(margin > 0)
        lead = gap if margin > 0 else -gap
        shift = k * math.log(abs(margin) + 1) * factor / (lead * 0.001 + factor) * (won - p) if margin else k * (won - p)
        rating[h], rating[w] = a + shift, b - shift
        out.append((a, b, p, a + shift, b - shift))
    if out:
        before[last] = rating, season
    found = pd.DataFrame(out, columns=["home_before", "away_before", "p_home", "home_after", "away_after"])
    return pd.concat([pdf[["league", "game"]].reset_index(drop=True), found], axis=1)


#: Leagues of a group, about: a group costs as much as a few thousand games.
TOGETHER = 64
_GROUP = "__group"


def groups_of(games: DataFrame) -> Column:
    """The group of a row's league: about TOGETHER leagues each, so groups grow in number with the table, not in size."""
    leagues = games.agg(F.approx_count_distinct("league")).first()[0]
    return F.pmod(F.xxhash64("league"), F.lit(max(1, -(-leagues // TOGETHER)))).alias(_GROUP)


def elo(games: DataFrame, k: float = ELO_K, home: float = ELO_HOME, factor: float = ELO_MARGIN, carry: float = 1 / 3) -> DataFrame:
    """History of (league, game, ts, season, home, away, margin, neutral): ratings before and after each game."""
    run = lambda pdf: _elo(pdf, k, home, factor, carry)
    return games.groupBy(groups_of(games)).applyInPandas(run, "league string, game long, home_before double, away_before double, p_home double, home_after double, away_after double")


ELO_STATE = "league string, team string, rating double, season int, seen timestamp_ntz"


def elo_step(state: DataFrame, games: DataFrame, k: float = ELO_K, home: float = ELO_HOME, factor: float = ELO_MARGIN, carry: float = 1 / 3, group: Column | None = None) -> DataFrame:
    """Ratings of all leagues through ``games`` (of one season): a row a game with what was known before it, and ELO_STATE rows with ``team``.

    ``group`` is as from ``groups_of``, for games and state alike.
    """

    def run(key: tuple, some: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        for league, team, rating, season in zip(*[before[c].tolist() for c in ("league", "team", "rating", "season")], strict=True):
            known.setdefault(league, ({}, int(season)))[0][team] = rating
        seen = before.groupby("league")["seen"].max()
        out = _elo(some, k, home, factor, carry, known)[["league", "game", "home_before", "away_before", "p_home"]]
        # strictly earlier results only: games of one instant do not know each other's time
        times = some[["league", "ts"]].drop_duplicates().sort_values(["league", "ts"])
        times["seen_before"] = times.groupby("league")["ts"].shift().fillna(times["league"].map(seen))
        out = out.merge(some[["league", "game", "ts"]].drop_duplicates(["league", "game"]), on=["league", "game"], how="left").merge(times, on=["league", "ts"], how="left").drop(columns="ts")
        seen = pd.concat([seen, some.groupby("league")["ts"].max()]).groupby(level=0).max()
        rows = [(league, team, rating, season) for league, (teams, season) in known.items() for team, rating in teams.items()]
        last = pd.DataFrame(rows, columns=["league", "team", "rating", "season"])
        both = pd.concat([out, last.assign(seen=last["league"].map(seen))], ignore_index=True)
        both["game"], both["season"] = both["game"].astype("Int64"), both["season"].astype("Int64")
        both["seen"], both["seen_before"] = pd.to_datetime(both["seen"]), pd.to_datetime(both["seen_before"])
        return both[names]

    schema = f"{ELO_STATE}, game long, home_before double, away_before double, p_home double, seen_before timestamp_ntz"
    names = [f.split()[0] for f in schema.split(", ")]
    group = groups_of(games) if group is None else group
    return games.groupBy(group).cogroup(state.groupBy(group)).applyInPandas(run, schema)


def elo_grid(games: DataFrame, ks: list[float], factors: list[float]) -> DataFrame:
    """(k, factor, n, log_loss) of every grid point over all leagues; groups of leagues run in parallel, each at every point."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        margin = pdf.sort_values(["league", "ts", "game"], kind="stable")["margin"].to_numpy()
        out = []
        for k in ks:
            for factor in factors:
                p = _elo(pdf, float(k), ELO_HOME, float(factor), 1 / 3)["p_home"].to_numpy()
                q = np.clip(np.where(margin > 0, p, 1 - p)[margin != 0], 1e-15, 1)
                out.append((float(k), float(factor), len(q), float(-np.log(q).sum())))
        return pd.DataFrame(out, columns=["k", "factor", "n", "loss"])

    each = games.groupBy(groups_of(games)).applyInPandas(score, "k double, factor double, n long, loss double")
    return each.groupBy("k", "factor").agg(F.sum("n").alias("n"), F.try_divide(F.sum("loss"), F.sum("n")).alias("log_loss"))


class Filter:
    """Joint Gaussian state of a league: offence and defence of every team and home advantage."""

    def __init__(self, teams: list[str], prior_sd: float, home_mean: float, home_sd: float) -> None:
        self.at = {t: i for i, t in enumerate(teams)}
        n = len(teams)
        self.mean, self.cov = np.zeros(2 * n + 1), np.diag([prior_sd**2] * (2 * n) + [home_sd**2])
        self.mean[-1] = home_mean

    def drift(self, variance: float) -> None:
        np.einsum("ii->i", self.cov)[:-1] += variance

    def carry(self, share: float, variance: float) -> None:
        """Between seasons: towards the league's mean, with more doubt."""
        n = len(self.at)
        for part in (slice(0, n), slice(n, 2 * n)):
            self.mean[part] = share * self.mean[part] + (1 - share) * self.mean[part].mean()
        self.cov[:-1, :] *= share
        self.cov[:, :-1] *= share
        self.drift(variance)

    def measure(self, rows: list[dict[int, float]], y: list[float], noise: list[float], clip: float = 2.5) -> tuple[np.ndarray, float]:
        """(z of every row, log likelihood) of the joint measurement y = H x.

        Innovations are clipped at ``clip`` predicted deviations, and clipped
        rows are trusted less by (z / clip) ** 2; the covariance is updated in
        Joseph's form. The likelihood is that of the raw innovations.
        """
        h = np.zeros((len(rows), len(self.mean)))
        for i, row in enumerate(rows):
            h[i, list(row)] = list(row.values())
        ph, r = self.cov @ h.T, np.array(noise)
        s = h @ ph + np.diag(r)
        e, sd = np.array(y) - h @ self.mean, np.sqrt(np.maximum(np.diag(s), 1e-18))
        z = e / sd
        likelihood = -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + float(e @ np.linalg.solve(s, e)))
        r = r * np.where(np.abs(z) > clip, np.abs(z) / clip, 1.0) ** 2
        gain = np.linalg.solve(h @ ph + np.diag(r), ph.T).T
        self.mean = self.mean + gain @ (np.clip(z, -clip, clip) * sd)
        left = np.eye(len(self.mean)) - gain @ h
        self.cov = left @ self.cov @ left.T + (gain * r) @ gain.T
        self.cov = (self.cov + self.cov.T) / 2
        return z, likelihood

    def project(self) -> None:
        """League means of offence and of defence to zero; only differences are identified."""
        n = len(self.at)
        p = np.eye(2 * n + 1)
        for part in (slice(0, n), slice(n, 2 * n)):
            p[part, part] -= 1 / n
        self.mean, self.cov = p @ self.mean, p @ self.cov @ p.T


#: Doubles of the covariances that are updated together.
HELD = 1 << 22


def _filtered(pdf: pd.DataFrame, noise: float, drift: float, share: float) -> pd.DataFrame:
    """The joint filter of many leagues; leagues of like size are updated together, game by game."""
    pdf = pdf.sort_values(["league", "ts", "game"], kind="stable").reset_index(drop=True)
    code = pd.factorize(pdf["league"], use_na_sentinel=False)[0]
    sides = pd.DataFrame({"c": np.concatenate([code, code]), "t": pd.concat([pdf["home"], pdf["away"]], ignore_index=True)})
    teams = sides.drop_duplicates().sort_values(["c", "t"])
    place = sides.merge(teams.assign(at=teams.groupby("c").cumcount()), on=["c", "t"], how="left")["at"].to_numpy()
    pdf["__i"], pdf["__j"] = place[: len(pdf)], place[len(pdf) :]
    n = teams.groupby("c").size().to_numpy()
    first = np.searchsorted(code, np.arange(len(n)))
    count = np.diff(np.append(first, len(pdf)))
    out = np.empty((len(pdf), 7))
    order, at = np.argsort(n, kind="stable"), 0
    while at < len(order):
        some = order[at:]
        # as many leagues as fit with the largest of them
        fit = max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * (2.0 * n[some] + 1) ** 2, HELD, side="right")))
        some = some[:fit][np.argsort(-count[order[at : at + fit]], kind="stable")]
        _together(pdf, first[some], count[some], n[some], noise, drift, share, out)
        at += fit
    found = pd.DataFrame(out, columns=["home_rating", "away_rating", "home_sd", "hfa", "z_home", "z_away", "log_likelihood"])
    return pd.concat([pdf[["league", "game"]], found], axis=1)


def _together(pdf: pd.DataFrame, first: np.ndarray, count: np.ndarray, n: np.ndarray, noise: float, drift: float, share: float, out: np.ndarray, prior_sd: float = 10.0, home_mean: float = 2.5, home_sd: float = 1.0, clip: float = 2.5) -> None:
    """``Filter`` over leagues side by side, longest first; smaller leagues are padded with teams that nothing moves.

    Centred states stay centred under centred updates, and noise d on every team
    is d (I - J / n) once centred, so a game is one update of rank four instead of
    products with projections. The prior is noise before the first game.
    """
    most, number = int(n.max()), len(n)
    real = np.arange(most) < n[:, None]
    both = np.concatenate([real, real, np.zeros((number, 1), bool)], axis=1).astype(float)
    mean, cov = np.zeros((number, 2 * most + 1)), np.zeros((number, 2 * most + 1, 2 * most + 1))
    mean[:, -1], cov[:, -1, -1] = home_mean, home_sd**2
    columns = [pdf[c].to_numpy() for c in ("__i", "__j", "season", "week")]
    values = [pdf[c].to_numpy(float) for c in ("home_value", "away_value")]
    venue = np.where(pdf["neutral"].to_numpy(bool), 0.0, 0.5)
    season = week = None
    spread = np.zeros((number, 2 * most + 1, 4))
    for step in range(int(count[0])):
        m = int(np.searchsorted(-count, -step, side="left"))
        game, a = first[:m] + step, np.arange(m)
        i, j, now, at = (c[game] for c in columns)
        h, size, p = venue[game][:, None], n[:m].astype(float), cov[:m]
        if season is None:
            d = np.full(m, prior_sd**2)
        else:
            over = now != season[:m]
            d = np.where(over, drift * 10, np.where(at != week[:m], drift, 0.0))
            if over.any():
                k = np.flatnonzero(over)
                mean[k, :-1] *= share
                cov[k, :-1, :] *= share
                cov[k, :, :-1] *= share
        season, week = now, at
        one = p[a, i] - p[a, most + j] + h * p[a, -1]
        two = p[a, j] - p[a, most + i] - h * p[a, -1]
        for ph, x, y in ((one, i, j), (two, j, i)):
            ph[a, x] += d
            ph[a, most + y] -= d
        h = h[:, 0]
        onto = lambda v: (v[a, i] - v[a, most + j] + h * v[:, -1], v[a, j] - v[a, most + i] - h * v[:, -1])  # noqa: B023, E731
        (s11, s12), s22 = onto(one), onto(two)[1]
        e = [y[game] - x for y, x in zip(values, onto(mean[:m]), strict=True)]
        t11, t22 = s11 + noise, s22 + noise
        sd = np.sqrt(np.maximum(t11, 1e-18)), np.sqrt(np.maximum(t22, 1e-18))
        z = e[0] / sd[0], e[1] / sd[1]
        det = t11 * t22 - s12 * s12
        likelihood = -0.5 * (2 * math.log(2 * math.pi) + np.log(det) + (t22 * e[0] ** 2 - 2 * s12 * e[0] * e[1] + t11 * e[1] ** 2) / det)
        u11, u22 = (s + noise * np.where(np.abs(x) > clip, np.abs(x) / clip, 1.0) ** 2 for s, x in zip((s11, s22), z, strict=True))
        e = [np.clip(x, -clip, clip) * y for x, y in zip(z, sd, strict=True)]
        # square root of what the two rows tell: gain times innovation, and its outer product off the covariance
        w = spread[:m]
        root, slope = np.sqrt(u11), s12 / u11
        low = np.sqrt(u22 - slope * s12)
        w[:, :, 0] = one / root[:, None]
        w[:, :, 1] = (two - slope[:, None] * one) / low[:, None]
        for part in (slice(0, most), slice(most, 2 * most)):
            w[:, part, :2] -= real[:m, :, None] * (w[:, part, :2].sum(axis=1) / size[:, None])[:, None, :]
        edge = real[:m] * np.sqrt(d / size)[:, None]
        w[:, :most, 2], w[:, most : 2 * most, 3] = edge, edge
        mean[:m] += w[:, :, 0] * (e[0] / root)[:, None] + w[:, :, 1] * ((e[1] - slope * e[0]) / low)[:, None]
        p -= w @ w.transpose(0, 2, 1)
        np.einsum("lii->li", p)[...] += both[:m] * d[:, None]
        x = mean[:m]
        out[game] = np.stack([x[a, i] + x[a, most + i], x[a, j] + x[a, most + j], np.sqrt(np.maximum(0.0, p[a, i, i] + p[a, most + i, most + i])), x[:, -1], *z, likelihood], axis=1)


def joint_filter(games: DataFrame, noise: float = 100.0, drift: float = 0.5, share: float = 0.8) -> DataFrame:
    """Kalman filter over (league, game, ts, season, week, home, away, home_value, away_value, neutral).

    The full covariance lives through the whole sequence, so cross-team terms are kept.
    """
    run = lambda pdf: _filtered(pdf, noise, drift, share)
    return games.groupBy(groups_of(games)).applyInPandas(run, "league string, game long, home_rating double, away_rating double, home_sd double, hfa double, z_home double, z_away double, log_likelihood double")
