"""Gaussian ratings of leagues that grow, some dozens of leagues side by side in a task.

A league's state is a row: its teams, the joint mean and the joint covariance of
home advantage, scoring environment and every team's block (``DIMS`` and its own
home advantage). Teams are appended, so admission only adds a block. A group of
leagues goes through all its seasons in one task (``replay``), or through one
season from states that are given (``season``); its leagues are updated together,
each by its next game. What comes out is the states and one row a game.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept

# State dimensions, their weekly noise, and what events multiply it by.
DIMS = ("off_epa", "def_epa", "st_value", "pace")
NOISE = {"off_epa": 0.0025, "def_epa": 0.0025, "st_value": 0.0015, "pace": 0.0004}
EVENTS = {"qb_change": 5.0, "coordinator_change": 3.0}
HOME, SCORING = 0, 1
BLOCK = len(DIMS) + 1


@dataclass(frozen=True)
class Config:
    """Priors, noise of the five measurements, carry between seasons, and the pooled lower division."""

    noise: dict = field(default_factory=lambda: dict(NOISE))
    prior_mean: float = 0.0
    prior_var: float = 0.04
    clip: float = 2.5
    epa_sd: float = 0.12
    st_sd: float = 0.20
    pace_sd: float = 0.15
    margin_sd: float = 18.0
    ref_plays: float = 70.0
    points: float = 80.0
    home: tuple = (0.025, 0.0004, 1e-6)
    own_home: tuple = (0.0, 1e-4, 1e-7)
    scoring: tuple = (0.0, 0.01, 1e-5)
    lower_mean: float = -0.05
    lower_var: float = 0.25
    regress: float = 0.30
    inflate: float = 0.02

    def scaled(self, **scales: float) -> Config:
        return replace(self, noise={d: v * scales.get(d, 1.0) for d, v in self.noise.items()})


class League:
    """Joint state of one league, game by game; ``_together`` does the same to many leagues at once."""

    def __init__(self, c: Config, teams: list[str] | None = None, mean: np.ndarray | None = None, cov: np.ndarray | None = None) -> None:
        self.c, self.at = c, {t: i for i, t in enumerate(teams or [])}
        self.mean = np.array([c.home[0], c.scoring[0]]) if mean is None else mean
        self.cov = np.diag([c.home[1], c.scoring[1]]) if cov is None else cov

    def base(self, team: str) -> int:
        return 2 + BLOCK * self.at[team]

    def admit(self, teams: list[str], priors: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Appends a block for every new team: its prior if it has one, no covariance with the rest."""
        for t in teams:
            if t in self.at:
                continue
            n = len(self.mean)
            mean, var = priors.get(t, (np.full(len(DIMS), self.c.prior_mean), np.full(len(DIMS), self.c.prior_var)))
            cov = np.zeros((n + BLOCK, n + BLOCK))
            cov[:n, :n] = self.cov
            cov[range(n, n + BLOCK), range(n, n + BLOCK)] = [*var, self.c.own_home[1]]
            self.mean, self.cov = np.concatenate([self.mean, mean, [self.c.own_home[0]]]), cov
            self.at[t] = len(self.at)
        self.centre()

    def _slots(self, i: int) -> slice:
        return slice(2 + i, len(self.mean), BLOCK)

    def centre(self) -> None:
        """Offence and defence of all teams to mean zero, exactly; rows and columns lose their means, no product of matrices."""
        if len(self.at) < 2:
            return
        for i in (0, 1):
            some, n = self._slots(i), len(self.at)
            self.mean[some] -= self.mean[some].sum() / n
            self.cov[some] -= self.cov[some].sum(axis=0) / n
            self.cov[:, some] -= self.cov[:, some].sum(axis=1, keepdims=True) / n

    def between_seasons(self, priors: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Each team's block by itself from here: its new prior if it has one, else towards the prior mean with more doubt."""
        c, keep = self.c, 1 - self.c.regress
        cov = np.zeros_like(self.cov)
        cov[:2, :2] = self.cov[:2, :2]
        for at, (prior, _, _), more in ((HOME, c.home, 0.1), (SCORING, c.scoring, 0.05)):
            self.mean[at] = keep * self.mean[at] + c.regress * prior
            cov[at, at] += c.inflate * more
        for t in self.at:
            own, last = slice(self.base(t), self.base(t) + len(DIMS)), self.base(t) + len(DIMS)
            if t in priors:
                self.mean[own], cov[own, own] = priors[t][0], np.diag(priors[t][1])
            else:
                self.mean[own] = keep * self.mean[own] + c.regress * c.prior_mean
                cov[own, own] = self.cov[own, own] + c.inflate * np.eye(len(DIMS))
            self.mean[last] *= keep
            cov[last, last] = self.cov[last, last] + c.inflate * 0.05
        self.cov = cov

    def week(self, events: dict[str, float]) -> None:
        """One week's noise for all teams; ``events``: factor by team."""
        d = np.einsum("ii->i", self.cov)
        for i, name in enumerate(DIMS):
            d[self._slots(i)] += self.c.noise[name]
        d[self._slots(BLOCK - 1)] += self.c.own_home[2]
        d[HOME] += self.c.home[2]
        d[SCORING] += self.c.scoring[2]
        for t, factor in events.items():
            if t in self.at:
                for i, name in enumerate(DIMS):
                    d[self.base(t) + i] += self.c.noise[name] * (factor - 1)

    def rows(self, g) -> list[tuple[str, dict[int, float], float, float]]:
        """(name, non-zero places, value, variance) of a game's measurements, up to five."""
        c, out = self.c, []
        h, a = (None if g.home_lower else self.base(g.home)), (None if g.away_lower else self.base(g.away))
        venue = {} if g.neutral or h is None else {HOME: 1.0, h + BLOCK - 1: 1.0}
        sides = (("home_epa", h, a, g.home_epa, g.home_plays, venue), ("away_epa", a, h, g.away_epa, g.away_plays, {}))
        for name, own, other, y, plays, place in sides:
            if own is None or math.isnan(y):
                continue
            var = c.epa_sd**2 * c.ref_plays / max(1.0, c.ref_plays if math.isnan(plays) else plays)
            row = {own: 1.0, SCORING: 1.0} | place
            if other is None:  # the lower division is one pooled opponent of known strength
                out.append((name, row, y - c.lower_mean, var + c.lower_var))
            else:
                out.append((name, row | {other + 1: -1.0}, y, var))
        if h is None or a is None:
            return out
        if not math.isnan(g.home_st) and not math.isnan(g.away_st):
            out.append(("st", {h + 2: 1.0, a + 2: -1.0}, g.home_st - g.away_st, c.st_sd**2))
        if not math.isnan(g.pace):
            out.append(("pace", {h + 3: 0.5, a + 3: 0.5}, g.pace / c.ref_plays - 1, c.pace_sd**2))
        if not math.isnan(g.margin):
            out.append(("margin", {k: v * c.points for k, v in ({h: 1.0, a + 1: -1.0, a: -1.0, h + 1: 1.0} | venue).items()}, g.margin, c.margin_sd**2))
        return out

    def measure(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(predictions, their deviations, z, log likelihood); then the joint update.

        Innovations are clipped and clipped rows trusted less by (z / clip) ** 2;
        with the gain of those variances Joseph's form is the covariance less
        gain times its innovations. Only the places that the rows name are read.
        """
        some = sorted({i for _, places, _, _ in rows for i in places})
        at = {i: k for k, i in enumerate(some)}
        h = np.zeros((len(rows), len(some)))
        for i, (_, places, _, _) in enumerate(rows):
            for k, v in places.items():
                h[i, at[k]] = v
        y, r = np.array([x[2] for x in rows]), np.array([x[3] for x in rows])
        ph, mu = (h @ self.cov[some]).T, h @ self.mean[some]
        hph = h @ ph[some]
        s, e = hph + np.diag(r), y - mu
        sd = np.sqrt(np.maximum(np.diag(s), 1e-18))
        z = e / sd
        likelihood = -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + float(e @ np.linalg.solve(s, e)))
        used = hph + np.diag(r * np.where(np.abs(z) > self.c.clip, np.abs(z) / self.c.clip, 1.0) ** 2)
        gain = np.linalg.solve(used, ph.T).T
        self.mean = self.mean + gain @ (np.clip(z, -self.c.clip, self.c.clip) * sd)
        self.cov = self.cov - gain @ ph.T
        self.centre()
        return mu, sd, z, likelihood


GAME = "league string, season int, week int, game long, ts timestamp_ntz, home string, away string, home_epa double, away_epa double, home_plays double, away_plays double, home_st double, away_st double, pace double, margin double, neutral boolean, home_lower boolean, away_lower boolean"
_NUMBERS = ["home_epa", "away_epa", "home_plays", "away_plays", "home_st", "away_st", "pace", "margin"]
_OUT = "league string, season int, week int, game long, home string, away string, mu double, sd double, z array<double>, names array<string>, log_likelihood double, home_rating double, away_rating double, home_sd double, away_sd double, hfa double, scoring double, teams array<string>, mean array<double>, cov array<double>, asymmetry double, seen timestamp_ntz"
STATE = "league string, season int, teams array<string>, mean array<double>, cov array<double>, seen timestamp_ntz"

#: Doubles of the covariances that are updated together.
HELD = 1 << 20
#: Leagues of a group, about; fewer where that leaves cores without a group.
TOGETHER, LEAST = 64, 8
_MEASURES = np.array(["home_epa", "away_epa", "st", "pace", "margin"])
_OFF, _DEF, _ST, _PACE, _OWN = range(BLOCK)


@dataclass
class Known:
    """What a league takes into its next season. Seasons leave no covariance between teams, so that a block a team is all of it."""

    league: str
    common: np.ndarray
    doubt: np.ndarray
    teams: dict[str, int] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK)))
    block: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK, BLOCK)))
    season: int = 0
    seen: np.datetime64 = np.datetime64("NaT", "us")
    games: int = 0

    @classmethod
    def of(cls, state: dict) -> Known:
        """From a row of STATE."""
        mean, n = np.array(state["mean"], float), len(state["teams"])
        cov = np.array(state["cov"], float).reshape(len(mean), len(mean))
        own = 2 + BLOCK * np.arange(n)[:, None] + np.arange(BLOCK)
        block = cov[own[:, :, None], own[:, None, :]]
        if block[:, :_ST, [_ST, _PACE]].any() or block[:, _ST, _PACE].any():
            raise ValueError(f"league {state['league']}: special teams and pace are kept apart from offence and defence")
        seen = np.datetime64("NaT", "us") if state["seen"] is None else np.datetime64(state["seen"], "us")
        return cls(state["league"], mean[:2], cov[:2, :2], {t: i for i, t in enumerate(state["teams"])}, mean[own].reshape(n, BLOCK), block, state["season"], seen)

    def between_seasons(self, c: Config, priors: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        keep, own, old = 1 - c.regress, slice(0, len(DIMS)), self.block
        self.common = keep * self.common + c.regress * np.array([c.home[0], c.scoring[0]])
        self.doubt = self.doubt + c.inflate * np.diag([0.1, 0.05])
        self.mean, self.block = keep * self.mean, np.zeros_like(old)
        self.mean[:, own] += c.regress * c.prior_mean
        self.block[:, own, own] = old[:, own, own] + c.inflate * np.eye(len(DIMS))
        self.block[:, _OWN, _OWN] = old[:, _OWN, _OWN] + c.inflate * 0.05
        for t in priors.keys() & self.teams.keys():
            at = self.teams[t]
            self.mean[at, own], self.block[at, own, own] = priors[t][0], np.diag(priors[t][1])

    def admit(self, c: Config, teams: list[str], priors: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        teams = [t for t in teams if t not in self.teams]
        if not teams:
            return
        usual = np.full(len(DIMS), c.prior_mean), np.full(len(DIMS), c.prior_var)
        some = [priors.get(t, usual) for t in teams]
        self.mean = np.concatenate([self.mean, [[*mean, c.own_home[0]] for mean, _ in some]])
        self.block = np.concatenate([self.block, [np.diag([*var, c.own_home[1]]) for _, var in some]])
        for t in teams:
            self.teams[t] = len(self.teams)


def _centred(mean: np.ndarray, cov: np.ndarray, real: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offence and defence of every league's teams to mean zero, as ``League.centre``; ``size`` is infinite for less than two teams."""
    most = real.shape[1]
    for part in (slice(2, 2 + most), slice(2 + most, 2 + 2 * most)):
        mean[:, part] -= real * (mean[:, part].sum(axis=1) / size)[:, None]
        cov[:, part] -= real[:, :, None] * (cov[:, part].sum(axis=1) / size[:, None])[:, None, :]
        cov[:, :, part] -= real[:, None, :] * (cov[:, :, part].sum(axis=2) / size[:, None])[:, :, None]
    return mean, cov


def _measures(c: Config, g: pd.DataFrame, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """As ``League.rows`` for many games: which measurements a game has, values, variances, and places and weights of the joint and the separate ones."""
    y = {n: g[n].to_numpy(float) for n in _NUMBERS}
    lower = [g[n].to_numpy(bool) for n in ("home_lower", "away_lower")]
    both, n = ~(lower[0] | lower[1]), len(g)
    has, value, var = np.zeros((n, 5), bool), np.zeros((n, 5)), np.ones((n, 5))
    for k, side in enumerate(("home", "away")):
        x, plays = y[f"{side}_epa"], y[f"{side}_plays"]
        has[:, k] = ~lower[k] & ~np.isnan(x)
        value[:, k] = x - np.where(lower[1 - k], c.lower_mean, 0.0)
        var[:, k] = c.epa_sd**2 * c.ref_plays / np.maximum(1.0, np.where(np.isnan(plays), c.ref_plays, plays)) + np.where(lower[1 - k], c.lower_var, 0.0)
    for k, x, sd in ((2, y["home_st"] - y["away_st"], c.st_sd), (3, y["pace"] / c.ref_plays - 1, c.pace_sd), (4, y["margin"], c.margin_sd)):
        has[:, k], value[:, k], var[:, k] = both & ~np.isnan(x), x, sd**2
    value, var = np.where(has, value, 0.0), np.where(has, var, 1.0)  # a measurement that is missing says nothing
    # a league's places: home advantage, scoring, then offence, defence and own home advantage of all teams
    at = np.stack([np.full(n, HOME), np.full(n, SCORING), 2 + i, 2 + j, 2 + most + i, 2 + most + j, 2 + 2 * most + i], axis=1)
    venue = np.where(g["neutral"].to_numpy(bool) | lower[0], 0.0, 1.0)
    apart, none, one = np.where(i == j, 0.0, 1.0), np.zeros(n), np.ones(n)
    home = np.stack([venue, one, one, none, none, lower[1] - 1.0, venue], axis=1)
    away = np.stack([none, one, none, one, lower[0] - 1.0, none, none], axis=1)
    margin = c.points * np.stack([venue, none, apart, -one, one, -apart, venue], axis=1)
    joint = np.stack([home, away, margin], axis=1) * has[:, [0, 1, 4], None]
    alone = np.stack([np.stack([apart, -one], axis=1), 0.5 * np.stack([apart, one], axis=1)], axis=1) * has[:, 2:4, None]
    return has, value, var, at, joint, alone


def _roots(s: np.ndarray, e: np.ndarray) -> tuple[list, list]:
    """Lower triangular roots of 3 x 3 matrices in the last two places, row by row, and what they make of ``e``."""
    l00 = np.sqrt(s[..., 0, 0])
    l10, l20 = s[..., 1, 0] / l00, s[..., 2, 0] / l00
    l11 = np.sqrt(s[..., 1, 1] - l10 * l10)
    l21 = (s[..., 2, 1] - l20 * l10) / l11
    l22 = np.sqrt(s[..., 2, 2] - l20 * l20 - l21 * l21)
    q0 = e[..., 0] / l00
    q1 = (e[..., 1] - l10 * q0) / l11
    return [l00, l10, l11, l20, l21, l22], [q0, q1, (e[..., 2] - l20 * q0 - l21 * q1) / l22]


def _together(c: Config, some: list[Known], g: pd.DataFrame, events: dict[tuple[str, int], dict[str, float]], finish: Callable) -> pd.DataFrame:
    """One season of leagues side by side, as ``League`` by itself; ``g`` has the games in order, ``__l`` their place in ``some``.

    Offence, defence and venue are measured jointly; special teams and pace are
    each measured alone, and nothing joins the three, so they are three
    covariances instead of one. Smaller leagues are padded with teams that
    nothing moves. Centred states stay centred under centred updates, and a
    week's noise d on every team is d (I - J / n) once centred, so a game is one
    update of rank five.
    """
    number = len(some)
    n = np.array([len(k.teams) for k in some])
    most = max(1, int(n.max()))
    off, deff, own, wide = 2, 2 + most, 2 + 2 * most, 2 + 3 * most
    real, size = np.arange(most) < n[:, None], np.where(n < 2, np.inf, n)
    mean, cov = np.zeros((number, wide)), np.zeros((number, wide, wide))
    level, doubt = np.zeros((number, 2, most)), np.zeros((number, 2, most, most))
    for l, k in enumerate(some):
        at = np.arange(n[l])
        mean[l, :2], cov[l, :2, :2] = k.common, k.doubt
        for d, place in ((_OFF, off), (_DEF, deff), (_OWN, own)):
            mean[l, place + at], cov[l, place + at, place + at] = k.mean[:, d], k.block[:, d, d]
        cov[l, off + at, deff + at] = cov[l, deff + at, off + at] = k.block[:, _OFF, _DEF]
        for p, d in enumerate((_ST, _PACE)):
            level[l, p, at], doubt[l, p, at, at] = k.mean[:, d], k.block[:, d, d]
    _centred(mean, cov, real, size)

    # games by step: the k-th of every league, leagues in the order of ``some`` (longest first)
    code = g["__l"].to_numpy()
    step = np.arange(len(g)) - np.searchsorted(code, code)
    order = np.lexsort((code, step))
    code, g = code[order], g.iloc[order]
    edges = np.append(np.flatnonzero(np.diff(step[order], prepend=-1)), len(g))
    i, j = g["__i"].to_numpy(), g["__j"].to_numpy()
    has, value, var, at, joint, alone = _measures(c, g, i, j, most)
    live, counted = has.any(axis=1), has.sum(axis=1)
    fresh, told = g["__fresh"].to_numpy(bool), g["__told"].to_numpy(bool)
    sides, weeks = np.stack([i, j], axis=1), g["week"].tolist() if events else []
    z, mu, likelihood, rating, sds, common = np.empty((len(g), 5)), np.empty((len(g), 2)), np.empty(len(g)), np.empty((len(g), 2)), np.empty((len(g), 2)), np.empty((len(g), 2))

    noise = np.zeros((number, wide))
    noise[:, :2] = c.home[2], c.scoring[2]
    for place, d in ((off, c.noise[DIMS[_OFF]]), (deff, c.noise[DIMS[_DEF]]), (own, c.own_home[2])):
        noise[:, place : place + most] = d * real
    shift = np.stack([c.noise[DIMS[d]] * real for d in (_ST, _PACE)], axis=1)
    share = np.sqrt(np.stack([c.noise[DIMS[d]] / size for d in (_OFF, _DEF)], axis=1))[:, :, None] * real[:, None, :]
    variance, variances = np.einsum("lii->li", cov), np.einsum("lpii->lpi", doubt)
    pending, rough = np.zeros(number), np.zeros(number, bool)
    w, product = np.zeros((number, 5, wide)), np.empty_like(cov)
    pair = np.arange(2)[:, None]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        m = e - s
        a, p, x, over = np.arange(m), cov[:m], mean[:m], fresh[s:e]
        variance[:m] += noise[:m] * over[:, None]
        variances[:m] += shift[:m] * over[:, None, None]
        pending[:m] += over
        for l in np.flatnonzero(told[s:e]):
            for t, factor in events[some[l].league, int(weeks[s + l])].items():
                if (k := some[l].teams.get(t)) is not None:
                    variance[l, [off + k, deff + k]] += [c.noise[d] * (factor - 1) for d in DIMS[:2]]
                    variances[l, :, k] += [c.noise[d] * (factor - 1) for d in DIMS[2:]]
                    rough[l] = True
        b, h, r = at[s:e], joint[s:e], var[s:e]
        ph = h @ p[a[:, None], b]
        hph = np.take_along_axis(ph, b[:, None, :], axis=2) @ h.transpose(0, 2, 1)
        on, q = sides[s:e], alone[s:e]
        ps = (q[:, :, None, :] @ doubt[a[:, None, None], pair, on[:, None, :]])[:, :, 0]
        hps = (ps[a[:, None, None], pair, on[:, None, :]] * q).sum(axis=2)
        known = np.concatenate([hph[:, [0, 1], [0, 1]], hps, hph[:, 2:, 2]], axis=1)
        mus = np.empty((m, 5))
        mus[:, [0, 1, 4]] = (h @ x[a[:, None], b][:, :, None])[:, :, 0]
        mus[:, 2:4] = (level[a[:, None, None], pair, on[:, None, :]] * q).sum(axis=2)
        miss, sd = value[s:e] - mus, np.sqrt(np.maximum(known + r, 1e-18))
        zs = miss / sd
        far = np.abs(zs)
        used = r * np.where(far > c.clip, far / c.clip, 1.0) ** 2
        held = np.clip(zs, -c.clip, c.clip) * sd
        # the raw measurements for the likelihood, the trusted ones for the update
        both = np.stack([hph, hph])
        both[:, :, [0, 1, 2], [0, 1, 2]] += np.stack([r[:, [0, 1, 4]], used[:, [0, 1, 4]]])
        low, told_by = _roots(both, np.stack([miss[:, [0, 1, 4]], held[:, [0, 1, 4]]]))
        logs = 2 * np.log(low[0][0] * low[2][0] * low[5][0]) + np.log(known[:, 2:4] + r[:, 2:4]).sum(axis=1)
        likelihood[s:e] = -0.5 * (counted[s:e] * math.log(2 * math.pi) + logs + sum(v[0] ** 2 for v in told_by) + (zs[:, 2:4] ** 2).sum(axis=1))
        l00, l10, l11, l20, l21, l22 = (v[1][:, None] for v in low)
        u = w[:m]
        u[:, 0] = ph[:, 0] / l00
        u[:, 1] = (ph[:, 1] - l10 * u[:, 0]) / l11
        u[:, 2] = (ph[:, 2] - l20 * u[:, 0] - l21 * u[:, 1]) / l22
        for d, place in enumerate((off, deff)):
            some_of = u[:, :3, place : place + most]
            some_of -= real[:m, None, :] * (some_of.sum(axis=2) / size[:m, None])[:, :, None]
            u[:, 3 + d, place : place + most] = share[:m, d] * np.sqrt(pending[:m] * live[s:e])[:, None]
        x += (np.stack([v[1] for v in told_by], axis=1)[:, None, :] @ u[:, :3])[:, 0]
        p -= np.matmul(u.transpose(0, 2, 1), u.copy(), out=product[:m])  # of one array with itself the product is slower
        gain = ps / (hps + used[:, 2:4])[:, :, None]
        level[:m] += gain * held[:, 2:4, None]
        doubt[:m] -= gain[..., None] * ps[:, :, None, :]
        if (again := np.flatnonzero(rough[:m] & live[s:e])).size:  # noise that differs by team is centred as it is
            mean[again], cov[again] = _centred(mean[again], cov[again], real[again], size[again])
            rough[again] = False
        pending[:m] = np.where(live[s:e], 0.0, pending[:m])
        z[s:e], mu[s:e, 0], mu[s:e, 1], common[s:e] = zs, mus[:, 4], sd[:, 4], x[:, :2]
        o, f = off + on, deff + on
        row = a[:, None]
        rating[s:e] = x[row, o] + x[row, f]
        sds[s:e] = p[row, o, o] + p[row, f, f] + 2 * p[row, o, f]
    skew = [np.abs(v - np.swapaxes(v, -1, -2)).reshape(number, -1).max(axis=1) for v in (cov, doubt)]
    finish(off + most * np.array([0, 1, 2]), mean, cov, level, doubt, np.maximum(*skew))

    lower, none = g[["home_lower", "away_lower"]].to_numpy(bool), ~has[:, 4]
    rating, sds = np.where(lower, math.nan, rating), np.where(lower, math.nan, np.sqrt(np.maximum(0.0, sds)))
    mu[none] = math.nan
    out = pd.DataFrame({"at": g["__at"].to_numpy(), "mu": mu[:, 0], "sd": mu[:, 1], "log_likelihood": likelihood, "home_rating": rating[:, 0], "away_rating": rating[:, 1], "home_sd": sds[:, 0], "away_sd": sds[:, 1], "hfa": common[:, 0], "scoring": common[:, 1]})
    for k in range(5):
        out[f"z{k}"], out[f"has{k}"] = z[:, k], has[:, k]
    return out


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "timestamp_ntz": pa.timestamp("us")}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _OUT.split(", ")])


def _lots(some: list[Known]) -> list[list[Known]]:
    """Leagues of like size, as many as fit with the largest of them, longest first."""
    some, lots = sorted(some, key=lambda k: len(k.teams)), []
    wide = np.array([2.0 + 3 * max(1, len(k.teams)) for k in some]) ** 2
    while some:
        fit = max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * wide, HELD, side="right")))
        lots.append(sorted(some[:fit], key=lambda k: -k.games))
        some, wide = some[fit:], wide[fit:]
    return lots


def _seasons(c: Config, rows: pa.Table, seasons: list[int | None], known: dict[str, Known], covariance: bool) -> pa.Table:
    """_OUT of a group's leagues, season by season; ``known`` is left as they are after the last.

    The season None takes all rows, and gives the state of leagues without a game too.
    """
    pdf = rows.drop_columns([n for n in rows.column_names if n.startswith("__")]).to_pandas()
    pdf["__row"] = np.arange(len(pdf))
    for n in ("neutral", "home_lower", "away_lower"):
        pdf[n] = pdf[n].eq(True)
    pdf[_NUMBERS] = pdf[_NUMBERS].astype(float)
    other, games = pdf[pdf["kind"] != "game"], pdf[pdf["kind"] == "game"]
    code, names = pd.factorize(games["league"], use_na_sentinel=False)
    games = games.assign(__code=code).sort_values([*(["season"] if seasons != [None] else []), "__code", "ts", "game"], kind="stable")
    games["__at"] = np.arange(len(games))
    games["__fresh"] = (games[["season", "__code", "week"]] != games[["season", "__code", "week"]].shift()).any(axis=1)
    seen, done, states = games["ts"].to_numpy("datetime64[us]").copy(), [], []
    for s in seasons:
        g, o = (games, other) if s is None else (games[games["season"] == s], other[other["season"] == s])
        priors: dict[str, dict] = {}
        events: dict[tuple, dict] = {}
        for r in o[o["kind"] == "prior"].itertuples():
            priors.setdefault(r.league, {})[r.home] = np.array([r.home_epa, r.away_epa, r.home_st, r.pace]), np.full(len(DIMS), r.margin)
        for r in o[o["kind"] == "event"].itertuples():
            week = events.setdefault((r.league, int(r.week)), {})
            week[r.home] = week.get(r.home, 1.0) * r.margin
        for k in known.values():
            k.between_seasons(c, priors.get(k.league, {}))
            k.games = 0
        g, which = g.copy(), g["__code"].to_numpy()
        first = np.flatnonzero(np.diff(which, prepend=-1))
        i, j = np.zeros(len(g), int), np.zeros(len(g), int)
        sides = [(g[n].tolist(), ~g[f"{n}_lower"].to_numpy(), at) for n, at in (("home", i), ("away", j))]
        for league in {*names[which[first]], *priors, *(league for league, _ in events)}:
            if league not in known:
                known[league] = Known(league, np.array([c.home[0], c.scoring[0]]), np.diag([c.home[1], c.scoring[1]]))
        for a, b in zip(first, [*first[1:], len(g)], strict=True):
            k = known[names[which[a]]]
            k.games, k.season = int(b - a), int(g["season"].iat[a])
            # the whole season's teams before its first game
            k.admit(c, sorted({t for of, upper, _ in sides for t, u in zip(of[a:b], upper[a:b], strict=True) if u}), priors.get(k.league, {}))
            for of, upper, at in sides:
                at[a:b] = [k.teams[t] if u else 0 for t, u in zip(of[a:b], upper[a:b], strict=True)]
            place = g["__at"].iat[a]
            seen[place : place + k.games] = np.fmax(seen[place : place + k.games], k.seen)
            k.seen = seen[place + k.games - 1]
        g["__i"], g["__j"] = i, j
        g["__told"] = [f and (league, week) in events for f, league, week in zip(g["__fresh"], g["league"], g["week"], strict=True)] if events else False
        for lot in _lots(list(known.values())):
            at = {k.league: l for l, k in enumerate(lot)}
            place = np.array([at.get(league, -1) for league in names], int)[which]
            some = g.assign(__l=place)[place >= 0].sort_values("__l", kind="stable")

            def finish(places: np.ndarray, mean: np.ndarray, cov: np.ndarray, level: np.ndarray, doubt: np.ndarray, skew: np.ndarray, lot: list = lot, s: int | None = s) -> None:
                for l, k in enumerate(lot):
                    n = len(k.teams)
                    all_of, team = places[:, None] + np.arange(n), np.arange(n)
                    k.common, k.doubt = mean[l, :2].copy(), cov[l, :2, :2].copy()
                    k.mean[:, [_OFF, _DEF, _OWN]], k.mean[:, [_ST, _PACE]] = mean[l, all_of].T, level[l, :, :n].T
                    k.block = np.zeros((n, BLOCK, BLOCK))
                    k.block[:, [[_OFF], [_DEF], [_OWN]], [_OFF, _DEF, _OWN]] = cov[l, all_of.T[:, :, None], all_of.T[:, None, :]]
                    k.block[:, _ST, _ST], k.block[:, _PACE, _PACE] = doubt[l, 0, team, team], doubt[l, 1, team, team]
                    if s is not None and not k.games:
                        continue
                    whole = None
                    if covariance:
                        whole, base = np.zeros((2 + BLOCK * n, 2 + BLOCK * n)), 2 + BLOCK * team
                        joint = np.concatenate([[HOME, SCORING], base + _OFF, base + _DEF, base + _OWN])
                        whole[np.ix_(joint, joint)] = cov[l][np.ix_(here := np.concatenate([[HOME, SCORING], *all_of]), here)]
                        for p, d in enumerate((_ST, _PACE)):
                            whole[np.ix_(base + d, base + d)] = doubt[l, p, :n, :n]
                        whole = ((whole + whole.T) / 2).ravel()
                    states.append((k.league, k.season, list(k.teams), np.concatenate([k.common, k.mean.ravel()]), whole, float(skew[l]), None if np.isnat(k.seen) else k.seen))

            done.append(_together(c, lot, some, events, finish))
    found = pd.concat(done, ignore_index=True).sort_values("at", kind="stable") if done else pd.DataFrame()
    own = rows.take(pa.array(games["__row"].to_numpy()))
    has = found[[f"has{k}" for k in range(5)]].to_numpy(bool) if done else np.zeros((0, 5), bool)
    ends = pa.array(np.append(0, has.sum(axis=1).cumsum()), pa.int32())
    lists = {"z": found[[f"z{k}" for k in range(5)]].to_numpy()[has] if done else [], "names": pa.array(_MEASURES).take(pa.array(np.nonzero(has)[1]))}
    columns = {n: own[n] for n in ("league", "season", "week", "game", "home", "away")} | {n: pa.ListArray.from_arrays(ends, pa.array(v)) for n, v in lists.items()} | {"seen": pa.array(seen)}
    history = pa.table([(columns[f.name].cast(f.type) if f.name in columns else pa.array(found[f.name], f.type, from_pandas=True) if f.name in found else pa.nulls(len(games), f.type)) for f in _ARROW], schema=_ARROW)
    given = dict(zip(("league", "season", "teams", "mean", "cov", "asymmetry", "seen"), zip(*states, strict=True), strict=True)) if states else {}
    return pa.concat_tables([history, pa.table([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(states), f.type) for f in _ARROW], schema=_ARROW)])


def _rows(games: DataFrame, priors: DataFrame | None, events: DataFrame | None, of_season: bool) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    rows = games.select(F.lit("game").alias("kind"), *[f.split()[0] for f in GAME.split(", ")])
    empty = {f.split()[0]: none(f.split()[1]).alias(f.split()[0]) for f in GAME.split(", ")}
    named = {"league": F.col("league")} | ({"season": F.col("season")} if of_season else {})
    if priors is not None:
        some = empty | named | {"home": F.col("team").alias("home"), "home_epa": F.col("off_epa").alias("home_epa"), "away_epa": F.col("def_epa").alias("away_epa"), "home_st": F.col("st_value").alias("home_st"), "pace": F.col("pace"), "margin": F.col("var").alias("margin")}
        rows = rows.unionByName(priors.select(F.lit("prior").alias("kind"), *some.values()))
    if events is not None:
        factor = F.coalesce(*[F.when(F.col("event") == e, F.lit(m)) for e, m in EVENTS.items()], F.try_to_number("event", F.lit("999.99")).cast("double"))
        some = empty | named | {"week": F.col("week"), "home": F.col("team").alias("home"), "margin": factor.alias("margin")}
        rows = rows.unionByName(events.select(F.lit("event").alias("kind"), *some.values()))
    return rows


def _group(number: int) -> Column:
    return F.pmod(F.xxhash64("league"), F.lit(number)).cast("int").alias("__group")


def _plan(games: DataFrame) -> tuple[int, list[int]]:
    """(number of groups, seasons): groups of leagues that grow in number with the table, not in size; one row comes back."""
    leagues, seasons = games.agg(F.approx_count_distinct("league"), F.sort_array(F.collect_set("season"))).first()
    cores = games.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-leagues // TOGETHER), min(cores, leagues // LEAST)), seasons


def season(state: DataFrame, games: DataFrame, config: Config, priors: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """One season of all leagues: game rows, and a row with ``teams`` that is the league's next state.

    ``priors`` is (league, team, off_epa, def_epa, st_value, pace, var), taken in
    at the season's start; ``events`` is (league, week, team, event or factor).
    """

    def step(rows: pa.Table, before: pa.Table) -> pa.Table:
        known = {r["league"]: Known.of(r) for r in before.to_pylist()}
        return _seasons(config, rows, [None], known, True)

    group = _group(_plan(games)[0])
    return _rows(games, priors, events, False).groupBy(group).cogroup(state.groupBy(group)).applyInArrow(step, _OUT)


def start(spark) -> DataFrame:
    return spark.createDataFrame([], STATE)


def state_of(step: DataFrame) -> DataFrame:
    return step.where(F.col("teams").isNotNull()).select(*[f.split()[0] for f in STATE.split(", ")])


def history_of(step: DataFrame) -> DataFrame:
    return step.where(F.col("teams").isNull()).drop("teams", "mean", "cov", "asymmetry")


def replay(games: DataFrame, config: Config | None = None, priors: DataFrame | None = None, events: DataFrame | None = None, covariance: bool = False) -> DataFrame:
    """All seasons in one job: game rows, and each league's state after every season that it plays in.

    ``priors`` and ``events`` have a season. States go from season to season
    inside a task; ``cov`` is given out on demand, as it is most of a state.
    ``asymmetry`` is the greatest difference of the covariance from its transpose.
    """
    config, (number, seasons) = config or Config(), _plan(games)
    rows = _rows(games, priors, events, True).withColumn("__group", _group(number)).repartitionById(number, "__group")
    return rows.groupBy("__group").applyInArrow(lambda some: _seasons(config, some, seasons, {}, covariance), _OUT)


def run(games: DataFrame, config: Config | None = None, priors: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """History of all seasons; ``priors`` and ``events`` have a season."""
    return history_of(replay(games, config, priors, events))


def likelihoods(games: DataFrame, configs: dict[str, Config]) -> dict[str, float]:
    """Sum of one-step log likelihoods of each configuration: groups of leagues and configurations run side by side in one job."""
    (number, seasons), points = _plan(games), list(configs)
    names = F.explode(F.array(*map(F.lit, range(len(points))))).alias("__point")
    rows = _rows(games, None, None, True).select("*", names, _group(number)).withColumn("__task", F.col("__group") * len(points) + F.col("__point"))

    def score(key: tuple, some: pa.Table) -> pa.Table:
        point = points[key[0].as_py() % len(points)]
        found = _seasons(configs[point], some, seasons, {}, False)
        return pa.table({"point": [point], "s": [pa.compute.sum(found["log_likelihood"]).as_py()]})

    each = rows.repartitionById(number * len(points), "__task").groupBy("__task").applyInArrow(score, "point string, s double")
    return dict.fromkeys(configs, 0.0) | {r.point: r.s for r in each.groupBy("point").agg(F.sum("s").alias("s")).collect()}


def tune(games: DataFrame, base: Config | None = None, scales: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> tuple[Config, float, list[dict]]:
    """(best, its log likelihood, trials): weekly noise by coordinate search.

    First one scale for all dimensions, then each dimension by itself with the
    others held. A round is one set of jobs over (league, scale); only sums of
    likelihoods come back.
    """
    base, games = base or Config(), kept(games, "games")  # each round reads them
    trials: list[dict] = []

    def best_of(options: list[dict[str, float]]) -> tuple[dict[str, float], float]:
        found = likelihoods(games, {str(i): base.scaled(**o) for i, o in enumerate(options)})
        trials.extend({**o, "log_likelihood": found[str(i)]} for i, o in enumerate(options))
        i = max(found, key=lambda k: (found[k], -int(k)))
        return options[int(i)], found[i]

    now, score = best_of([dict.fromkeys(DIMS, s) for s in scales])
    for d in DIMS:
        tried, value = best_of([now | {d: s} for s in scales])
        if value > score:
            now, score = tried, value
    return base.scaled(**now), score, trials
