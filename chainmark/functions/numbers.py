"""Scores, odds and geometry as column expressions; no Python runs per row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088

#: Coefficients of formula 26.2.17 of Abramowitz and Stegun for the normal distribution.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_TAIL_SCALE = 0.2316419


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution, to 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * _TAIL_SCALE)
    poly = F.lit(0.0)
    for c in reversed(_TAIL):
        poly = (poly + c) * t
    upper = normal_pdf(z) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def crps_normal(mu: Column, sigma: Column, y: Column) -> Column:
    """Continuous ranked probability score of a normal forecast."""
    s = F.greatest(sigma, F.lit(1e-8))
    z = (y - mu) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def shrunk(mean: Column, n: Column, prior: Column, k: float) -> Column:
    """Mean pulled towards a prior by n / (n + k)."""
    w = n / (n + F.lit(float(k)))
    return w * mean + (1 - w) * prior


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100).when(american < 0, 1 + 100 / -american)


def implied(american: Column) -> Column:
    return 1 / decimal_odds(american)


def fair_proportional(q: Column, other: Column) -> Column:
    return F.try_divide(q, q + other)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed a single time, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def bisected(above: Callable[[Column], Column], lo: float, hi: float, rounds: int) -> Column:
    """The middle of what is left of (lo, hi) after halving; ``above(x)``: the root lies above x."""
    middle = lambda s: (s["lo"] + s["hi"]) / 2
    halve = lambda s, _: once(middle(s), lambda m: F.when(above(m), F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), halve, middle)


def fair_power(q: Column, other: Column, rounds: int = 50) -> Column:
    """q ** c with c such that both sides sum to one; c by bisection."""
    return F.pow(q, bisected(lambda c: F.pow(q, c) + F.pow(other, c) > 1, 0.01, 100.0, rounds))


def fair_shin(q: Column, other: Column, rounds: int = 50) -> Column:
    """Shin's probabilities for two outcomes; the insider share by bisection."""
    book = q + other
    side = lambda x, z: (F.sqrt(z * z + 4 * (1 - z) * x * x / book) - z) / (2 * (1 - z))
    found = bisected(lambda z: side(q, z) + side(other, z) > 1, 0.0, 0.9, rounds)
    return once(found, lambda z: side(q, z))


def expected_value(p: Column, decimal: Column) -> Column:
    return p * decimal - 1


def kelly(p: Column, decimal: Column, fraction: float = 0.25, cap: float = 0.015) -> Column:
    """Fractional Kelly stake, never negative, at most ``cap``."""
    b = decimal - 1
    return F.least(F.greatest(F.lit(0.0), F.try_divide(b * p - (1 - p), b)) * fraction, F.lit(cap))
