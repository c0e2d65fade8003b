"""Convex stacking against a search over subsets, Student's t on planted degrees of freedom, sample scores against all pairs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import shape, stacking


def best(gram: np.ndarray, cross: np.ndarray) -> float:
    """Least value over all subsets' equality-constrained solutions that are feasible."""
    n, found = len(cross), math.inf
    for k in range(1, n + 1):
        for some in itertools.combinations(range(n), k):
            some = list(some)
            a = np.zeros((k + 1, k + 1))
            a[:k, :k], a[:k, k], a[k, :k] = gram[np.ix_(some, some)], 1, 1
            w = np.zeros(n)
            w[some] = np.linalg.lstsq(a, np.append(cross[some], 1.0), rcond=None)[0][:k]
            if w.min() >= -1e-12:
                found = min(found, w @ gram @ w - 2 * w @ cross)
    return found


def test_active_set_finds_the_minimum() -> None:
    r = np.random.default_rng(0)
    for trial in range(200):
        n = int(r.integers(1, 6))
        x = r.normal(size=(30, n)) + (r.normal(size=(30, 1)) if trial % 3 else 0)
        if trial % 5 == 0 and n > 1:
            x[:, 1] = x[:, 0]  # two members that say the same
        y = x @ r.dirichlet(np.ones(n)) + r.normal(size=30) * (trial % 4)
        gram, cross = x.T @ x / 30, x.T @ y / 30
        w = stacking.simplex(gram, cross)
        assert w.min() >= 0 and math.isclose(w.sum(), 1, abs_tol=1e-9)
        assert w @ gram @ w - 2 * w @ cross <= best(gram, cross) + 1e-8


def test_stack_of_groups(spark: SparkSession) -> None:
    rows = spark.range(400).selectExpr("id % 2 as g", "rand(1) as a", "rand(2) as b", "rand(3) as c", "true as oof").selectExpr("*", "case when g = 0 then 0.25 * a + 0.75 * c else b end as y")
    rows = rows.cache()
    got = {r.g: r for r in stacking.stack(rows, ["g"], "y", ["a", "b", "c"], "oof").collect()}
    assert got[0].weights == pytest.approx([0.25, 0, 0.75], abs=1e-6) and got[1].weights == pytest.approx([0, 1, 0], abs=1e-6)
    assert got[0].n == 200 and got[0].rmse < 1e-6 and got[0].condition > 1
    with pytest.raises(ValueError, match="fitted on"):
        stacking.stack(rows.withColumn("oof", F.col("a") < 0.5), ["g"], "y", ["a", "b"], "oof")


@pytest.mark.parametrize("degrees", [3.0, 8.0])
def test_planted_degrees_of_freedom(spark: SparkSession, degrees: float) -> None:
    x = 2.0 + 1.5 * np.random.default_rng(7).standard_t(degrees, 20_000)
    found = shape.student(spark.createDataFrame([(float(v),) for v in np.round(x, 2)], "v double"), "v")
    assert found["n"] == 20_000 and found["mean"] == pytest.approx(2.0, abs=0.05) and found["scale"] == pytest.approx(1.5, abs=0.08)
    assert found["df"] == pytest.approx(degrees, rel=0.2)
    assert math.isnan(shape.student(spark.createDataFrame([], "v double"), "v")["df"])


def test_score_of_a_sample_equals_all_pairs(spark: SparkSession) -> None:
    r = np.random.default_rng(1)
    samples = {g: r.normal(size=k).round(1) for g, k in (("a", 30), ("b", 1), ("c", 7))}
    rows = [(g, float(v), i) for g, x in samples.items() for i, v in enumerate(x)] + [("a", None, 99)]
    outcomes = {"a": 0.3, "b": 2.0, "c": -1.0}
    got = shape.empirical_crps(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], "v", "i", spark.createDataFrame(list(outcomes.items()), "g string, y double"), "y").collect()
    for row in got:
        x = samples[row.g]
        want = np.abs(x - outcomes[row.g]).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2
        assert row.n == len(x) and row.crps == pytest.approx(want)


def test_soft_clip(spark: SparkSession) -> None:
    got = [r[0] for r in spark.createDataFrame([(0.01,), (100.0,), (-100.0,)], "x double").select(shape.soft_clip(F.col("x"), 2.0)).collect()]
    assert got[0] == pytest.approx(0.01, rel=1e-4) and got[1:] == pytest.approx([2.0, -2.0])
