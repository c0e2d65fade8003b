"""Isotonic maps against a plain pool of violators, Newton fits, the gate, and bootstraps of any statistic."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import calibrators, inference


def pooled(pts: list[tuple[float, float, float]]) -> list[float]:
    """Fit at every point, in order of p."""
    blocks: list[list[float]] = []
    for _, s, n in sorted(pts):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return [min(1 - 1e-6, max(1e-6, s / n)) for s, n, k in blocks for _ in range(int(k))]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_isotonic_equals_pooling(spark: SparkSession, parts: str) -> None:
    r = random.Random(1)
    pts = {}
    for market in ("a", "b", None):
        for i in range(400):
            n = r.randrange(1, 6)
            p = round(r.random(), 4)
            pts[market, p] = (sum(r.random() < (p if market == "a" else 0.4) for _ in range(n)), n)
    pts |= {("up", i / 50): (i, 50) for i in range(51)} | {("down", i / 50): (50 - i, 50) for i in range(51)} | {("one", 0.5): (1, 3)}
    df = spark.createDataFrame([(m, p, float(s), float(n)) for (m, p), (s, n) in pts.items()], "market string, p double, s double, n double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        steps = calibrators.kept(calibrators.isotonic(df, ["market"]))
        got = {(x.market, x.p): x.fit for x in calibrators.apply_steps(df, ["market"], "p", steps, "fit").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for m in ("a", "b", None, "up", "down", "one"):
        own = sorted((p, s, n) for (k, p), (s, n) in pts.items() if k == m)
        assert [got[m, p] for p, _, _ in own] == pytest.approx(pooled(own), abs=1e-12)


def test_between_and_beyond_steps(spark: SparkSession) -> None:
    steps = spark.createDataFrame([(0.2, 0.3, 0.1), (0.5, 0.5, 0.7)], "lo double, hi double, value double")
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.25, 0.3, 0.4, 0.5, 0.9, 1.0)], "p double")
    got = [r.calibrated for r in calibrators.apply_steps(rows, [], "p", steps).orderBy("p").collect()]
    assert got == pytest.approx([0.1, 0.1, 0.1, 0.1, 0.4, 0.7, 0.7, 0.7])


def forecasts(spark: SparkSession, n: int = 4000):
    """Market "sharp" says too little of what it knows, "noise" knows nothing and says so."""
    u = lambda s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(10**6)) / 1e6
    rows = spark.range(n).withColumn("market", F.when(F.col("id") % 2 == 0, "sharp").otherwise("noise"))
    rows = rows.withColumn("truth", u("t")).withColumn("p", F.when(F.col("market") == "sharp", 0.4 + 0.2 * F.round("truth", 2)).otherwise(F.round(0.48 + 0.04 * u("p"), 3)))
    hit = F.when(F.col("market") == "sharp", u("y") < F.col("truth")).otherwise(u("y") < 0.5)
    return rows.withColumns({"y": hit.cast("double"), "week": F.col("id") % 24, "oof": F.lit(True), "half": F.pmod(F.xxhash64(F.lit("h"), "id"), F.lit(2))})


def test_gate_lets_only_real_gains_through(spark: SparkSession) -> None:
    rows = calibrators.kept(forecasts(spark))
    maps = calibrators.Calibrators(rows.where("half = 0"), "market", "p", "y", "oof")
    gates = {r.market: r for r in maps.gate(rows.where("half = 1"), ["week"], 200).collect()}
    assert gates["sharp"].applied and gates["sharp"].low > 0
    assert not gates["noise"].applied
    out = maps.apply(rows)
    assert out.where("market = 'noise' and calibrated <> p").count() == 0
    sharp = out.where("market = 'sharp'")
    assert sharp.where("calibrated <= 0 or calibrated >= 1").count() == 0
    assert sharp.agg(F.corr("calibrated", "truth")).first()[0] > 0.95
    assert out.columns == [*rows.columns, "calibrated"] and out.count() == rows.count()


def test_rows_fitted_on_are_refused(spark: SparkSession) -> None:
    rows = forecasts(spark, 100).withColumn("oof", F.col("id") > 0)
    with pytest.raises(ValueError, match="fitted on"):
        calibrators.Calibrators(rows, "market", "p", "y", "oof")


def test_thin_markets_take_platt_and_constant_ones_none(spark: SparkSession) -> None:
    rows = [("thin", i / 100, i % 2) for i in range(60)] + [("flat", i / 100, 1) for i in range(60)] + [("few", 0.5, i % 2) for i in range(3)]
    rows += [("full", i / 1000, (i * 7) % 3 == 0) for i in range(1000)]
    pts = calibrators.points(spark.createDataFrame([(m, p, float(y)) for m, p, y in rows], "market string, p double, y double"), ["market"], "p", "y")
    got = {r.market: (r.n, r.kind) for r in calibrators.kinds(pts, ["market"]).collect()}
    assert got == {"thin": (60, "platt"), "flat": (60, "none"), "few": (3, "none"), "full": (1000, "isotonic")}


def test_newton_finds_the_slope(spark: SparkSession) -> None:
    """Outcomes drawn exactly at 1 / (1 + exp(-0.5 - 2 logit p)): the fit returns both numbers."""
    rows = []
    for i in range(1, 100):
        p = i / 100
        rows.append(("m", p, 1000 / (1 + math.exp(-0.5 - 2 * math.log(p / (1 - p)))), 1000.0))
    fit = calibrators.cox(spark.createDataFrame(rows, "market string, p double, s double, n double"), ["market"]).first()
    assert fit.converged and math.isclose(fit.a, 0.5, abs_tol=1e-6) and math.isclose(fit.b, 2.0, abs_tol=1e-6)


def test_bootstrap_of_a_ratio(spark: SparkSession) -> None:
    """Equal blocks leave no doubt; unequal ones do, and by whole blocks."""
    rows = spark.range(600).selectExpr("id % 6 as week", "id % 2 as g", "1.0 as one", "cast(id % 6 as double) as v")
    same = inference.bootstrap(rows, ["g"], ["week"], {"a": F.col("one"), "b": F.lit(2)}, {"ratio": F.col("a") / F.col("b")}, 50).collect()
    assert {(r.g, r.estimate, r.se, r.n_blocks) for r in same} == {(0, 0.5, 0.0, 3), (1, 0.5, 0.0, 3)}
    some = inference.block_bootstraps(rows, ["g"], ["week"], F.col("v"), 300).orderBy("g").collect()
    assert [r.delta for r in some] == [2.0, 3.0] and all(r.low < r.delta < r.high for r in some)
