"""Ordered computations of hot keys in many parts against plain Python; interval matches without pairs; conjugate gradients against a dense solution."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import adjust, asof, betting, ranges


@pytest.fixture
def parts(spark: SparkSession) -> Iterator[None]:
    """Seven parts, never put together."""
    names = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def data(n: int = 900) -> list[tuple[str | None, int, float]]:
    r = random.Random(2)
    return [(r.choice(["hot"] * 8 + ["a", None]), i, round(r.uniform(-1, 1), 3)) for i in range(n)]


def keyed(rows: list[tuple]) -> dict:
    out: dict = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((i, v))
    return {k: sorted(x) for k, x in out.items()}


def test_numbers_sums_and_peaks(spark: SparkSession, parts: None) -> None:
    rows = data()
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    assert ranges.ranged(df, ["k"], ["i"]).where("k = 'hot'").select(ranges.PART).distinct().count() > 3
    numbers = {(r.k, r.i): r.at for r in ranges.numbered(df, ["k"], ["i"], "at").collect()}
    sums = {(r.k, r.i): r.s for r in ranges.running(df, ["k"], ["i"], {"s": F.col("v")}).collect()}
    peaks = {(r.k, r.i): r.m for r in ranges.highest(df, ["k"], ["i"], "v", -0.5, "m").collect()}
    for k, x in keyed(rows).items():
        assert [numbers[k, i] for i, _ in x] == list(range(len(x)))
        assert [sums[k, i] for i, _ in x] == pytest.approx(list(accumulate(v for _, v in x)))
        assert [peaks[k, i] for i, _ in x] == [max(-0.5, m) for m in accumulate((v for _, v in x), max)]


def test_paths(spark: SparkSession, parts: None) -> None:
    rows = [*data(), ("down", 1, -2.0), ("down", 2, -1.0), ("up", 1, 3.0)]
    got = {r.k: (r.final, r.fall) for r in ranges.path(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], ["i"], F.col("v")).collect()}
    for k, x in keyed(rows).items():
        heights = [0.0, *accumulate(v for _, v in x)]
        tops = list(accumulate(heights, max))
        assert got[k] == pytest.approx((heights[-1], max(t - h for t, h in zip(tops, heights, strict=True))))


def test_tiers_of_a_hot_key_follow_the_rule(spark: SparkSession, parts: None) -> None:
    rows = [(k, i, round(0.5 + abs(v) / 2, 2)) for k, i, v in data()] + [("hot", 5000, None)]
    got = {(r.k, r.i): r.tier for r in betting.tier_history(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], ["i"], "v").collect()}
    limits = dict(betting.TIERS)
    raw = lambda p: next((n for n, least in betting.TIERS if p >= least), betting.BOTTOM)
    for k, x in keyed([r for r in rows if r[2] is not None]).items():
        now = None
        for i, p in x:
            if now == betting.BOTTOM and p < round(limits["lean"] + betting.BAND, 9):
                pass
            elif now in limits and p >= round(limits[now] - betting.BAND, 9):
                now = raw(p) if p >= limits[now] else now
            else:
                now = raw(p)
            assert got[k, i] == now
    assert ("hot", 5000) not in got


def test_interval_hits_equal_all_pairs(spark: SparkSession) -> None:
    r = random.Random(4)
    left = [(f"l{i}", r.choice(["a", "b", None]), r.randrange(0, 200) / 4) for i in range(150)]
    right = [(f"r{i}", r.choice(["a", "b", None]), r.randrange(0, 200) / 4) for i in range(60)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, k string, h double").withColumn("ts", F.timestamp_micros((F.col("h") * 3_600_000_000).cast("long")))
    found = asof.interval_match(frame(left, "id"), frame(right, "rid"), ["k"], "ts", "ts", "id", "rid", 2.0)
    got = {x.id: (x.rid, x.n, x.status) for x in found.collect()}
    for i, k, h in left:
        hits = [j for j, kk, hh in right if k is not None and k == kk and abs(h - hh) <= 2.0]
        assert got[i] == (hits[0] if len(hits) == 1 else None, len(hits), "matched" if len(hits) == 1 else "quarantined" if hits else "unmatched")


def test_conjugate_gradients_equal_a_dense_solution(spark: SparkSession) -> None:
    r = np.random.default_rng(1)
    rows = [(m, f"o{r.integers(12)}", f"d{r.integers(9)}", bool(r.integers(2)), float(r.normal())) for m in ("x", "y") for _ in range(200)]
    rows += [("x", None, "d1", True, 1.0), ("x", "o1", "d1", None, None), ("z", "o1", "d1", True, 2.0)]
    df = spark.createDataFrame(rows, "m string, o string, d string, h boolean, y double")
    found = adjust.kept(adjust.solve(df, ["m"], "o", "d", "h", "y"))
    got = {(x.m, x.side, x.entity): x.value for x in found.collect()}
    for m in ("x", "y", "z"):
        own = [x for x in rows if x[0] == m and None not in (x[1], x[2], x[4])]
        names = [("off", e) for e in sorted({x[1] for x in own})] + [("def", e) for e in sorted({x[2] for x in own})] + [("home", None)]
        at = {n: i for i, n in enumerate(names)}
        a = np.zeros((len(own), len(names)))
        for i, (_, o, d, h, _) in enumerate(own):
            a[i, at["off", o]], a[i, at["def", d]], a[i, at["home", None]] = 1, -1, float(h)
        want = np.linalg.solve(a.T @ a + adjust.PENALTY * np.eye(len(names)), a.T @ np.array([x[4] for x in own]))
        assert [got[m, s, e] for s, e in names] == pytest.approx(want.tolist(), abs=1e-8)
    rest = adjust.residuals(df, ["m"], "o", "d", "h", "y", found)
    assert rest.where("abs(residual) > 1e-7").count() == 0 and rest.count() == len(got)
    # what is adjusted adds up: value = fit + what remains on either side
    some = adjust.adjusted(df.where("m = 'x' and o is not null and y is not null"), ["m"], "o", "d", "h", "y", found)
    off = found.where("side = 'off' and m = 'x'").selectExpr("entity as o", "value")
    assert some.join(off, "o").where("abs((adj_off - value) - (y - __fit)) > 1e-9").count() == 0


def test_feature_names() -> None:
    names = [adjust.feature_name(s, m, f) for s in adjust.SIDES for m in adjust.METRICS for f in adjust.FORMS]
    assert len(set(names)) == 72 and all(adjust.feature_name(*adjust.parse_feature(n)) == n for n in names)
    assert adjust.parse_feature("adj_def_rush_explosiveness_l3d") == ("def", "rush_explosiveness", "l3d")
    for bad in ("off_epa_std", "adj_off_epa", "adj_off_pace_std", "adj_off_epa_std "):
        with pytest.raises(ValueError, match="no adjusted feature"):
            adjust.parse_feature(bad)
