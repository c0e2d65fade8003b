"""Against sorting all scores."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession

from chainmark.llm import topk


def brute(data: list, k: int, fixed: int = 2**63 - 1) -> list[tuple]:
    v = [(i, [math.floor(64 * c) if abs(c) < 2**52 else int(64 * c) for c in x]) for i, x in data if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q, mine in v:
        if q % 5 == 0:
            score = lambda y, mine=mine: max(-fixed, min(fixed, sum(a * b for a, b in zip(mine, y, strict=False))))
            scored = sorted((-score(y), i) for i, y in v if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def awkward(scale: float) -> list:
    r = random.Random(5)
    data = [(i, [scale * r.choice((-0.5, 0.25, 1.0)) for _ in range(4)]) for i in range(60)]
    data += [(100 + i, [scale] * 4) for i in range(40)]  # ties
    return data + [(200, None), (205, [1.0, None, 0.0, 0.0]), (210, [float("nan")] * 4), (215, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (220, [1.0]), (5, [scale] * 4), (5, [scale] * 4), (225, [])]


@pytest.mark.parametrize("scale", [1.0, 1e5, 5e6, 1e12, 1e200])
def test_equals_sorting(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, scale: float) -> None:
    """In doubles, longs and Python integers; the greatest scores leave the long range and count as its ends."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    data = awkward(scale)
    df = spark.createDataFrame([(*x, 1, 0.5, 2) for x in data], "vec_id long, embedding array<double>, block int, score double, rank int").repartition(3)
    vectors = topk.integer_vectors(df)
    found = topk.search(vectors, vectors.where("vec_id % 5 = 0"), 7).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in found) == brute(data, 7)


def test_joined_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A query set beyond the broadcast limit; very long vectors."""
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    data = awkward(1.0) + [(300 + i, [0.5] * 20_000) for i in range(3)]
    vectors = topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
    found = topk.search(vectors, vectors.where("vec_id % 5 = 0"), 7).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in found) == brute(data, 7)


def test_fewer_than_k_and_empty(spark: SparkSession) -> None:
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df)
    assert topk.search(vectors, vectors.where("vec_id = 0")).collect()[0].score == 32 * 64
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0
