"""Targets against a plain water-filling; totals near them; bounds and reruns."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.llm import mixing

from .fixtures import documents, rows


def water(words: dict, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> dict:
    order = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(words.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * words[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = float(cap * words[s])
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_totals(spark: SparkSession) -> None:
    docs = documents(spark)
    found = mixing.mix(docs).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _ in rows())
    words, taken = {}, {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size
    want = water(words)
    for r in found:
        assert r.source_size == words[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    ordinary = {s for s in words if words[s] < 50_000}
    assert ordinary
    for s in ordinary:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s])
    again = mixing.mix(docs).collect()
    key = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
    assert key(found) == key(again)


def test_sizes(spark: SparkSession) -> None:
    data = rows()
    found = sorted((str(r.doc_id), r.size) for r in mixing.mix(documents(spark, data)).collect())
    assert found == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in data)


def test_wordless_and_empty(spark: SparkSession) -> None:
    found = mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.taken, r.target) for r in found] == [(0, 0, 0.0)] * 2
    assert mixing.mix(documents(spark, [])).count() == 0


def test_rates_are_exponential_and_rounding_is_near(spark: SparkSession) -> None:
    """rate = exp(lambda * size) up to the cap, one lambda a source; copies stay within one of the rate."""
    r = random.Random(4)
    data = [(i, " ".join("w" for _ in range(r.randrange(1, 60)))) for i in range(3000)]
    found = mixing.mix(documents(spark, data)).collect()
    by: dict = {}
    for x in found:
        by.setdefault(x.source, []).append(x)
    for rows_ in by.values():
        free = [x for x in rows_ if x.rate < 3 - 1e-9]
        slopes = [math.log(x.rate) / x.size for x in free]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
        assert math.isclose(sum(x.rate * x.size for x in rows_), rows_[0].target, rel_tol=1e-6)
        assert abs(sum(x.taken for x in rows_) - rows_[0].target) <= 60 * (1 + len(rows_) // mixing.BUCKET)
        assert all(abs(x.copies - x.rate) <= 1 + 60 / x.size and x.taken == x.copies * x.size for x in rows_)


def test_hot_rows_fill_many_buckets(spark: SparkSession) -> None:
    """Ten thousand equal rows, and as many without an id, are dealt in lots; none is lost."""
    data = [(1, "a b c d e")] * 10_000 + [(None, "f g h")] * 10_000 + [(i, f"x{i} y") for i in range(2, 50)]
    found = mixing.mix(documents(spark, data))
    got = {(r.doc_id, r.source): (r.n, r.taken, r.target) for r in found.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert sum(n for n, _, _ in got.values()) == len(data)
    assert got[1, "s1"][0] == got[None, "s0"][0] == 10_000
    again = mixing.mix(documents(spark, data).repartition(5))
    assert again.exceptAll(found).count() == 0
