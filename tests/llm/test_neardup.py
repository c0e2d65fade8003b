"""Against all pairs; signatures against exact similarity."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from chainmark.llm import neardup
from chainmark.llm.components import components
from chainmark.llm.work import Workspace

from .fixtures import documents, rows, sentence

LOWER = bytes(range(256)).lower()


def shingles(t: str | None) -> frozenset:
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data: list) -> list[tuple]:
    sets = [(i, shingles(t)) for i, t in data]
    root = {i: i for i, _ in sets if i is not None}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    out = []
    for i, x in sets:
        c = i if i is None or not x else find(i)
        out.append((i, len(x), c, c == i))
    return sorted(out, key=repr)


def test_equals_all_pairs(spark: SparkSession) -> None:
    data = rows()
    found = neardup.near_duplicates(documents(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr) == brute(data)


def test_groups_with_failed_comparisons(spark: SparkSession) -> None:
    """Chains of edits: ends are far apart, neighbours are linked."""
    r = random.Random(2)
    words = [f"v{r.randrange(500)}" for _ in range(80)]
    data = []
    for i in range(40):
        data.append((1000 - i, " ".join(words)))
        words = words[2:] + [f"v{r.randrange(500)}" for _ in range(2)]
    found = neardup.near_duplicates(documents(spark, data)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in found), key=repr) == brute(data)


def test_loose_group_and_templates(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A passage in all texts, a few of them linked, and texts from one template that are linked only by chance."""
    monkeypatch.setattr(neardup, "RARE", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(3)
    passage = sentence(r, 60)
    data = [(i, f"{sentence(r, 15)} {passage} {sentence(r, 25)}") for i in range(150)]
    for i in range(150, 200):  # edited copies of some of them
        words = data[i % 10][1].split()
        words[r.randrange(len(words))] = "edit"
        data.append((i, " ".join(words)))
    base = sentence(r, 100).split()
    for i in range(200, 380):
        words = list(base)
        for k in range(0, 100, 12):
            words[k] = r.choice(["red", "blue", words[k], words[k]])
        data.append((i, " ".join(words)))
    found = neardup.near_duplicates(documents(spark, data)).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in found), key=repr) == brute(data)


def test_loose_group_takes_linear_work(spark: SparkSession) -> None:
    """Two thousand texts around one passage: nearly no pair is formed, and none in cells."""
    r = random.Random(6)
    common = [r.randrange(2**62) for _ in range(80)]
    sets = [(i, np.sort(np.array(common + [r.randrange(2**62) for _ in range(20)], np.int64)).tobytes()) for i in range(2000)]
    sets += [(5000 + i, np.sort(np.append(np.frombuffer(sets[i][1], np.int64)[:-1], i)).tobytes()) for i in range(20)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in sets], "node long, items binary")
    work = Workspace(spark, "t")
    nodes = work.keep(neardup.weighed(df.selectExpr("node", "node as part"), df, work), "nodes")
    assert nodes.where("common >= need").count() == 0
    pairs = {(x.a, x.b) for x in neardup.sharing_rare(nodes).collect()}
    assert {(i, 5000 + i) for i in range(20)} <= pairs
    assert len(pairs) < 100


def test_recall_over_many_pairs() -> None:
    """Pairs of similarity 0.75 share a band, but for one in many thousands."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        both, rest = rng.integers(1, 2**63, 150, dtype=np.uint64), rng.integers(1, 2**63, 50, dtype=np.uint64)
        a, b = np.sort(np.concatenate([both, rest[:25]])), np.sort(np.concatenate([both, rest[25:]]))
        keys = neardup.bands(neardup.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)])))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_empty(spark: SparkSession) -> None:
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 5, 60, 700])
def test_signatures_estimate_similarity(n: int) -> None:
    rng = np.random.default_rng(n)
    pool = rng.integers(1, 2**63, 2 * n + 2, dtype=np.uint64)
    a, b = np.unique(pool[: n + n // 2 + 1]), np.unique(pool[n // 2 :])
    s = neardup.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.2
    assert (s >= 0).all()
    alone = neardup.superminhash(b, np.array([len(b)]))
    assert (alone[0] == s[1]).all()


def test_components(spark: SparkSession) -> None:
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 70), (200, 200), (5, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.u: r.v for r in components(df, Workspace(spark, "t"), "c").collect()}
    assert found == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50}
