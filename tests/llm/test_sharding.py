"""Shards: even, with equal texts together, numbered without gaps; every column against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

from chainmark.llm import sharding
from chainmark.llm.queries import QUERIES

from ..oracle import from_sql
from .fixtures import documents, rows, sentence

SF = "/root/testdata/sf0.01"


def size(t: str | None) -> int:
    return len((t or "").encode()) + 1


def same(found: list, data: list[tuple]) -> None:
    """Rows and columns that need no placement."""
    want = Counter((i, size(t), zlib.crc32((t or "").encode()), "bytes", None) for i, t in data)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert set(by) <= set(range(sharding.SHARDS))


def loads(found: list) -> list[int]:
    out = Counter()
    for r in found:
        out[r.shard] += r.size
    return [out[i] for i in range(sharding.SHARDS)]


def run(docs: DataFrame, **options: object) -> list:
    return sharding.shard(docs, **options).select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()


def test_awkward_rows(spark: SparkSession) -> None:
    found = run(documents(spark))
    same(found, rows())
    # one text is more than a shard's share: the others are still even
    largest = max(size(t) for _, t in rows())
    assert max(loads(found)) < largest + sum(size(t) for _, t in rows()) / sharding.SHARDS


def grouped(seed: int, groups: list[int], single: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    texts = [sentence(r, r.randrange(20, 60)) for _ in groups]
    out = [t for t, n in zip(texts, groups, strict=True) for _ in range(n)] + [sentence(r, r.randrange(5, 120), 10**6) for _ in range(single)]
    r.shuffle(out)
    return list(enumerate(out))


def test_groups_stay_whole_and_shards_even(spark: SparkSession) -> None:
    data = grouped(1, [2] * 60 + [3] * 40 + [25, 40, 80], 1500)
    found = run(documents(spark, data))
    same(found, data)
    share = sum(loads(found)) / sharding.SHARDS
    assert max(loads(found)) <= 1.01 * share and min(loads(found)) >= 0.98 * share
    by = defaultdict(set)
    for r in found:
        by[r.text_crc32].add(r.shard)
    copies = Counter(zlib.crc32(t.encode()) for _, t in data)
    assert all(len(by[c]) == 1 for c, n in copies.items() if n > 1)


def test_group_larger_than_a_shard(spark: SparkSession) -> None:
    """A third of all rows are one text: it takes as few shards as its parts need; others stay whole."""
    data = grouped(2, [600] + [2] * 100, 1000)
    found = run(documents(spark, data))
    same(found, data)
    share = sum(loads(found)) / sharding.SHARDS
    assert max(loads(found)) <= 1.02 * share
    by, n = defaultdict(Counter), Counter(zlib.crc32(t.encode()) for _, t in data)
    for r in found:
        by[r.text_crc32][r.shard] += 1
    large = by[n.most_common(1)[0][0]]
    need = 600 * next(r.size for r in found if r.text_crc32 == n.most_common(1)[0][0]) / share
    assert len(large) <= need / sharding.FULL + 2
    assert sum(len(by[c]) > 1 for c, k in n.items() if k == 2) == 0


def test_only_linked_documents(spark: SparkSession) -> None:
    data = grouped(3, [4] * 300, 0)
    found = run(documents(spark, data))
    same(found, data)
    share = sum(loads(found)) / sharding.SHARDS
    assert max(loads(found)) <= 1.05 * share
    by = defaultdict(set)
    for r in found:
        by[r.text_crc32].add(r.shard)
    # a group is a twentieth of a shard: the last ones fit nowhere whole
    assert sum(len(x) > 1 for x in by.values()) <= 15


def test_several_kinds_of_links(spark: SparkSession) -> None:
    """Rows follow the hub with most votes; hubs that share no rows stay whole."""
    r = random.Random(4)
    data = [(i, sentence(r, 20, 10**6)) for i in range(400)]
    docs = documents(spark, data).selectExpr("*", "case when doc_id < 40 then doc_id div 4 end as host", "case when doc_id between 50 and 59 then 1 end as owner")
    found = sharding.shard(docs, by=["host", "owner"]).select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    same(found, data)
    at = {x.doc_id: x.shard for x in found}
    assert all(len({at[4 * k + i] for i in range(4)}) == 1 for k in range(10))
    assert len({at[i] for i in range(50, 60)}) == 1


def test_reruns_agree(spark: SparkSession) -> None:
    docs = documents(spark, grouped(5, [3] * 20, 100)).coalesce(1)
    assert sorted(run(docs)) == sorted(run(docs))


def test_empty_table(spark: SparkSession) -> None:
    assert run(documents(spark).limit(0)) == []


def test_query_on_whole_documents(spark: SparkSession) -> None:
    data = from_sql("SELECT doc_id, text FROM documents", SF)
    pairs = list(zip(data.doc_id.tolist(), data.text.tolist(), strict=True))
    found = QUERIES["op12_sharding"](spark, SF).collect()
    same(found, pairs)
    share = sum(loads(found)) / sharding.SHARDS
    assert max(loads(found)) <= 1.01 * share
    by, bytes_ = defaultdict(set), Counter()
    for r in found:
        by[r.text_crc32].add(r.shard)
        bytes_[r.text_crc32] += r.size
    assert all(len(x) == 1 for c, x in by.items() if bytes_[c] > 100 and bytes_[c] < sharding.FULL * share)
