"""Against a brute-force version, window by window."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import SparkSession

from chainmark.llm import substrings

from .fixtures import documents, rows, sentence


def brute(data: list, k: int) -> list[tuple]:
    last = 2**63 - 1
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in data]
    for i, w in split:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, last), last if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (last if i is None else i):
                gone.update(range(p, p + k))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "m"), [(13, 5), (6, 3)])
def test_equals_brute_force(spark: SparkSession, k: int, m: int) -> None:
    data = rows()
    found = substrings.dedup_substrings(documents(spark, data), k=k, m=m).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found), key=repr) == brute(data, k)
    assert sum(r.n_removed for r in found) > 0
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_empty_table(spark: SparkSession) -> None:
    assert substrings.dedup_substrings(documents(spark, [])).count() == 0


def test_window_bounds(spark: SparkSession) -> None:
    with pytest.raises(ValueError, match="minimizers"):
        substrings.dedup_substrings(documents(spark, []), k=40, m=5)


def test_many_rows_of_one_id_and_of_none(spark: SparkSession) -> None:
    """Rows of one id are told apart by their texts, however many there are."""
    r = random.Random(8)
    passage, other = sentence(r, 20), sentence(r, 25)
    data = [(1, passage), (2, f"x y {other}"), (2, f"x y {other}")]
    data += [(None, f"n{i} {passage} {'m ' * (i % 3)}{other if i % 5 == 0 else ''} e{i}") for i in range(20_000)]
    data += [(7, f"o{i} {other} {passage if i % 7 == 0 else 'short'} f{i}") for i in range(20_000)]
    found = substrings.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found), key=repr) == brute(data, 13)


def test_nonbranching_paths_compact(spark: SparkSession) -> None:
    """A passage that always occurs whole is one path, whatever the number of its pieces."""
    one = lambda i: (i, 0, i)
    paths = [(10 + i, 20 + i, 2, *one(5), 9, 20 + i - 1 if i else 0, 20 + i + 1 if i < 5 else 0) for i in range(6)]
    paths = [(m, p, n, 5, 0, 2 * i, last, a, b) for i, (m, p, n, _, _, _, last, a, b) in enumerate(paths)]
    paths[3] = (*paths[3][:7], 0, paths[3][8])  # another document reaches the fourth piece by another way
    df = spark.createDataFrame(paths, "minimizer long, piece long, size long, source long, source_key long, source_at long, last long, only_prior long, only_following long")
    found = sorted((r.piece, r.windows, r.source_at) for r in substrings.compact(df).collect())
    assert found == [(20, 6, 0), (23, 6, 6)]


def test_refuses_what_the_source_does_not_say(spark: SparkSession) -> None:
    """The remover compares the copy's words with the digest of the source's."""
    words = " ".join(f"w{i}" for i in range(20))
    fine = hashlib.sha256(" ".join(f"w{i}" for i in range(2, 16)).encode()).digest()[:16]
    data = [(1, words, [(2, 2, fine)]), (2, words, [(3, 2, fine)])]
    df = spark.createDataFrame(data, "doc_id long, text string, covered array<struct<at: long, windows: long, digest: binary>>")
    found = df.mapInArrow(substrings._remover(13, False), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept_text string")
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 14), (2, 0)]
