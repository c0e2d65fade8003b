"""Phrases against plain Python, on awkward rows and with small tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import DataFrame, SparkSession

from chainmark.llm import phrases

from .fixtures import rows

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(data: list[tuple[str | None, str | None]], support: int, top: int = 2000) -> list[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(_LOWER)):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    inside: dict = {}
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, w[i : i + size]
                inside[key] = max(inside.get(key, 0), a)
    out: dict = {}
    for (lang, w), a in candidates.items():
        if 100 * inside.get((lang, w), 0) >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def texts(spark: SparkSession, data: list) -> DataFrame:
    """With columns of names that the operator uses itself."""
    return spark.createDataFrame([(1, t, lang, "p", 3, 4, 5) for lang, t in data], "doc_id long, text string, lang string, phrase string, bucket long, n long, a long").repartition(3)


def got(df: DataFrame) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed: int = 1) -> list[tuple[str | None, str | None]]:
    r = random.Random(seed)
    some = ["New York", "new  york\tcity", "the", "of the", "\u00c9t\u00e9", "\u00e9t\u00e9 \u65e5\u672c", "a b a b", "x", "in the house of", "don't", "\x00", "\u00a0"]
    out: list = [(r.choice(["en", "fr", None, "e n", ""]), "".join(r.choice(some) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(r.randrange(60)))) for _ in range(80)]
    return out + [("en", None), (None, None), ("en", ""), ("en", "..,\n"), ("zz", "only once here")] + [("en", t) for _, t in rows() if t is not None and len(t) < 50_000]


@pytest.mark.parametrize("support,bits", [(30, phrases.BITS), (3, phrases.BITS), (3, 64), (1, 1 << 10)])
def test_equals_plain_python(spark: SparkSession, support: int, bits: int) -> None:
    """With tables of any size: of 64 bits nearly all buckets are full and prune nothing."""
    data = corpus()
    want = brute(data, support)
    assert len(want) > 20
    assert got(phrases.mine(texts(spark, data), support=support, bits=bits)) == want


def test_first_of_each_language(spark: SparkSession) -> None:
    data = corpus(2)
    assert got(phrases.mine(texts(spark, data), support=2, top=7)) == brute(data, 2, 7)


def test_long_texts(spark: SparkSession) -> None:
    data = [("en", t) for _, t in rows() if t is not None and len(t) >= 50_000] + [("en", "over and over again " * 40_000)]
    assert got(phrases.mine(texts(spark, data))) == brute(data, 30)


def test_counts_of_all_lengths(spark: SparkSession) -> None:
    """What pruning keeps out is not frequent, what it lets through is counted exactly."""
    from chainmark.llm.work import Workspace

    found, totals = phrases.frequent(texts(spark, [("en", "a b c d e " * 40)]), Workspace(spark, "test"), support=40)
    by = {r.phrase: r.f for r in found.collect()}
    assert by["a b c d"] == by["a"] == 40 and "e a" not in by and [tuple(r) for r in totals.collect()] == [("en", 200)]


def test_empty_table(spark: SparkSession) -> None:
    assert phrases.mine(texts(spark, [("en", "a")]).limit(0)).count() == 0
