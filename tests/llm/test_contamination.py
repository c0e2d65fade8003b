"""Against a brute-force scan; neither full bit tables nor the kind of join change the result."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import SparkSession

from chainmark.llm import contamination

from .fixtures import documents, rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t: str | None) -> list[str]:
    return WORD.findall((t or "").translate(LOWER))


def brute(docs: list, items: list) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1) if n and i is not None else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = {len(g) for g in windows}
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    hit.update(range(p, p + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case() -> tuple[list, list]:
    r = random.Random(8)
    items = [(i, sentence(r, n)) for i, n in enumerate((40, 25, 13, 12, 3, 1, 20, 20))]
    items += [(8, None), (9, " .!"), (None, sentence(r, 20)), (2, sentence(r, 15)), (10, items[0][1])]
    docs = rows()
    docs += [(80 + i, f"{sentence(r, 30)}. {items[i][1].upper()}! {sentence(r, 5)}") for i in range(8)]
    docs += [(90, items[0][1].replace(" ", " -- ")), (91, sentence(r, 2000) + " " + items[2][1]), (92, "Éa " + items[1][1] + " é")]
    return docs, items


@pytest.mark.parametrize(("bits", "rows_"), [(1 << 26, 200_000), (64, 0)])
def test_equals_brute_force(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, bits: int, rows_: int) -> None:
    monkeypatch.setattr(contamination, "BITS", bits)
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", rows_)
    docs, items = case()
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, n int, words string")
    found = contamination.annotate(documents(spark, docs), bench, keep=["doc_id"]).collect()
    assert sorted(((r.doc.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=repr) == brute(docs, items)


def test_preamble_of_very_many_items(spark: SparkSession) -> None:
    """A window that all items share is one window; documents that hold it name all of them."""
    r = random.Random(2)
    head = sentence(r, 30)
    items = [(i, f"{head} q{i} {sentence(r, 3)}") for i in range(3000)]
    docs = [(1, head), (2, f"{items[7][1]} end"), (3, sentence(r, 50))]
    found = contamination.annotate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"]).collect()
    assert sorted(((x.doc.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in found), key=repr) == brute(docs, items)


def test_filter_keeps_columns_and_clean_documents(spark: SparkSession) -> None:
    docs, items = case()
    df = documents(spark, docs)
    clean = contamination.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(d[0]), str(d[1])) for d, b in zip(sorted(docs, key=repr), sorted(docs, key=repr), strict=True) if not brute([b], items)[0][-1])


def test_empty_tables(spark: SparkSession) -> None:
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination.annotate(documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in contamination.annotate(documents(spark), bench, keep=["doc_id"]).collect())
