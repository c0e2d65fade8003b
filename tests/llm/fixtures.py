"""Small document tables with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Columns beyond those of documents, named like columns that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key long, score double, t string, n_words long"


def sentence(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    shared = [sentence(r, 30) for _ in range(3)]
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "one two"), (5, sentence(r, 12))]
    base = sentence(r, 60)
    for i in range(6, 30):
        out.append((i, "\n".join(sentence(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 5)))))
    for i in range(30, 40):  # passages in common
        out.append((i, f"{sentence(r, 9)} {shared[i % 3]}\t{sentence(r, 7)}"))
    for i in range(40, 52):  # near copies and exact ones
        words = base.split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    out.append((60, " ".join(f"long{i}" for i in range(60_000))))
    out.append((61, "x" * 200_000))
    out += [(40, out[46][1]), (70, sentence(r, 20)), (70, "another text of this id " + sentence(r, 20)), (None, base), (None, None)]
    return out


def documents(spark: SparkSession, data: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    data = rows() if data is None else data
    full = [(i, t, "en", None if i is not None and i % 7 == 0 else f"s{(i or 0) % 4}", None if t is None else len(t), "d", 1, 0.5, "t", 9) for i, t in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
