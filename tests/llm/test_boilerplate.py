"""Boilerplate with fixed neighbours goes; edited copies stay whole."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from chainmark.llm.queries import QUERIES

from .test_templates import dropped

WORDS = [a + b for a in "bcdfghjklm" for b in ("ane", "ilo", "orra")]


def own(i: int, n: int = 3) -> str:
    return "\n".join(" ".join(f"{WORDS[(i + k) % 30]}{WORDS[(7 * i + j) % 30]}" for k in range(5 + j)) for j in range(n))


def test_lines_between_blank_lines_go(spark: SparkSession) -> None:
    data = [(i, f"{own(i)}\n\nread more on our site\n\n{own(i + 11)}") for i in range(6)]
    assert [x[2] for _, x in sorted(dropped(spark, data).items())] == [0, 1, 1, 1, 1, 1]


def test_passages_and_footers_go_whole(spark: SparkSession) -> None:
    footer = "follow us for more news\nsubscribe to our letter now\nall content is our own"
    found = dropped(spark, [(i, f"{own(i)}\n{footer}") for i in range(6)])
    assert [x[2] for _, x in sorted(found.items())] == [0, 3, 3, 3, 3, 3]
    assert all(found[i][0] == own(i) for i in range(1, 6))


def test_edited_copies_count_once(spark: SparkSession) -> None:
    line = "shared by several unrelated pages"
    base = [f"{WORDS[k]} opens this copied page line {WORDS[k + 1]} {WORDS[k + 2]}" for k in range(12)]
    copies = [(100 + i, "\n".join([*base[: i % 12], f"an edit {WORDS[i]} of {WORDS[29 - i]} here", *base[i % 12 + 1 :], line])) for i in range(24)]
    found = dropped(spark, [*((i, f"{own(i)}\n{line}") for i in range(4)), *copies])
    assert [found[i][2] for i in range(4)] == [0, 1, 1, 1]
    assert all(found[i][:1] == (text.removesuffix(f"\n{line}"),) for i, text in copies)
    alone = dropped(spark, [(i, text.removesuffix(f"\n{line}")) for i, text in copies])
    assert all(x[2] == 0 for x in alone.values())


def test_the_registered_query_drops_whole_footers(spark: SparkSession, tmp_path: Path) -> None:
    footer = "follow us for more news\nsubscribe to our letter now\nall content is our own"
    spark.createDataFrame([(i, f"{own(i)}\n{footer}") for i in range(6)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r.doc_id: r.n_dropped for r in QUERIES["op5_lines"](spark, f"file://{tmp_path}").collect()}
    assert found == {0: 0} | dict.fromkeys(range(1, 6), 3)
