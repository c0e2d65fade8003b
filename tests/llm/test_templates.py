from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.llm import templates

from .fixtures import documents


def dropped(spark: SparkSession, data: list) -> dict:
    found = templates.dedup_lines(documents(spark, data)).select("doc.doc_id", "text", "n_lines", "n_dropped").collect()
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found}


def test_recurring_templates_go_but_for_the_first(spark: SparkSession) -> None:
    data = [(i, f"unique words of {'abcdefg'[i]} only\nuser {i} logged in at 1{i}:00\nanother {'hijklmn'[i]} line here") for i in range(5)]
    found = dropped(spark, data)
    assert found[0] == (data[0][1], 3, 0)
    for i in range(1, 5):
        assert found[i] == (f"unique words of {'abcdefg'[i]} only\nanother {'hijklmn'[i]} line here", 3, 1)


def test_leaf_generalises_by_vote(spark: SparkSession) -> None:
    names = ["anna", "bert", "cleo", "dora"]
    data = [(i, f"intro {n} {n} {n}\nthe site was last seen by {n} on the web\noutro {n} {n}") for i, n in enumerate(names)]
    found = dropped(spark, data)
    assert [found[i][2] for i in range(4)] == [0, 1, 1, 1]


def test_copies_stay_whole(spark: SparkSession) -> None:
    """The same lines in the same surroundings are a copied document, not boilerplate."""
    text = "a first line of words\na second line of words\na third line of words"
    found = dropped(spark, [(i, text) for i in range(9)] + [(20, "something quite different here")])
    assert all(x == (text, 3, 0) for i, x in found.items() if i < 20)


def test_awkward_rows(spark: SparkSession) -> None:
    data = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 100_000), (None, "a b c d\nnull id"), (5, "a b c d\nfive one"), (6, "zz yy\na b c d"), (7, "qq\na b c d\nrr ss"), (7, "qq\na b c d\nrr ss")]
    df = documents(spark, data)
    found = templates.dedup_lines(df)
    assert found.select("doc.*").columns == df.columns
    by = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in found.select("doc.doc_id", "text", "n_lines", "n_dropped").collect()}
    assert by[1, None] == (0, 0)
    assert by[2, ""] == (1, 0)
    assert by[3, "\n\n"] == (3, 0)
    assert by[5, "a b c d\nfive one"] == (2, 0)
    assert by[6, "zz yy"] == (2, 1)
    assert by[None, "null id"] == (2, 1)
    assert found.where("doc.doc_id = 7").select(F.count("*").alias("n")).first().n == 2
    assert templates.dedup_lines(documents(spark, [])).count() == 0
