"""Stores: writes that change nothing are not made, reruns leave the quarantine as it is."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import quality
from chainmark.sources.store import Store, TableSpec

SPEC = TableSpec("t", "k long, v int, season int", ("season",), ("season", "k"))


def frame(spark: SparkSession, rows: list[tuple]):
    return spark.createDataFrame(rows, SPEC.columns)


def test_equal_rows_are_not_written_again(spark: SparkSession, tmp_path: Path) -> None:
    store = Store(spark, f"file://{tmp_path}", [SPEC])
    rows = frame(spark, [(1, 5, 2020), (2, 6, 2021)])
    assert store.overwrite(rows, "t", compare=True)
    files = sorted(p.name for p in (tmp_path / "t").rglob("*.parquet"))
    assert not store.overwrite(rows.orderBy(F.desc("k")), "t", compare=True)
    assert not store.overwrite(rows.where("season = 2020"), "t", compare=True)
    assert files == sorted(p.name for p in (tmp_path / "t").rglob("*.parquet"))
    assert store.overwrite(frame(spark, [(1, 7, 2020)]), "t", compare=True)
    assert {tuple(r) for r in store.read("t").collect()} == {(1, 7, 2020), (2, 6, 2021)}


def test_a_rerun_does_not_double_the_quarantine(spark: SparkSession, tmp_path: Path) -> None:
    store = Store(spark, f"file://{tmp_path}", [SPEC])
    rules = [quality.between("v", 0, 9)]
    for _ in range(2):
        store.append_checked(frame(spark, [(1, 5, 2020), (2, 99, 2020)]), "t", rules, F.col("v"), "first")
    store.append_checked(frame(spark, [(3, -1, 2020)]), "t", rules, F.col("v"), "second")
    assert sorted((r.k, r.origin) for r in store.quarantined("t").collect()) == [(2, "first"), (3, "second")]
    assert store.read("t").count() == 1
