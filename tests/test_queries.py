"""Every analytics query with SQL gives the SQL's rows, to the sixth digit; those without give rows."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from chainmark.catalog import QUERIES, SQL

from .oracle import SF, from_sql, plain

#: Queries whose values lie on limits or have long means: the smallest tables miss such rows.
EDGES = ["tier_hysteresis", "metric_slices", "disagreement_slices", "forecast_comparison", "entity_forms", "interval_coverage", "book_reconcile", "team_priors"]


def same(spark: SparkSession, name: str, sf_dir: str) -> None:
    got, want = QUERIES[name](spark, sf_dir).toPandas(), from_sql(SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    if a != b:  # a double may round either way in its sixth digit
        for x, y in zip(a, b, strict=True):
            for p, q in zip(x, y, strict=True):
                assert p == q or abs(float(p) - float(q)) <= 1.000001e-6, (x, y)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark: SparkSession, name: str) -> None:
    same(spark, name, SF)


@pytest.mark.parametrize("name", EDGES)
def test_edges_equal_sql(spark: SparkSession, name: str) -> None:
    same(spark, name, "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark: SparkSession, name: str) -> None:
    assert QUERIES[name](spark, SF).count() > 0
