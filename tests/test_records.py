"""What is refused, and the parts of records and builders that have no rows to compare."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import builders, records


def test_locked_seasons_are_refused(spark: SparkSession) -> None:
    df = spark.createDataFrame([(2024,), (2025,)], "season int")
    assert records.lockbox(df, "season", [2025], confirmatory=True).count() == 2
    with pytest.raises(PySparkException, match="locked"):
        records.lockbox(df, "season", [2025]).collect()


def test_published_fields(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, [(2.0, 3.0)])], "game int, odds array<struct<line: double, stake: double>>")
    assert records.publishable(df, {"game", "odds"}, {"bankroll"}) is df
    with pytest.raises(ValueError, match=r"odds\.stake"):
        records.publishable(df, {"game", "odds"}, {"stake"})
    with pytest.raises(ValueError, match="not allowed: odds"):
        records.publishable(df, {"game"}, set())


def test_every_row_needs_a_match(spark: SparkSession) -> None:
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "k int, x int, at int")
    assert records.require_one(left.where("k = 1"), right, ["k"], ["at"]).first().x == 6
    with pytest.raises(PySparkException, match="no feature row for 2"):
        records.require_one(left, right, ["k"], ["at"]).collect()


def test_signatures() -> None:
    assert len(records.feature_hash(["a", "b"])) == 12
    assert records.feature_hash(["a", "b"]) != records.feature_hash(["b", "a"])


def test_signature_of_a_frame(spark: SparkSession) -> None:
    df = spark.range(1).withColumn("x", F.lit(1.0))
    assert records.same_signature(df, [("id", "bigint"), ("x", "double")]) is df
    with pytest.raises(ValueError, match="expected"):
        records.same_signature(df, [("x", "double"), ("id", "bigint")])


def test_builders_keep_their_contract(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, 1.0, 5), (1, None, 6), (2, None, 5), (3, 2.0, 9)], "k int, x double, at int")
    history = builders.History({"t": rows}, {"t": "at"}, F.lit(9))
    assert history.before("t").count() == 3
    with pytest.raises(KeyError, match="unknown table"):
        history.before("u")
    build = lambda h: h.before("t").groupBy("k").agg(F.max("x").alias("x"))
    run = lambda policy: builders.Builder("b", ("k",), build, {"x": policy}).run(history)
    assert {(r.k, r.x, r.x_is_missing) for r in run("indicator").collect()} == {(1, 1.0, False), (2, None, True)}
    assert run("allow").columns == ["k", "x"]
    with pytest.raises(PySparkException, match="x is null"):
        run("forbid").collect()
    with pytest.raises(ValueError, match="lacks y"):
        builders.Builder("b", ("k",), build, {"y": "allow"}).run(history)
