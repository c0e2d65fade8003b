"""Run-once tasks, stale captures, incremental tables and replays that are killed and taken up again."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chainmark.operators import ratings, replay
from chainmark.sources.ledger import Captures, Ledger, Materialized, multiset


@pytest.fixture
def ledger(spark: SparkSession, tmp_path: Path) -> Ledger:
    return Ledger(spark, f"file://{tmp_path}/ledger")


def test_a_task_that_fails_half_way_writes_once(spark: SparkSession, ledger: Ledger) -> None:
    calls = []

    def work(folder: str) -> dict:
        calls.append(folder)
        spark.range(10).write.parquet(folder)
        if len(calls) == 1:
            raise OSError("lost half-way")
        return {"n": 10}

    with pytest.raises(OSError, match="half-way"):
        ledger.run_once("day=1", work)
    assert ledger.get("day=1") is None and [x["error"] for x in ledger.dead_letters("day=1")] == ["OSError: lost half-way"]
    first, ran = ledger.run_once("day=1", work)
    again, ran_again = ledger.run_once("day=1", work)
    assert ran and not ran_again and first == again and len(calls) == 2
    assert ledger.read("day=1").count() == 10 and ledger.keys() == ["day=1"]


def test_retries_and_two_attempts_at_once(ledger: Ledger) -> None:
    tries = []

    def twice(folder: str) -> dict:
        tries.append(folder)
        if len(tries) < 3:
            raise ValueError("again")
        return {}

    assert ledger.run_once("a", twice, tries=3)[1] and len(ledger.dead_letters("a")) == 2

    def slow(folder: str) -> dict:
        assert ledger.put("b", {"folder": "other", "who": "first"})  # another attempt commits meanwhile
        return {"who": "second"}

    result, ran = ledger.run_once("b", slow)
    assert not ran and result["who"] == "first" == ledger.get("b")["who"]
    with pytest.raises(ValueError, match="no key"):
        ledger.get("../x")


def test_a_broken_commit_is_none(ledger: Ledger, tmp_path: Path) -> None:
    (tmp_path / "ledger/commits").mkdir(parents=True)
    (tmp_path / "ledger/commits/c.json").write_text("{")
    assert ledger.get("c") is None and ledger.put("c", {"x": 1}) and ledger.get("c") == {"x": 1} and not ledger.put("c", {"x": 2})


def test_stale_captures(spark: SparkSession, ledger: Ledger) -> None:
    captures = Captures(ledger, "odds", timedelta(hours=6))
    now = datetime(2024, 9, 1, 12)

    def broken():
        raise ConnectionError("down")

    with pytest.raises(RuntimeError, match="no capture"):
        captures.take(broken, now)
    good = captures.take(lambda: spark.range(3), now)
    assert (good.status, good.rows.count()) == ("fresh", 3)
    old = captures.take(broken, now + timedelta(hours=2, minutes=30))
    assert (old.status, old.age, old.taken) == ("stale", timedelta(hours=2, minutes=30), now)
    assert {tuple(r)[1:] for r in old.stamped("odds").collect()} == {("stale", 150)}
    assert captures.take(lambda: spark.range(0), now + timedelta(hours=3)).status == "stale"  # empty is no capture
    with pytest.raises(RuntimeError, match="no capture"):
        captures.take(broken, now + timedelta(hours=7))
    assert captures.take(lambda: spark.range(9), now).rows.count() == 3  # taken once


def test_multiset_minds_repeats_not_order(spark: SparkSession) -> None:
    mark = lambda rows: multiset(spark.createDataFrame(rows, "k int, v string, m map<string,int>").repartition(3), ["k"], ["k", "v", "m"]).first().mark
    a, b = (1, "x", {"p": 1, "q": 2}), (1, None, None)
    assert mark([a, b]) == mark([b, a]) != mark([a, a, b]) != mark([a, b, b])
    assert mark([a]) == mark([(1, "x", {"q": 2, "p": 1})]) != mark([(1, "y", {"p": 1, "q": 2})])


def test_one_late_row_computes_one_partition(spark: SparkSession, ledger: Ledger) -> None:
    rows = spark.range(100).selectExpr("cast(id % 5 as int) as day", "id as v")
    table, read = Materialized(ledger, "sums", ["day"]), spark.sparkContext.accumulator(0)

    def sums(df):
        def count(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return df.mapInArrow(count, "day int, v long").groupBy("day").agg(F.sum("v").alias("s"))

    first = table.refresh(rows, "s1", sums)
    assert (first["computed"], first["kept"], first["rows_read"]) == (5, 0, 100)
    again = table.refresh(rows.orderBy(F.desc("v")), "s1", sums)
    assert (again["computed"], again["kept"], again["rows_read"]) == (0, 5, 0)
    before = read.value
    late = rows.unionByName(spark.createDataFrame([(3, 1000)], "day int, v long"))
    third = table.refresh(late, "s1", sums)
    assert (third["computed"], third["kept"], third["rows_read"]) == (1, 4, 21) and read.value - before == 21
    want = {r.day: r.s for r in late.groupBy("day").agg(F.sum("v").alias("s")).collect()}
    assert {r.day: r.s for r in table.read().collect()} == want
    assert {r.day: r.version for r in table.state().collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 1}
    other = table.refresh(late.where("day <> 4"), "s2", sums)  # another specification computes all; one day is gone
    assert (other["computed"], other["removed"]) == (4, 1) and table.read().count() == 4


def games(spark: SparkSession):
    rows = spark.range(240).selectExpr("concat('L', id % 3) as league", "id as game", "cast(1 + id div 60 as int) as season", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, cast(id div 2 as int)) as ts")
    a = F.pmod(F.xxhash64("game"), F.lit(6))
    return rows.select("league", "game", "ts", "season", F.concat(F.lit("t"), a).alias("home"), F.concat(F.lit("t"), (a + 1 + F.pmod(F.xxhash64(F.lit(1), "game"), F.lit(5))) % 6).alias("away"), (F.pmod(F.xxhash64(F.lit(2), "game"), F.lit(41)) - 20).cast("int").alias("margin"), F.lit(False).alias("neutral"))


def test_killed_replay_equals_unbroken_one(spark: SparkSession, ledger: Ledger) -> None:
    g = games(spark)
    steps, first, advance = replay.elo_walk(g)
    whole = replay.Replay(ledger, "whole", steps, "v1")
    assert whole.run(first, advance) == [True] * 4

    def dies(step: object, states: dict):
        if step == 3:
            raise MemoryError("killed")
        return advance(step, states)

    broken = replay.Replay(ledger, "broken", steps, "v1")
    with pytest.raises(MemoryError):
        broken.run(first, dies)
    assert broken.rows().count() == 120
    assert replay.Replay(ledger, "broken", steps, "v1").run(first, advance) == [False, False, True, True]
    columns = ["game", "p_home", "forecast", "forecast_sd", "seen_before", "step"]
    assert sorted(map(str, broken.rows().select(columns).collect())) == sorted(map(str, whole.rows().select(columns).collect()))
    assert replay.Replay(ledger, "broken", steps, "v2").run(first, advance, most=1) == [True]
    elo = {r.game: r.p_home for r in ratings.elo(g).collect()}
    assert {r.game: r.p_home for r in whole.rows().collect()} == elo
    # forecasts of a season know only earlier ones
    assert whole.rows().where("step = 0 and forecast is not null").count() == 0 and whole.rows().where("step > 0 and forecast is null").count() == 0


def test_information_audit_names_what_looked_ahead(spark: SparkSession, ledger: Ledger) -> None:
    g = games(spark)
    steps, first, advance = replay.elo_walk(g)
    walk = replay.Replay(ledger, "audit", steps, "v1")
    walk.run(first, advance)
    rows = walk.rows()
    audit = lambda df: {r.game: r.status for r in replay.information_audit(df, g, "league", "ts", "game", "seen_before").collect()}
    assert set(audit(rows).values()) == {"ok"}
    shifted = rows.withColumn("seen_before", F.when(F.col("game") == 100, F.col("ts")).when(F.col("game") == 101, F.lit(None)).otherwise(F.col("seen_before")))
    found = audit(shifted)
    assert found.pop(100) == "ahead" and found.pop(101) == "missed" and set(found.values()) == {"ok"}
