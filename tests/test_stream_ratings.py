"""Streamed Elo equals the ordered fold: any order within the watermark, snapshots behind it, and a stream taken up again."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmark.operators import ratings
from chainmark.plans import flows
from chainmark.streaming import captures
from chainmark.streaming import ratings as streaming

from .oracle import SF


def games(spark: SparkSession, n: int = 160) -> DataFrame:
    a = F.pmod(F.xxhash64("game"), F.lit(5))
    rows = spark.range(n).select(F.concat(F.lit("L"), F.col("id") % 2).alias("league"), F.col("id").alias("game"), F.timestamp_seconds(F.col("id") * 43_200 + 1_000_000_000).alias("ts"), (1 + F.floor(F.col("id") / 60)).cast("int").alias("season"))
    return rows.withColumns({"home": F.concat(F.lit("t"), a), "away": F.concat(F.lit("t"), (a + 1 + F.pmod(F.xxhash64(F.lit(1), "game"), F.lit(4))) % 5), "margin": (F.pmod(F.xxhash64(F.lit(2), "game"), F.lit(31)) - 15).cast("int"), "neutral": F.lit(False)})


def rated(df: DataFrame) -> dict:
    return {r.game: (round(r.home_before, 9), round(r.away_after, 9)) for r in df.collect()}


def source(spark: SparkSession, at: Path) -> DataFrame:
    return spark.readStream.schema(games(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{at}")


def test_late_games_change_later_ratings(spark: SparkSession, tmp_path: Path) -> None:
    """Games come up to five days late, the watermark allows ten: snapshots take the rest, and the result is the fold's."""
    g = games(spark)
    for i in range(4):  # batch i has two weeks of games, without some that come with the next batch
        week = F.floor(F.col("game") / 40)
        late = (F.col("game") % 40 >= 32) & (F.col("game") % 3 == 0)
        g.where((week == i) & ~late | (week == i - 1) & late).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    g.where((F.floor(F.col("game") / 40) == 3) & (F.col("game") % 40 >= 32) & (F.col("game") % 3 == 0)).coalesce(1).write.parquet(f"file://{tmp_path}/in/4")
    whole, at = rated(ratings.elo(g)), f"file://{tmp_path}/run"
    for i in range(5):  # one run of the stream a folder: the state outlives each
        (tmp_path / "now").mkdir(exist_ok=True)
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "now" / f"{i}-{f.name}")
        found = captures.drain(streaming.elo_stream(source(spark, tmp_path / "now"), "10 days"), "update", ["league", "game"], at)
    assert rated(found) == whole


def test_results_behind_the_watermark_are_dropped(spark: SparkSession, tmp_path: Path) -> None:
    g = games(spark, 80)
    (tmp_path / "now").mkdir()
    for i, some in enumerate((g.where("game <> 2"), g.where("game = 79"), g.where("game = 2"))):
        some.coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "now" / f"{i}-{f.name}")
        if i != 1:
            found = captures.drain(streaming.elo_stream(source(spark, tmp_path / "now"), "1 day"), "update", ["league", "game"], f"file://{tmp_path}/run")
    got = rated(found)
    assert 2 not in got and len(got) == 79
    want = rated(ratings.elo(g.where("game <> 2")))
    assert {k: v for k, v in got.items() if k != 79} == {k: v for k, v in want.items() if k != 79}


def test_leagues_kept_together(spark: SparkSession, tmp_path: Path) -> None:
    """Two leagues in one group, the second silent for a while: late games, snapshots and repeats as by themselves, and what did not change is not given out again."""
    g = games(spark, 120)
    whole, at = rated(ratings.elo(g)), f"file://{tmp_path}/run"
    (tmp_path / "now").mkdir()
    late = "league = 'L0' and game in (72, 76)"
    for i, some in enumerate((g.where("game < 60"), g.where(f"game >= 60 and game < 90 and league = 'L0' and not ({late})"), g.where(f"{late} or (game >= 60 and (game >= 90 or league = 'L1')) or game = 88"))):
        some.coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / "now" / f"{i}-{f.name}")
        found = captures.drain(streaming.elo_stream(source(spark, tmp_path / "now"), "20 days", groups=1), "update", ["league", "game"], at)
    assert rated(found) == whole
    given = spark.read.parquet(f"{at}/rows")
    assert given.where("batch = 1 and (league = 'L1' or game < 60)").count() == 0
    assert given.where("league = 'L0' and game < 72").groupBy("game").count().where("count > 1").count() == 0


def test_more_results_make_larger_batches(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A batch rates all games so far, so batches stay four however many files the results have; leagues share groups."""
    monkeypatch.setattr(flows, "ARRIVING", 100)
    found = []

    def drain(rows: DataFrame, mode: str, key: list[str]) -> DataFrame:
        found.append(drained(rows, mode, key))
        return found[0]

    drained = captures.drain
    monkeypatch.setattr(captures, "drain", drain)
    n, orders = flows.stream_elo(spark, SF).count(), spark.read.parquet(f"{SF}/orders.parquet").count()
    assert n == orders > 8 * flows.ARRIVING
    batches = spark.read.parquet(found[0].inputFiles()[0].split("/batch=")[0]).groupBy("batch").count().collect()
    # some rows of each batch, and all games so far in the last
    assert sorted(r.batch for r in batches) == [0, 1, 2, 3] and max(r["count"] for r in batches) > 0.9 * n
