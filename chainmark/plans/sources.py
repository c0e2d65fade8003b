"""JSON captures, archives, ledgers and feature builders on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builders
from ..sources import payloads
from ..sources.store import scratch
from .registry import query, r6, table


@query("""
    SELECT o_orderkey AS game_id, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderdate AS kickoff, o_custkey AS home_id, CAST(floor(o_totalprice) AS INTEGER) % 50 AS home_points,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR * CASE WHEN o_orderkey % 10 = 0 THEN 7 ELSE 5 END END AS event_time FROM orders""")
def json_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games packed as JSON arrays under two naming styles, and parsed back."""
    o, snake = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    style = lambda c, name, yes: F.when(snake if yes else ~snake, c).alias(name)
    when, home, points = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_custkey"), F.floor("o_totalprice").cast("int") % 50
    game = F.struct(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("season"), style(when, "start_date", True), style(when, "startDate", False), (F.col("o_orderstatus") != "O").alias("completed"), F.when(F.col("o_orderkey") % 10 == 0, 5).otherwise(4).alias("periods"), style(home, "home_id", True), style(home, "homeId", False), style(points, "home_points", True), style(points, "homePoints", False))
    packed = o.groupBy("o_custkey").agg(F.to_json(F.collect_list(game)).alias("payload")).select("payload")
    return payloads.schedule(packed).select("game_id", "season", "kickoff", "home_id", "home_points", "event_time")


@query("""
    SELECT l_orderkey AS game_id, l_orderkey * 10 + l_linenumber AS play_id, n_nationkey AS offense_id, CASE WHEN l_linenumber BETWEEN 0 AND 4 THEN l_linenumber END AS down, CASE WHEN l_quantity * 3 <= 100 THEN CAST(floor(l_quantity * 3) AS INTEGER) END AS yards_to_goal,
        CASE WHEN l_linenumber * 200 + 7 <= 900 THEN l_linenumber * 200 + 7 END AS clock, CAST(l_linenumber - 3 AS INTEGER) AS score_margin FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25""")
def json_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # noqa: E741
    rows = l.join(n, F.col("l_suppkey") % 25 == F.col("n_nationkey"))
    clock, no = F.col("l_linenumber") * 200 + 7, F.col("l_linenumber")
    play = F.struct((F.col("l_orderkey") * 10 + no).alias("id"), F.col("l_orderkey").alias("gameId"), F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("offense"), no.alias("down"), F.floor(F.col("l_quantity") * 3).cast("int").alias("yardsToGoal"), F.struct(F.floor(clock / 60).cast("int").alias("minutes"), (clock % 60).cast("int").alias("seconds")).alias("clock"), no.alias("offenseScore"), F.lit(3).alias("defenseScore"))
    packed = rows.groupBy("l_orderkey").agg(F.to_json(F.collect_list(play)).alias("payload"))
    found = payloads.plays(packed, n.select(F.col("n_name").alias("school"), F.col("n_nationkey").alias("team_id")))
    return found.select("game_id", "play_id", "offense_id", "down", "yards_to_goal", "clock", "score_margin")


@query("SELECT o_custkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season, round(max(o_totalprice), 2) AS talent FROM orders GROUP BY ALL")
def archive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows written as archived JSON files, read whole and parsed anew."""
    at = f"{scratch(spark)}/archive-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("teamId"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("talent"))
    rows.groupBy("year").agg(F.to_json(F.collect_list(F.struct("teamId", "year", "talent"))).alias("value")).repartition("year").select("value").write.text(at)
    lines = payloads.replay(spark, at).select(F.explode(F.split("payload", "\n")).alias("payload"))
    found = payloads.aliased(lines, "payload", "team_id: bigint, teamId: bigint, year: int, season: int, talent: double", {"team": ("team_id", "teamId"), "season": ("season", "year"), "talent": ("talent",)}, [])
    return found.select("team", "season", F.round("talent", 2).alias("talent"))


@query("SELECT n_nationkey, n_name, 'renamed ' || n_name AS alias, CASE WHEN n_nationkey < 3 THEN 2 ELSE 1 END AS versions FROM nation")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only ledger of JSON lines with a side table of names; the last version counts."""
    at = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    payloads.write_lines(n.withColumn("version", F.lit(1)), at)
    payloads.write_lines(n.where("n_nationkey < 3").withColumn("version", F.lit(2)), at, append=True)
    rows = spark.read.schema("n_nationkey long, n_name string, version int").json(at)
    prefix = payloads.side_table(spark, [{"prefix": "renamed"}], "prefix string")
    counted = rows.groupBy("n_nationkey").agg(F.max_by("n_name", "version").alias("n_name"), F.count("*").cast("int").alias("versions"))
    return counted.crossJoin(F.broadcast(prefix)).select("n_nationkey", "n_name", F.concat_ws(" ", "prefix", "n_name").alias("alias"), "versions")


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, n, round(mean, 6) AS mean, mean IS NULL AS mean_is_missing FROM a WHERE o_custkey % 3 = 0), m AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1)
    SELECT b.*, newest > TIMESTAMP '1998-01-01' AS stale FROM b JOIN m USING (o_custkey)""")
def builder_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A builder over history before a bound, run only for units that are not stored, with what is stale by now."""
    bound = F.lit("1998-01-01").cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders")

    def build(history: builders.History) -> DataFrame:
        return history.before("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))).alias("mean"))

    history = builders.History({"orders": orders}, {"orders": "o_orderdate"}, bound)
    found = builders.Builder("customer means", ("o_custkey",), build, {"n": "forbid", "mean": "indicator"}).run(history)
    stored = orders.select("o_custkey").distinct().where("o_custkey % 3 <> 0")
    fresh = builders.new_rows(found, stored, ["o_custkey"]).withColumn("built", bound)
    return builders.stale(fresh, orders, ["o_custkey"], "built", "o_orderdate").drop("built")
