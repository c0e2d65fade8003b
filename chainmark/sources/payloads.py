"""Nested JSON captures as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

EVENT = "id string, home_team string, away_team string, commence_time timestamp, bookmakers array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>"


def quotes(captures: DataFrame, payload: str = "payload", captured_at: str = "captured_at") -> DataFrame:
    """One row per event, bookmaker, market and outcome of captured JSON events.

    ``n_books`` counts the event's bookmakers. Malformed payloads give no rows.
    """
    event = captures.select(F.col(captured_at).alias("captured_at"), F.from_json(payload, EVENT).alias("e")).where("e.id is not null")
    books = event.select("captured_at", "e.*", F.size(F.array_distinct(F.transform(F.coalesce("e.bookmakers", F.array()), lambda b: b["key"]))).cast("long").alias("n_books"))
    market = books.select("*", F.explode("bookmakers").alias("b")).select("*", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = market.select("*", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    rows = rows.select("id", "home_team", "away_team", F.col("commence_time").alias("kickoff"), "captured_at", "book", "market", F.col("o.name").alias("side"), F.col("o.point").alias("line"), F.col("o.price").alias("price"), "n_books")
    return rows.withColumn("snapshot_id", text.row_id(*[F.col(c).cast("string") for c in ("id", "book", "market", "side", "captured_at")]))


def open_and_close(lines: DataFrame, keys: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for the opening and one for the closing values of each line; all-null rows are left out.

    ``values`` maps each output column to its (opening, closing) input columns.
    """
    of = lambda i, kind: F.struct(F.lit(kind).alias("line_type"), *[F.col(v[i]).alias(k) for k, v in values.items()])
    rows = lines.select(*keys, F.inline(F.array(of(0, "open"), of(1, "close"))))
    return rows.where(F.coalesce(*values).isNotNull())


def at_hour(times: Column, values: Column, hour: Column) -> Column:
    """The value whose parallel time equals ``hour``, null if there is none."""
    at = F.array_position(times, hour)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def aliased(payloads: DataFrame, payload: str, kind: str, aliases: dict[str, tuple[str, ...]], keep: list[str]) -> DataFrame:
    """Rows of a JSON array of objects: each name is the first of its aliases that the object has.

    ``kind`` is the DDL of the object's known fields; malformed payloads give no rows.
    """
    rows = payloads.select(*keep, F.explode(F.from_json(payload, f"array<struct<{kind}>>")).alias("e"))
    return rows.select(*keep, *[F.coalesce(*[F.col(f"e.{a}") for a in of]).alias(n) for n, of in aliases.items()])


GAME = "id: bigint, season: int, week: int, start_date: timestamp_ntz, startDate: timestamp_ntz, completed: boolean, periods: int, home_id: bigint, homeId: bigint, home_points: int, homePoints: int, away_id: bigint, awayId: bigint, away_points: int, awayPoints: int"
GAME_ALIASES = {"game_id": ("id",), "season": ("season",), "week": ("week",), "kickoff": ("start_date", "startDate"), "completed": ("completed",), "periods": ("periods",), "home_id": ("home_id", "homeId"), "away_id": ("away_id", "awayId"), "home_points": ("home_points", "homePoints"), "away_points": ("away_points", "awayPoints")}


def schedule(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Games with the time at which their result was knowable: five hours after kickoff, seven with overtime, null if unplayed."""
    games = aliased(payloads, payload, GAME, GAME_ALIASES, [])
    hours = F.when(F.col("periods") > 4, 7).otherwise(5)
    return games.withColumn("event_time", F.when(F.coalesce("completed", F.lit(False)), F.col("kickoff") + F.make_dt_interval(F.lit(0), hours)))


PLAY = "id: bigint, gameId: bigint, driveId: bigint, offense: string, defense: string, down: int, distance: int, yardsToGoal: int, yardsGained: int, period: int, clock: struct<minutes: int, seconds: int>, offenseScore: int, defenseScore: int, playType: string, ppa: double"


def plays(payloads: DataFrame, teams: DataFrame, payload: str = "payload") -> DataFrame:
    """Plays with team ids by name, the clock in seconds, the margin, and values out of range as null.

    ``teams``: (school, team_id), one row a school, small.
    """
    e = payloads.select(F.explode(F.from_json(payload, f"array<struct<{PLAY}>>")).alias("e")).select("e.*")
    fine = lambda c, low, high: F.when(F.col(c).between(low, high), F.col(c))
    seconds = F.col("clock.minutes") * 60 + F.col("clock.seconds")
    rows = e.select(F.col("gameId").alias("game_id"), F.col("id").alias("play_id"), F.col("driveId").alias("drive_id"), text.normal_name(F.col("offense")).alias("__o"), text.normal_name(F.col("defense")).alias("__d"), fine("down", 0, 4).alias("down"), "distance", fine("yardsToGoal", 0, 100).alias("yards_to_goal"), F.col("yardsGained").alias("yards_gained"), fine("period", 1, 8).alias("period"), F.when(seconds.between(0, 900), seconds).alias("clock"), (F.col("offenseScore") - F.col("defenseScore")).alias("score_margin"), F.col("playType").alias("play_type"), F.col("ppa").alias("epa"))
    side = lambda key, name: teams.select(text.normal_name(F.col("school")).alias(key), F.col("team_id").alias(name))
    return rows.join(side("__o", "offense_id"), "__o", "left").join(side("__d", "defense_id"), "__d", "left").drop("__o", "__d")


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """(path, payload) of every archived file, one row a file, to be parsed anew."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def write_lines(df: DataFrame, folder: str, append: bool = False) -> None:
    """One JSON object a line; ``append`` adds to a ledger, never rewriting what is there."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append" if append else "overwrite").text(folder)


def side_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small configured table (names, overrides); a driver's list, not data."""
    return spark.createDataFrame(rows, schema)
