"""Replays, run-once tasks and incremental tables on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leagues, replay
from ..sources.ledger import Ledger, Materialized
from ..sources.store import delete_on_exit, kept, scratch
from .analytics import _games
from .registry import SQL, query, r6, table


def _ledger(spark: SparkSession) -> Ledger:
    at = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    delete_on_exit(spark, at)
    return Ledger(spark, at)


_RATED = SQL["elo_fold"].replace("SELECT game, round(a, 6) AS home_before", "SELECT game, a - b AS gap, p AS p, round(a, 6) AS home_before")


@query(f"""
    WITH rated AS ({_RATED}),
    r AS (SELECT rated.game, o_custkey // 50 AS league, o_orderdate AS ts, year(o_orderdate) AS season, CAST(trunc(o_totalprice % 41 - 20) AS DOUBLE) AS y, gap AS x, p FROM rated JOIN orders ON game = o_orderkey),
    s AS (SELECT season, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY 1),
    c AS (SELECT season, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT season, n, sx, sy, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM c WHERE n >= 3),
    t AS (SELECT league, ts, lag(ts) OVER (PARTITION BY league ORDER BY ts) AS seen FROM (SELECT DISTINCT league, ts FROM r))
    SELECT game, CAST(season AS INTEGER) AS season, round(p, 6) AS p_home, round((sy - b * sx) / n + b * x, 5) AS forecast, seen AS seen_before, 'ok' AS status FROM r LEFT JOIN f USING (season) JOIN t USING (league, ts)""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of all seasons; the replay is stopped after two steps and taken up again, and every row's information is audited."""
    games = kept(_games(spark, sf_dir), "games")
    steps, first, advance = replay.elo_walk(games)
    ledger = _ledger(spark)
    replay.Replay(ledger, "walk", steps, "elo-1").run(first, advance, most=2)
    again = replay.Replay(ledger, "walk", steps, "elo-1")
    again.run(first, advance)
    rows = again.rows()
    audit = replay.information_audit(rows, games, "league", "ts", "game", "seen_before").select("game", "status")
    return rows.join(audit, "game").select("game", "season", r6("p_home").alias("p_home"), F.round("forecast", 5).alias("forecast"), "seen_before", "status")


@query("""
    WITH o AS (
        SELECT o_custkey // 50 AS league, year(o_orderdate) AS season, c_nationkey AS home, CAST(floor(c_nationkey + 1 + (o_orderkey / 10.0) % 24) AS INTEGER) % 25 AS away FROM orders JOIN customer ON o_custkey = c_custkey),
    t AS (SELECT league, season, home AS team FROM o UNION SELECT league, season, away FROM o), f AS (SELECT league, team, min(season) AS first FROM t GROUP BY ALL),
    n AS (SELECT s.league, s.season, count(*) AS n_teams FROM (SELECT DISTINCT league, season FROM o) s JOIN f ON f.league = s.league AND f.first <= s.season GROUP BY ALL)
    SELECT CAST(league AS VARCHAR) AS league, CAST(season AS INTEGER) AS season, n_games, n_teams, 2 + 5 * n_teams AS dimensions, 0.0 AS centre, 0.0 AS asymmetry, n_games AS n_finite
    FROM n JOIN (SELECT league, season, count(*) AS n_games FROM o GROUP BY ALL) USING (league, season)""")
def league_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing leagues over all seasons: teams are admitted when they first play, the state stays centred and symmetric."""
    games = _games(spark, sf_dir)
    epa = lambda c: (F.col(c) - 20) / 100
    none = F.lit(None).cast("double")
    rows = games.select("league", "season", "week", "game", "ts", "home", "away", epa("home_value").alias("home_epa"), epa("away_value").alias("away_epa"), (60 + F.col("game") % 25).cast("double").alias("home_plays"), none.alias("away_plays"), epa("home_value").alias("home_st"), epa("away_value").alias("away_st"), (60 + F.col("game") % 21).cast("double").alias("pace"), F.col("margin").cast("double").alias("margin"), "neutral", F.lit(False).alias("home_lower"), F.lit(False).alias("away_lower"))
    done = leagues.replay(rows)
    n = F.size("mean")
    at = F.sequence(F.lit(2), n - 1, F.lit(leagues.BLOCK))
    total = lambda d: F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get("mean", i + d))
    centre = F.when(F.col("teams").isNotNull(), F.greatest(F.abs(total(0)), F.abs(total(1))))
    fine = ~F.isnan("log_likelihood") & F.col("home_sd").isNotNull() & (F.size("z") == 5)
    found = done.groupBy("league", "season").agg(F.count("game").alias("n_games"), F.max(F.size("teams")).cast("long").alias("n_teams"), F.max(n).cast("long").alias("dimensions"), F.max(centre).alias("centre"), F.max("asymmetry").alias("asymmetry"), F.count_if(fine).alias("n_finite"))
    return found.select("league", "season", "n_games", "n_teams", "dimensions", r6("centre").alias("centre"), r6("asymmetry").alias("asymmetry"), "n_finite")


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, value, event_id % 997 = 3 AS late FROM events),
    w AS (SELECT day, bool_or(late) AS touched FROM d GROUP BY 1)
    SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total, CASE WHEN any_value(touched) THEN 2 ELSE 1 END AS version FROM d JOIN w USING (day) GROUP BY ALL""")
def incremental_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by day and kind; some events come late, and only their days are computed again."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_id", "event_type", "value")
    days = Materialized(_ledger(spark), "days", ["day"])
    sums = lambda df: df.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    for some in (rows.where("event_id % 997 <> 3"), rows, rows):
        days.refresh(some, "sums-1", sums)
    version = days.state().select("day", "version")
    return days.read().join(F.broadcast(version), "day").select("day", "event_type", "n", F.round("total", 4).alias("total"), "version")  # one row a day
