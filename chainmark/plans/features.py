"""Feature families on line items read as plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from .registry import query, r6, table

_LABELS = ("Rush", "Pass Reception", "Pass Incompletion", "Sack", "Rushing Touchdown", "Kickoff", "Penalty", "Interception", "Punt", "Fumble Recovery (Opponent)", "Rush", "Kneel Down")
#: Columns of a play as expressions that Spark and DuckDB read alike.
_PLAY = {
    "game_id": "l_orderkey",
    "play_id": "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey",
    "drive_id": "CAST(floor(l_linenumber / 3.0) AS INTEGER)",
    "offense_id": "l_suppkey % 40",
    "defense_id": "l_suppkey % 40 + 1",
    "play_type": "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END",
    "down": "l_partkey % 5",
    "distance": "l_suppkey % 12",
    "yards_gained": "CAST(floor(l_quantity) AS INTEGER) % 15 - 3",
    "period": "1 + l_partkey % 2 + CAST(floor(l_linenumber / 3.0) AS INTEGER)",
    "clock": "900 - l_linenumber * 40 - l_partkey % 37",
    "score_margin": "CAST(floor(l_extendedprice) AS INTEGER) % 61 - 30",
    "wp_before": "CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 101 AS DOUBLE) / 100 END",
    "epa": "CAST(CAST(floor(l_extendedprice) AS INTEGER) % 700 AS DOUBLE) / 100 - 3",
}
_BASE = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PLAY.items()) + " FROM lineitem"
_FLAGS = """
    SELECT *, play_type IN ('Rush', 'Rushing Touchdown') AS is_rush, play_type IN ('Pass Reception', 'Pass Incompletion', 'Passing Touchdown', 'Sack', 'Interception', 'Interception Return Touchdown', 'Pass Interception Return') AS is_pass,
        play_type IN ('Kickoff', 'Punt') AS is_special_teams, play_type = 'Penalty' AS is_penalty, play_type IN ('Sack', 'Interception', 'Fumble Recovery (Opponent)') AS is_havoc,
        CASE WHEN down BETWEEN 1 AND 4 THEN yards_gained >= distance * CASE down WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END END AS is_success,
        CASE WHEN wp_before IS NOT NULL THEN wp_before > 0.98 OR wp_before < 0.02 ELSE abs(score_margin) > CASE WHEN period = 1 THEN 28 WHEN period = 2 THEN 24 WHEN period = 3 THEN 21 ELSE 16 END END AS garbage_time,
        CASE WHEN wp_before IS NOT NULL THEN 'wp' ELSE 'connelly_fallback' END AS gt_rule, wp_before IS NULL AS gt_fallback_used
    FROM b"""
_PLAYS = f"b AS ({_BASE}), plays AS ({_FLAGS}), snaps AS (SELECT * FROM plays WHERE NOT garbage_time AND (is_rush OR is_pass))"
_DRIVES = "drives AS (SELECT o_orderkey AS game_id, CAST(o_custkey % 40 AS BIGINT) AS offense_id, CAST(floor(o_totalprice) AS INTEGER) % 90 AS start_yards_to_goal, CAST(floor(o_totalprice) AS INTEGER) % 8 AS points FROM orders)"


def _plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _PLAY.items()])
    # two names of the play's label, as staged and as raw captures have it
    raw = raw.withColumnRenamed("play_type", "playType").withColumn("type", F.lit(None).cast("string"))
    return features.normalise(raw, {n: ("type", "playType") if n == "play_type" else (n,) for n in _PLAY})


def _drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 40).cast("long").alias("offense_id"), (price % 90).alias("start_yards_to_goal"), (price % 8).alias("points"))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) if t in ("double", "decimal") else F.col(c) for c, t in df.dtypes if c not in keys])


@query(f"WITH {_PLAYS} SELECT game_id, play_id, is_rush, is_pass, is_special_teams, is_penalty, is_havoc, is_success, garbage_time, gt_rule, gt_fallback_used FROM plays")
def play_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plays(spark, sf_dir).select("game_id", "play_id", "is_rush", "is_pass", "is_special_teams", "is_penalty", "is_havoc", "is_success", "garbage_time", "gt_rule", "gt_fallback_used")


@query(f"WITH {_PLAYS} SELECT gt_rule, count(*) AS n, round(avg(CASE WHEN garbage_time THEN 1.0 ELSE 0.0 END), 6) AS share FROM plays GROUP BY 1")
def garbage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plays(spark, sf_dir).groupBy("gt_rule").agg(F.count("*").alias("n"), r6(F.avg(F.col("garbage_time").cast("double"))).alias("share"))


def _block(p: str, f: str) -> str:
    return f"round(avg(epa) FILTER ({f}), 6) AS {p}epa_per_play, round(avg(CAST(is_success AS INTEGER)) FILTER ({f}), 6) AS {p}success_rate, round(avg(epa) FILTER ({f} AND is_success), 6) AS {p}explosiveness, round(avg(CAST(is_havoc AS INTEGER)) FILTER ({f}), 6) AS {p}havoc_rate, count(*) FILTER ({f}) AS {p}n_plays"


_EFFICIENCY = f"e AS (SELECT game_id, offense_id, defense_id, {_block('', 'true')}, {_block('rush_', 'is_rush')}, {_block('pass_', 'is_pass')} FROM snaps GROUP BY ALL)"
_METRICS = "dm AS (SELECT game_id, offense_id, round(avg(points) FILTER (start_yards_to_goal <= 40), 6) AS finishing_drives, round(avg(100 - start_yards_to_goal), 6) AS field_position FROM drives GROUP BY ALL)"


@query(f"WITH {_PLAYS}, {_EFFICIENCY} SELECT * FROM e")
def game_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.game_efficiency(_plays(spark, sf_dir)), ["game_id", "offense_id", "defense_id"])


@query(f"WITH {_DRIVES}, {_METRICS} SELECT * FROM dm")
def drive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.drive_metrics(_drives(spark, sf_dir)), ["game_id", "offense_id"])


@query(f"""
    WITH {_PLAYS}, {_EFFICIENCY}, {_DRIVES}, {_METRICS}, g AS (SELECT o_orderkey AS game_id, o_custkey % 40 AS home_id, o_orderkey % 4 = 0 AS neutral FROM orders), m AS (SELECT DISTINCT s_suppkey % 40 AS t FROM supplier WHERE s_suppkey % 40 < 30)
    SELECT game_id, CASE WHEN offense_id IN (SELECT t FROM m) THEN CAST(offense_id AS VARCHAR) ELSE 'FCS_TIER' END AS offense_id, CASE WHEN defense_id IN (SELECT t FROM m) THEN CAST(defense_id AS VARCHAR) ELSE 'FCS_TIER' END AS defense_id,
        epa_per_play, rush_success_rate, pass_havoc_rate, n_plays, finishing_drives, field_position, offense_id = home_id AND NOT neutral AS is_home FROM e LEFT JOIN g USING (game_id) LEFT JOIN dm USING (game_id, offense_id)""")
def play_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 40).alias("home_id"), (F.col("o_orderkey") % 4 == 0).alias("neutral"))
    members = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("team_id")).where("team_id < 30")
    found = features.observations(_plays(spark, sf_dir), games, _drives(spark, sf_dir), members)
    return _rounded(found.select("game_id", "offense_id", "defense_id", "epa_per_play", "rush_success_rate", "pass_havoc_rate", "n_plays", "finishing_drives", "field_position", "is_home"), ["game_id", "offense_id", "defense_id"])


_TEMPO = f"""{_PLAYS},
    l AS (SELECT *, lag(period) OVER w AS pp, lag(clock) OVER w AS pc FROM plays WHERE NOT garbage_time WINDOW w AS (PARTITION BY game_id, drive_id ORDER BY period, play_id)),
    x AS (SELECT *, CASE WHEN period = pp THEN pc - clock WHEN period = pp + 1 THEN pc + 900 - clock END AS raw FROM l),
    a AS (SELECT *, CASE WHEN raw > 0 AND raw <= 960 THEN raw END AS elapsed_s FROM x),
    live AS (SELECT *, elapsed_s >= 12 AND NOT regexp_matches(lower(play_type), 'kneel|spike') AND NOT (period IN (2, 4) AND clock <= 120) AS neutral,
        (distance > 3)::INT + (distance > 6)::INT + (distance > 10)::INT AS s1, (score_margin > -15)::INT + (score_margin > -8)::INT + (score_margin > -1)::INT + (score_margin > 0)::INT + (score_margin > 7)::INT + (score_margin > 14)::INT AS s2, (clock >= 120)::INT + (clock >= 300)::INT + (clock >= 600)::INT AS s3 FROM a WHERE is_rush OR is_pass),
    tab AS (SELECT down, s1, s2, s3, period, avg(CAST(is_pass AS INTEGER)) AS expected FROM live WHERE down >= 1 GROUP BY ALL),
    tempo AS (SELECT game_id, offense_id, defense_id, count(*) AS plays_per_game, avg(elapsed_s) FILTER (neutral) AS sec_per_play, avg(CAST(is_pass AS INTEGER)) AS pass_rate, avg(CAST(is_pass AS INTEGER) - coalesce(expected, 0.45)) AS pass_rate_oe FROM live LEFT JOIN tab USING (down, s1, s2, s3, period) GROUP BY ALL)"""


@query(f"WITH {_TEMPO} SELECT game_id, offense_id, defense_id, plays_per_game, round(sec_per_play, 6) AS sec_per_play, round(pass_rate, 6) AS pass_rate, round(pass_rate_oe, 6) + 0.0 AS pass_rate_oe, round(-pass_rate_oe, 6) + 0.0 AS rush_rate_oe FROM tempo")
def tempo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.tempo(_plays(spark, sf_dir))
    return found.select("game_id", "offense_id", "defense_id", "plays_per_game", r6("sec_per_play").alias("sec_per_play"), r6("pass_rate").alias("pass_rate"), *[(r6(c) + 0.0).alias(c) for c in ("pass_rate_oe", "rush_rate_oe")])


@query(f"WITH {_DRIVES} SELECT game_id, count(*) AS possessions FROM drives GROUP BY 1")
def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.possessions(_drives(spark, sf_dir))


@query(f"""
    WITH {_TEMPO} SELECT game_id, offense_id, round(avg(plays_per_game) OVER w, 6) AS pace, round(avg(pass_rate) OVER w, 6) AS pass_rate, count(*) OVER w AS n_prior FROM tempo
    WINDOW w AS (PARTITION BY offense_id ORDER BY game_id, defense_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def pace_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.season_to_date(features.tempo(_plays(spark, sf_dir)), "offense_id", ["game_id", "defense_id"], {"pace": "plays_per_game", "rate": "pass_rate"})
    return found.select("game_id", "offense_id", r6("pace").alias("pace"), r6("rate").alias("pass_rate"), "n_prior")


_FORMS = {"epa_per_play": 6.5, "success_rate": 6.5, "explosiveness": 10.0, "havoc_rate": 6.5}


def _form(m: str, half: float) -> str:
    a = 1 - 0.5 ** (1 / half)
    return f"""SELECT offense_id, '{m}' AS measure, round(count(*) / (count(*) + 8.0) * avg(x), 6) AS std, round(sum(x * pow({1 - a}, n - i) * CASE WHEN i = 1 THEN 1 ELSE {a} END), 6) AS ewma, round(avg(x) FILTER (n - i < 3) - avg(x), 6) + 0.0 AS l3d
        FROM (SELECT offense_id, {m} AS x, row_number() OVER (PARTITION BY offense_id ORDER BY game_id, defense_id) AS i, count(*) OVER (PARTITION BY offense_id) AS n FROM e WHERE {m} IS NOT NULL) GROUP BY offense_id"""


@query(f"WITH {_PLAYS}, {_EFFICIENCY.replace('round(', '(').replace(', 6)', ')')} " + " UNION ALL ".join(_form(m, h) for m, h in _FORMS.items()))
def entity_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shrunk to zero, exponentially weighted mean and last-three difference of each measure, by team."""
    found = features.entity_values(features.game_efficiency(_plays(spark, sf_dir)), "offense_id", ["game_id", "defense_id"], _FORMS)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), r6(f"{m}_std").alias("std"), r6(f"{m}_ewma").alias("ewma"), (r6(f"{m}_l3d") + 0.0).alias("l3d")) for m in _FORMS])
    return found.select("offense_id", F.inline(each)).where("std is not null")


@query("""
    WITH r AS (SELECT o_custkey, count(*) AS y, avg(o_totalprice) / 1000 AS a, avg(o_orderkey % 11) AS b FROM orders GROUP BY 1), m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM r),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
    SELECT n, round(my - b1 * ma - b2 * mb, 5) AS a, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM c""")
def expected_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"), (F.avg("o_totalprice") / 1000).alias("x1"), F.avg(F.col("o_orderkey") % 11).alias("x2"))
    found = features.expected_possessions(rows, "y", "x1", "x2")
    return found.select("n", *[F.round(c, 5).alias(c) for c in ("a", "b1", "b2")])


@query("""
    WITH g AS (SELECT o_orderkey AS game_id, o_custkey AS home_id, 100000 + o_custkey % 7 AS away_id, o_orderdate AS ts, o_orderkey % 9 = 0 AS rivalry FROM orders),
    s AS (SELECT game_id, ts, rivalry, 'h' AS side, home_id AS team FROM g UNION ALL SELECT game_id, ts, rivalry, 'a', away_id FROM g),
    w AS (SELECT *, date_diff('microsecond', lag(ts) OVER k, ts) / 86400000000 AS rest, coalesce(lag(rivalry) OVER k, false) AS post, coalesce(lead(rivalry) OVER k, false) AS ahead FROM s WINDOW k AS (PARTITION BY team ORDER BY ts, game_id)),
    f AS (SELECT game_id, max(rest) FILTER (side = 'h') AS h, max(rest) FILTER (side = 'a') AS a, bool_or(post) AS post, bool_or(ahead) AS ahead, bool_or(rivalry) AS rivalry FROM w GROUP BY 1)
    SELECT game_id, round(h, 6) AS rest_days_home, round(a, 6) AS rest_days_away, post AS post_rivalry_flag, ahead AS rivalry_lookahead_flag, rivalry AS rivalry_flag, round(h - a, 6) AS rest_days_diff, coalesce(least(h, a) < 6, false) AS short_week_flag, coalesce(greatest(h, a) >= 13, false) AS bye_flag FROM f""")
def situational_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    games = o.select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("home_id"), (F.lit(100_000) + F.col("o_custkey") % 7).alias("away_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 9 == 0).alias("rivalry"))
    return _rounded(features.situational(games), ["game_id"])


_CLASS = "r AS (SELECT o_custkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season, sum(o_totalprice) / 1000 AS points FROM orders GROUP BY ALL)"


@query(f"""
    WITH {_CLASS} SELECT a.team, a.season, round(sum(b.points * (0.4 - 0.1 * (a.season - b.season))) / sum(0.4 - 0.1 * (a.season - b.season)), 6) AS composite
    FROM r a JOIN r b ON a.team = b.team AND b.season BETWEEN a.season - 3 AND a.season GROUP BY ALL""")
def recruiting_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("season")).agg((F.sum("o_totalprice") / 1000).alias("points"))
    return features.recruiting(rows).select("team", "season", r6("composite").alias("composite"))


@query("""
    WITH p AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey AS origin, CASE WHEN l_linenumber > 1 THEN l_partkey % 100 END AS destination, l_quantity AS rating, l_shipdate AS ts FROM lineitem),
    v AS (SELECT * FROM p WHERE season >= 1996 AND ts < make_date(season, 8, 1)), u AS (SELECT season, destination AS team, rating AS x FROM v UNION ALL SELECT season, origin, -rating FROM v)
    SELECT team, season, round(sum(x), 6) AS net FROM u WHERE team IS NOT NULL GROUP BY ALL""")
def portal_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("origin"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 100).alias("destination"), F.col("l_quantity").alias("rating"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
    return features.portal_net(moves, 1996).select("team", "season", r6("net").alias("net"))


@query("""
    WITH s AS (SELECT o_custkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season, min(o_orderpriority) AS coach FROM orders GROUP BY ALL),
    i AS (SELECT *, season - row_number() OVER (PARTITION BY team, coach ORDER BY season) AS island, lag(coach) OVER (PARTITION BY team ORDER BY season) AS before FROM s)
    SELECT team, season, coach, CAST(row_number() OVER (PARTITION BY team, coach, island ORDER BY season) AS INTEGER) AS tenure, before <> coach AS change_flag, CAST(make_date(season, 8, 1) AS TIMESTAMP) AS known_at FROM i""")
def roster_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("season")).agg(F.min("o_orderpriority").alias("coach"))
    return features.roster(rows, "coach")
