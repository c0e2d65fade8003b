"""Efficiency, quality, betting and inference on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import asof, betting, distribution, efficiency, inference, quality, ratings, windows
from .registry import SQL, query, r6, spread, table


@query("""
    WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'discount' WHEN l_quantity > CASE least(l_linenumber, 4) WHEN 1 THEN 48 WHEN 2 THEN 44 WHEN 3 THEN 40 ELSE 36 END THEN 'quantity' ELSE 'none' END AS rule FROM lineitem)
    SELECT rule, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY rule""")
def cond_flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in {1: 48, 2: 44, 3: 40, 4: 36}.items() for x in kv]), F.least("l_linenumber", F.lit(4)))
    rule = F.when(F.col("l_discount") > 0.08, "discount").when(F.col("l_quantity") > limit, "quantity").otherwise("none")
    n = table(spark, sf_dir, "lineitem").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))
    return n.select("rule", "n", r6(F.col("n") / F.sum("n").over(windows.Window.partitionBy())).alias("share"))


@query("""
    SELECT l_suppkey, count(*) AS all_n, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS all_mean, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS all_success, round(avg(l_tax) FILTER (l_tax > 0.04), 6) AS all_explosive,
        count(*) FILTER (l_returnflag = 'R') AS r_n, round(sum(l_quantity * l_tax) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r_mean,
        round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END) FILTER (l_returnflag = 'R'), 6) AS r_success, round(avg(l_tax) FILTER (l_returnflag = 'R' AND l_tax > 0.04), 6) AS r_explosive
    FROM lineitem GROUP BY l_suppkey""")
def cond_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, hit, w = F.col("l_tax"), F.col("l_tax") > 0.04, F.col("l_quantity")
    blocks = efficiency.metric_block("all", F.lit(True), v, hit, w) + efficiency.metric_block("r", F.col("l_returnflag") == "R", v, hit, w)
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*blocks)
    return found.select("l_suppkey", *[F.col(c) if c.endswith("_n") else r6(c).alias(c) for c in found.columns[1:]])


@query("""
    WITH s AS (SELECT *, hour(ts) AS h, floor(least(value, 60) / 10) AS b, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS y FROM events), p AS (SELECT h, b, avg(y) AS p FROM s GROUP BY ALL)
    SELECT user_id, count(*) AS n, round(avg(y), 6) AS observed, round(avg(p), 6) AS expected, round(avg(y) - avg(p), 6) AS over FROM s JOIN p USING (h, b) GROUP BY 1""")
def situation_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = efficiency.over_expectation(e, [F.hour("ts"), F.floor(F.least("value", F.lit(60)) / 10)], F.col("event_type") == "click", ["user_id"], 0.45)
    return found.select("user_id", "n", *[r6(c).alias(c) for c in ("observed", "expected", "over")])


@query("""
    WITH g AS (SELECT avg(p_retailprice) AS prior FROM part) SELECT p_brand, count(*) AS n, round(count(*) / (count(*) + 8.0) * avg(p_retailprice) + 8.0 / (count(*) + 8.0) * max(prior), 4) AS shrunk FROM part, g GROUP BY p_brand""")
def shrunk_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    prior = p.agg(F.avg("p_retailprice")).first()[0]
    value = numbers.shrunk(F.avg("p_retailprice"), F.count("*"), F.lit(prior), 8)
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(value, 4).alias("shrunk"))


@query()
def ridge_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier against brand effects on price, ridge on both, in leagues of 50 suppliers."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.floor(F.col("l_suppkey") / 50).alias("league"), "l_suppkey", "p_brand", (F.col("l_linenumber") == 1).alias("home"), (F.col("l_extendedprice") / 1000).alias("y"))
    return efficiency.ridge_adjust(rows, ["league"], "l_suppkey", "p_brand", "home", "y").select("league", "entity", *[r6(c).alias(c) for c in ("off", "def", "hfa")])


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a game: the customer's nation hosts another one, in the league of 50 neighbouring customers.

    Leagues grow in number with the table, not in size. In each, games follow their dates through the seasons.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    league = F.floor(F.col("o_custkey") / 50).cast("string")
    away = (F.col("c_nationkey") + 1 + F.col("o_orderkey") / 10 % 24).cast("int") % 25
    return rows.select(league.alias("league"), F.col("o_orderkey").alias("game"), F.col("o_orderdate").alias("ts"), F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("home"), F.concat(F.lit("n"), away).alias("away"), (F.col("o_totalprice") % 41 - 20).cast("int").alias("margin"), F.lit(False).alias("neutral"), (F.col("o_totalprice") % 41).alias("home_value"), (F.col("o_totalprice") % 37).alias("away_value"))


# one step of the recursion is one game of every league; a rating is null until its team plays
@query("""
    WITH RECURSIVE o AS (
        SELECT CAST(o_custkey // 50 AS VARCHAR) AS league, o_orderkey AS game, o_orderdate AS ts, year(o_orderdate) AS season, c_nationkey AS home,
            CAST(floor(c_nationkey + 1 + (o_orderkey / 10.0) % 24) AS INTEGER) % 25 AS away, CAST(trunc(o_totalprice % 41 - 20) AS INTEGER) AS margin
        FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts, game) AS i, coalesce(lag(season) OVER (PARTITION BY league ORDER BY ts, game), season) AS before FROM o),
    s AS (
        SELECT league, CAST(0 AS BIGINT) AS i, [CAST(NULL AS DOUBLE) for x in range(25)] AS r, CAST(NULL AS BIGINT) AS game, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS shift
        FROM (SELECT DISTINCT league FROM g)
        UNION ALL
        SELECT league, i, list_transform(r, lambda x, j: CASE WHEN j = home + 1 THEN a + shift WHEN j = away + 1 THEN b - shift ELSE x END), game, a, b, p, shift
        FROM (SELECT *, CASE WHEN margin = 0 THEN 30 * (0.5 - p) ELSE 30 * ln(abs(margin) + 1) * 2.8 / ((CASE WHEN margin > 0 THEN gap ELSE -gap END) * 0.001 + 2.8) * ((CASE WHEN margin > 0 THEN 1 ELSE 0 END) - p) END AS shift
            FROM (SELECT *, a - b + 55 AS gap, 1 / (1 + pow(10.0, -(a - b + 55) / 400)) AS p
                FROM (SELECT *, coalesce(r[home + 1], 1500.0) AS a, coalesce(r[away + 1], 1500.0) AS b
                    FROM (SELECT g.*, CASE WHEN g.season <> g.before THEN list_transform(s.r, lambda x: x + (list_avg(s.r) - x) / 3) ELSE s.r END AS r FROM s JOIN g ON g.league = s.league AND g.i = s.i + 1)))))
    SELECT game, round(a, 6) AS home_before, round(b, 6) AS away_before, round(p, 6) AS p_home, round(a + shift, 6) AS home_after, round(b - shift, 6) AS away_after FROM s WHERE i > 0""")
def elo_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratings.elo(_games(spark, sf_dir))
    return found.select("game", *[r6(c).alias(c) for c in ("home_before", "away_before", "p_home", "home_after", "away_after")])


# as elo_fold's recursion, for every point of the grid
_TUNED = (
    SQL["elo_fold"]
    .replace("s AS (\n        SELECT league,", "grid AS (SELECT CAST(k AS DOUBLE) AS k, CAST(f AS DOUBLE) AS f FROM (VALUES (20), (30), (40)) AS x(k), (VALUES (2.2), (2.8)) AS y(f)),\n    s AS (\n        SELECT league, k, f,")
    .replace("FROM (SELECT DISTINCT league FROM g)", "FROM (SELECT DISTINCT league FROM g), grid")
    .replace("CAST(NULL AS DOUBLE) AS shift", "CAST(NULL AS DOUBLE) AS shift, CAST(NULL AS INTEGER) AS margin")
    .replace("SELECT league, i, list_transform(r, lambda x, j:", "SELECT league, k, f, i, list_transform(r, lambda x, j:")
    .replace("game, a, b, p, shift\n        FROM (SELECT *, CASE", "game, a, b, p, shift, margin\n        FROM (SELECT *, CASE")
    .replace("30 * (0.5 - p)", "k * (0.5 - p)").replace("30 * ln(", "k * ln(").replace("* 2.8 /", "* f /").replace("* 0.001 + 2.8)", "* 0.001 + f)")
    .replace("FROM (SELECT g.*, CASE", "FROM (SELECT g.*, s.k, s.f, CASE")
)
_TUNED = _TUNED[: _TUNED.rindex("SELECT game, round(a, 6)")] + "SELECT k, f AS factor, count(*) AS n, round(avg(-ln(greatest(1e-15, CASE WHEN margin > 0 THEN p ELSE 1 - p END))), 6) AS log_loss FROM s WHERE i > 0 AND margin <> 0 GROUP BY ALL"


@query(_TUNED)
def elo_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratings.elo_grid(_games(spark, sf_dir), [20, 30, 40], [2.2, 2.8])
    return found.select("k", "factor", "n", r6("log_loss").alias("log_loss"))


@query()
def joint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratings.joint_filter(_games(spark, sf_dir))
    return found.select("game", *[r6(c).alias(c) for c in found.columns if c not in ("league", "game")])


_RULES = """
    SELECT 'l_quantity between 1 and 45' AS rule, 'flag' AS severity, count(*) AS n, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) AS failures, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) = 0 AS passed FROM lineitem
    UNION ALL SELECT 'l_returnflag in set', 'fail', count(*), count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')), count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) = 0 FROM lineitem
    UNION ALL SELECT 'l_tax not null', 'fail', count(*), count(*) - count(l_tax), count(l_tax) = count(*) FROM lineitem
    UNION ALL SELECT 'unique l_orderkey, l_linenumber', 'fail', count(*), count(*) FILTER (k > 1), count(*) FILTER (k > 1) = 0 FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem)"""


@query(_RULES)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, single = quality.unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return quality.report(rows, [quality.between("l_quantity", 1, 45, "flag"), quality.in_set("l_returnflag", ["A", "N", "R"]), quality.not_null("l_tax"), single])


@query("""
    SELECT 'l_extendedprice > l_quantity' AS rule, 'fail' AS severity, count(*) AS n, count(*) FILTER (NOT l_extendedprice > l_quantity) AS failures, count(*) FILTER (NOT l_extendedprice > l_quantity) = 0 AS passed FROM lineitem
    UNION ALL SELECT 'l_quantity > l_linenumber', 'flag', count(*), count(*) FILTER (NOT l_quantity > l_linenumber), count(*) FILTER (NOT l_quantity > l_linenumber) = 0 FROM lineitem""")
def pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns on a table with exactly its columns."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return quality.report(quality.exact_columns(l, l.columns), [quality.greater("l_extendedprice", "l_quantity"), quality.greater("l_quantity", "l_linenumber", "flag")])


@query("""
    WITH r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) FILTER (l_quantity > 49) AS a, count(*) FILTER (l_extendedprice > 99900) AS b FROM lineitem GROUP BY 1)
    SELECT month, CASE WHEN b > 0 THEN 'QUARANTINED' WHEN a > 0 THEN 'FLAGGED' ELSE 'PASSED' END AS status, CAST(a + b AS BIGINT) AS failures FROM r""")
def partition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))
    found = quality.report(rows, [quality.between("l_quantity", 0, 49, "flag"), quality.between("l_extendedprice", 0, 99900)], ["month"])
    return quality.partition_status(found, ["month"])


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-02-01' GROUP BY 1)
    SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'appeared' WHEN b.n IS NULL THEN 'vanished' ELSE 'changed' END AS reason FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n""")
def asof_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features move when the bound does."""
    at = lambda d: table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return quality.frames_differ(at("1998-01-01"), at("1998-02-01"), ["o_custkey"], ["n"])


@query("SELECT 'clean' AS builder, 0 AS differing UNION ALL SELECT 'leaky', count(*) FILTER (a <> b) FROM (SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS a, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1)")
def pit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A builder that filters strictly, and one that admits rows at the bound, recomputed on cut history."""
    o, bound = table(spark, sf_dir, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    strict = lambda rows: rows.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") < bound).alias("n"))
    loose = lambda rows: rows.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") <= bound).alias("n"))
    cut = o.withColumn("o_orderdate", F.when(F.col("o_orderdate") < bound, F.col("o_orderdate")))
    out = None
    for name, build in (("clean", strict), ("leaky", loose)):
        n = quality.frames_differ(build(o), build(cut), ["o_custkey"], ["n"]).agg(F.count("*").alias("differing")).select(F.lit(name).alias("builder"), "differing")
        out = n if out is None else out.unionByName(n)
    return out


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -(110 + p_size) ELSE 100 + p_size END AS a, CASE WHEN p_partkey % 2 = 0 THEN 90 + p_size ELSE -(120 + p_size) END AS b FROM part),
    q AS (SELECT *, 1 / CASE WHEN a > 0 THEN 1 + a / 100 ELSE 1 + 100 / -a END AS qa, 1 / CASE WHEN b > 0 THEN 1 + b / 100 ELSE 1 + 100 / -b END AS qb FROM p)
    SELECT p_partkey, round(qa, 6) AS implied, round(qa / (qa + qb), 6) AS fair FROM q""")
def devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir).select("p_partkey", r6("qa").alias("implied"), r6(numbers.fair_proportional(F.col("qa"), F.col("qb"))).alias("fair"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(even, -(110 + F.col("p_size"))).otherwise(100 + F.col("p_size")).alias("a"), F.when(even, 90 + F.col("p_size")).otherwise(-(120 + F.col("p_size"))).alias("b"))
    return rows.withColumns({"qa": numbers.implied(F.col("a")), "qb": numbers.implied(F.col("b"))})


@query("""
    WITH RECURSIVE p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -(110 + p_size) ELSE 100 + p_size END AS a, CASE WHEN p_partkey % 2 = 0 THEN 90 + p_size ELSE -(120 + p_size) END AS b FROM part),
    q AS (SELECT p_partkey, 1 / CASE WHEN a > 0 THEN 1 + a / 100 ELSE 1 + 100 / -a END AS x, 1 / CASE WHEN b > 0 THEN 1 + b / 100 ELSE 1 + 100 / -b END AS y FROM p),
    f AS (
        SELECT p_partkey, x, y, CAST(0.01 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS zl, CAST(0.9 AS DOUBLE) AS zh, 0 AS i FROM q
        UNION ALL
        SELECT p_partkey, x, y, CASE WHEN up THEN c ELSE lo END, CASE WHEN up THEN hi ELSE c END, CASE WHEN zup THEN z ELSE zl END, CASE WHEN zup THEN zh ELSE z END, i + 1
        FROM (SELECT *, pow(x, c) + pow(y, c) > 1 AS up, (sqrt(z * z + 4 * (1 - z) * x * x / (x + y)) - z) / (2 * (1 - z)) + (sqrt(z * z + 4 * (1 - z) * y * y / (x + y)) - z) / (2 * (1 - z)) > 1 AS zup
            FROM (SELECT *, (lo + hi) / 2 AS c, (zl + zh) / 2 AS z FROM f WHERE i < 50)))
    SELECT p_partkey, round(pow(x, (lo + hi) / 2), 6) AS power, round((sqrt((zl + zh) / 2 * ((zl + zh) / 2) + 4 * (1 - (zl + zh) / 2) * x * x / (x + y)) - (zl + zh) / 2) / (2 * (1 - (zl + zh) / 2)), 6) AS shin FROM f WHERE i = 50""")
def devig_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power and Shin probabilities, found by bisection inside the expression."""
    q, o = F.col("qa"), F.col("qb")
    return spread(_prices(spark, sf_dir).select("p_partkey", "qa", "qb"), "p_partkey").select("p_partkey", r6(numbers.fair_power(q, o)).alias("power"), r6(numbers.fair_shin(q, o)).alias("shin"))


@query("""
    WITH p AS (SELECT p_partkey, p_brand, 1 + (50 + p_size) / 50.0 AS d, 0.4 + (p_partkey % 7) / 50.0 AS p FROM part), e AS (SELECT *, p * d - 1 AS edge, least(greatest(0, ((d - 1) * p - (1 - p)) / (d - 1)) * 0.25, 0.015) AS stake FROM p),
    s AS (SELECT *, coalesce(sum(stake) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
    SELECT p_partkey, round(edge, 6) AS edge, round(stake, 6) AS stake, round(greatest(0, least(stake, 0.1 - used)), 6) AS placed FROM s""")
def kelly_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (1 + (50 + F.col("p_size")) / 50.0).alias("d"), (0.4 + (F.col("p_partkey") % 7) / 50.0).alias("p"))
    return betting.stakes(rows, ["p_brand"], ["p_partkey"], "p", "d").select("p_partkey", *[r6(c).alias(c) for c in ("edge", "stake", "placed")])


@query("""
    WITH RECURSIVE p AS (SELECT p_partkey, p_brand, p_size // 10 AS team, 1 + (50 + p_size) / 50.0 AS d, 0.4 + (p_partkey % 7) / 50.0 AS p FROM part),
    e AS (SELECT *, CAST(least(greatest(0, ((d - 1) * p - (1 - p)) / (d - 1)) * 0.25, 0.015) AS DOUBLE) AS stake, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM p),
    s AS (
        SELECT p_brand, CAST(0 AS BIGINT) AS i, [CAST(0 AS DOUBLE) for x in range(6)] AS teams, CAST(0 AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS p_partkey, CAST(0 AS DOUBLE) AS placed FROM (SELECT DISTINCT p_brand FROM e)
        UNION ALL
        SELECT p_brand, i, list_transform(teams, lambda x, j: CASE WHEN j = team + 1 THEN x + now ELSE x END), total + now, p_partkey, now
        FROM (SELECT e.p_brand, e.i, e.team, s.teams, s.total, e.p_partkey, greatest(0, least(e.stake, 0.1 - s.total, 0.05 - s.teams[e.team + 1])) AS now FROM s JOIN e ON e.p_brand = s.p_brand AND e.i = s.i + 1))
    SELECT p_partkey, round(placed, 6) AS placed FROM s WHERE i > 0""")
def team_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes under a cap by week (brand) and one by team (size class)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.floor(F.col("p_size") / 10).alias("team"), (1 + (50 + F.col("p_size")) / 50.0).alias("d"), (0.4 + (F.col("p_partkey") % 7) / 50.0).alias("p"))
    return betting.stakes(rows, ["p_brand"], ["p_partkey"], "p", "d", team="team").select("p_partkey", r6("placed").alias("placed"))


@query("""
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_retailprice > 1500 THEN 'price' END, CASE WHEN p_type = 'ECONOMY' THEN 'type' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = betting.reasons(("size", F.col("p_size") > 40), ("price", F.col("p_retailprice") > 1500), ("type", F.col("p_type") == "ECONOMY"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("reasons"))


@query("""
    WITH b AS (SELECT l_partkey, count(*) AS n, arg_min(l_tax, (l_shipdate, l_orderkey, l_linenumber)) AS o, arg_max(l_tax, (l_shipdate, l_orderkey, l_linenumber)) AS c FROM lineitem GROUP BY 1)
    SELECT p_brand, count(*) AS n, round(avg(c - o), 6) + 0.0 AS mean, round(avg(CASE WHEN c - o > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(c - o) - 1.96 * stddev_samp(c - o) / sqrt(count(*)), 6) AS low, round(avg(c - o) + 1.96 * stddev_samp(c - o) / sqrt(count(*)), 6) AS high
    FROM b JOIN part ON l_partkey = p_partkey WHERE n > 1 GROUP BY p_brand""")
def clv_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_tax", order).alias("o"), F.max_by("l_tax", order).alias("c"), F.min(order).alias("orow"), F.max(order).alias("crow"))
    rows = betting.closing_value(ends, "o", "c", "orow", "crow").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return betting.strata(rows, ["p_brand"], "clv").select("p_brand", "n", *[(r6(c) + 0.0).alias(c) for c in ("mean", "positive", "low", "high")])


@query("""
    WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS k, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c)
    SELECT l_suppkey, round(sum(p) FILTER (k > 25) / (1 - coalesce(sum(p) FILTER (k = 25), 0)), 6) AS cover, round(coalesce(sum(p) FILTER (k = 25), 0), 6) AS push FROM p GROUP BY 1""")
def pmf_market_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("k")).agg(F.count("*").alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(windows.Window.partitionBy("l_suppkey")))
    dist = share.groupBy("l_suppkey").agg(F.collect_list(F.struct("k", "p")).alias("dist"))
    cover, push = distribution.cover(F.col("dist"), F.lit(-25))
    return dist.select("l_suppkey", r6(cover).alias("cover"), r6(push).alias("push"))


_CDF = "(CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END)"


def _sql_cdf(z: str) -> str:
    t = f"(1 / (1 + abs({z}) * 0.2316419))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return _CDF.format(z=z, t=f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})")


@query(f"""
    WITH x AS (SELECT c_nationkey, (c_acctbal - 4500) / 3000 AS z FROM customer)
    SELECT c_nationkey, count(*) AS n, round(avg(3000 * (z * (2 * {_sql_cdf("z")} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 4) AS crps FROM x GROUP BY 1""")
def crps_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = numbers.crps_normal(F.lit(4500.0), F.lit(3000.0), F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("crps"))


_P = "least(0.9, greatest(0.05, n_chars / 8000.0))"


@query(f"""
    WITH x AS (SELECT {_P} AS p, toxic AS y FROM documents JOIN labels USING (doc_id))
    SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM x GROUP BY 1""")
def brier_logloss_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.lit(0.9), F.greatest(F.lit(0.05), F.col("n_chars") / 8000.0))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(p.alias("p"), F.col("toxic").cast("double").alias("y"))
    bins = inference.reliability(rows, F.col("p"), F.col("y"))
    b = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    scores = rows.groupBy(b.alias("bin")).agg(F.avg(numbers.brier(F.col("p"), F.col("y"))).alias("brier"), F.avg(numbers.log_loss(F.col("p"), F.col("y"))).alias("log_loss"))
    return bins.join(scores, "bin").select("bin", "n", *[r6(c).alias(c) for c in ("mean_p", "rate", "brier", "log_loss")])


@query("""
    WITH x AS (SELECT p_brand, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type) AS e FROM part) SELECT p_brand, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM x GROUP BY 1""")
def mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("p_retailprice") - F.avg("p_retailprice").over(windows.Window.partitionBy("p_type"))
    return table(spark, sf_dir, "part").withColumn("e", e).groupBy("p_brand").agg(r6(F.avg(F.abs("e"))).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"))


@query("""
    WITH b AS (SELECT date_trunc('month', o_orderdate) AS m, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS s, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY m) - 1 AS b, s, n FROM b),
    c AS (SELECT count(*) AS blocks, sum(s) / sum(n) AS estimate FROM b), d AS (SELECT r.range AS rep, t.range AS slot, blocks, estimate FROM range(200) r, c, LATERAL (SELECT unnest(range(blocks)) AS range) t),
    x AS (SELECT rep, estimate, CAST('0x' || substring(md5('b:' || rep || ':' || slot), 1, 8) AS BIGINT) % blocks AS b FROM d), m AS (SELECT rep, estimate, sum(s) / sum(n) AS m FROM x JOIN k USING (b) GROUP BY ALL)
    SELECT round(estimate, 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round((count(*) FILTER (m <= 0) + 1) / (count(*) + 1), 6) AS p_not_positive FROM m GROUP BY estimate""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    found = inference.block_bootstrap(o, ["month"], F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1), 200)
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query("""
    WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, covar_pop(l_quantity, l_quantity) AS c11, covar_pop(l_tax, l_tax) AS c22, covar_pop(l_quantity, l_tax) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1y, covar_pop(l_tax, l_extendedprice) AS c2y FROM lineitem GROUP BY 1),
    b AS (SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM m)
    SELECT l_returnflag, n, round(my - b1 * m1 - b2 * m2, 3) AS a, round(b1, 3) AS b1, round(b2, 3) AS b2 FROM b""")
def ols_encompassing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inference.two_predictor_ols(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_tax")
    return found.select("l_returnflag", "n", *[F.round(c, 3).alias(c) for c in ("a", "b1", "b2")])


@query("""
    WITH e AS (SELECT l_extendedprice AS v FROM lineitem WHERE year(l_shipdate) = 1998), a AS (SELECT l_extendedprice AS v FROM lineitem WHERE year(l_shipdate) = 2000),
    q AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM e),
    x AS (SELECT len(list_filter(cuts, lambda c: c < v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM e, q GROUP BY 1), y AS (SELECT len(list_filter(cuts, lambda c: c < v)) AS bin, count(*) / sum(count(*)) OVER () AS p FROM a, q GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, round(greatest(coalesce(x.p, 0.0001), 0.0001), 6) AS expected, round(greatest(coalesce(y.p, 0.0001), 0.0001), 6) AS actual, round((y.p - x.p) * ln(y.p / x.p), 6) AS psi FROM x FULL JOIN y USING (bin)""")
def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    found = inference.stability_index(l.where(F.year("l_shipdate") == 1998), l.where(F.year("l_shipdate") == 2000), "l_extendedprice")
    return found.select("bin", *[r6(c).alias(c) for c in ("expected", "actual", "psi")])


@query("""
    WITH q AS (SELECT p_type, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY 1), s AS (SELECT p_brand, p_partkey, greatest(lo - p_retailprice, p_retailprice - hi) AS score FROM part JOIN q USING (p_type)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM s)
    SELECT p_brand, max(n) AS n, round(max(score) FILTER (i = least(n, ceil((n + 1) * (1 - 0.1)))), 6) AS threshold FROM r GROUP BY 1""")
def cqr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    band = p.groupBy("p_type").agg(F.percentile("p_retailprice", F.lit(0.25)).alias("lo"), F.percentile("p_retailprice", F.lit(0.75)).alias("hi"))
    rows = p.join(band, "p_type").withColumn("score", inference.interval_score(F.col("lo"), F.col("hi"), F.col("p_retailprice")))
    return inference.conformal_threshold(rows, ["p_brand"], "score", 0.1, "p_partkey").select("p_brand", "n", r6("threshold").alias("threshold"))


_RAW = "CASE WHEN p >= 0.85 THEN 'strong_lean' WHEN p >= 0.7 THEN 'clear_lean' WHEN p >= 0.575 THEN 'lean' ELSE 'toss_up' END"


@query(f"""
    WITH RECURSIVE x AS (SELECT event_id, user_id, round(0.5 + value % 10 / 20, 9) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
    s AS (
        SELECT event_id, user_id, i, {_RAW} AS tier FROM x WHERE i = 1
        UNION ALL
        SELECT x.event_id, x.user_id, x.i, CASE
            WHEN s.tier = 'strong_lean' AND p >= 0.82::DOUBLE THEN 'strong_lean'
            WHEN s.tier = 'clear_lean' AND p >= 0.67::DOUBLE THEN CASE WHEN p >= 0.85 THEN 'strong_lean' ELSE 'clear_lean' END
            WHEN s.tier = 'lean' AND p >= 0.545::DOUBLE THEN CASE WHEN p >= 0.85 THEN 'strong_lean' WHEN p >= 0.7 THEN 'clear_lean' ELSE 'lean' END
            WHEN s.tier = 'toss_up' AND p < 0.605::DOUBLE THEN 'toss_up' ELSE {_RAW} END
        FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
    SELECT event_id, tier FROM s""")
def tier_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(0.5 + F.col("value") % 10 / 20, 9).alias("p_favored"))
    return betting.tier_history(rows, ["user_id"], ["ts", "event_id"], "p_favored").select("event_id", "tier")


@query("""
    WITH g AS (SELECT o_custkey AS user_id, TIMESTAMP '2024-01-15' AS kickoff FROM orders GROUP BY 1),
    b AS (SELECT e.user_id, arg_max(event_id, (event_type = 'purchase', ts)) AS event_id FROM events e JOIN g ON e.user_id = g.user_id AND e.ts < g.kickoff GROUP BY 1)
    SELECT g.user_id, b.event_id, CASE WHEN b.event_id IS NULL THEN 'no_pre_kickoff_publish' ELSE 'graded' END AS status FROM g LEFT JOIN b USING (user_id)""")
def grade_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct().withColumn("kickoff", F.lit("2024-01-15").cast("timestamp_ntz"))
    publishes = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").cast("int").alias("precedence"))
    return betting.graded(publishes, games, "user_id", "ts", "kickoff", "precedence").select("user_id", F.col("publish.event_id").alias("event_id"), "status")


@query(f"""
    WITH g AS (SELECT c_custkey, c_acctbal / 1000 - 4 AS mu FROM customer), k AS (SELECT c_custkey, mu, unnest(range(-80, 81)) AS k FROM g),
    m AS (SELECT *, {_sql_cdf("((k + 0.5 - mu) / 14.0)")} - {_sql_cdf("((k - 0.5 - mu) / 14.0)")} AS p FROM k), s AS (SELECT *, p / sum(p) OVER (PARTITION BY c_custkey) AS q FROM m)
    SELECT c_custkey, round(sum(q) FILTER (k > 0) / (1 - sum(q) FILTER (k = 0)), 6) AS win, round(sum(q) FILTER (k > 3) / (1 - sum(q) FILTER (k = 3)), 6) AS cover, round(sum(q) FILTER (k = 3), 6) AS push FROM s GROUP BY 1""")
def margin_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact win, cover and push probabilities of a discretised normal margin."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000 - 4).alias("mu"))
    win, _ = distribution.normal_cover(F.col("mu"), F.lit(14.0), F.lit(0))
    cover, push = distribution.normal_cover(F.col("mu"), F.lit(14.0), F.lit(-3))
    return rows.select("c_custkey", r6(win).alias("win"), r6(cover).alias("cover"), r6(push).alias("push"))


@query("""
    WITH p AS (SELECT l_partkey, l_extendedprice, max(l_shipdate) OVER (PARTITION BY l_partkey) AS newest, l_shipdate, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01'),
    c AS (SELECT l_partkey, median(l_extendedprice) AS line, count(DISTINCT l_suppkey) AS n FROM p WHERE l_shipdate = newest GROUP BY 1)
    SELECT p_partkey, round(coalesce(c.line, p_retailprice), 6) AS line, CASE WHEN c.line IS NOT NULL THEN 'snapshot' ELSE 'list' END AS source, coalesce(n, 0) AS n_books FROM part LEFT JOIN c ON p_partkey = l_partkey""")
def consensus_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of the latest set before the bound, else the list price, with its label."""
    before = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1999-06-01").cast("timestamp_ntz"))
    newest = asof.latest_set(before.select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), ["l_partkey"], "l_shipdate")
    line = newest.groupBy("l_partkey").agg(F.median("l_extendedprice").alias("line"), F.countDistinct("l_suppkey").alias("n"))
    rows = table(spark, sf_dir, "part").join(line, F.col("p_partkey") == F.col("l_partkey"), "left")
    value, label = asof.ladder(("snapshot", F.col("line")), ("list", F.col("p_retailprice")))
    return rows.select("p_partkey", r6(value).alias("line"), label.alias("source"), F.coalesce("n", F.lit(0)).cast("long").alias("n_books"))
