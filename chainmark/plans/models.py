"""Stacking, calibration, priors and simulation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models
from .analytics import _sql_cdf
from .evaluation import _ROWS, _all6, _rows
from .registry import query, r6, table


@query("""
    WITH b AS (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT y, sum(s) OVER w / sum(n) OVER w AS oof FROM b WINDOW w AS (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT o_orderkey, round(oof, 4) AS oof FROM orders JOIN c ON y = year(o_orderdate)""")
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.out_of_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), F.year("o_orderdate"), "o_totalprice")
    return found.select("o_orderkey", F.round("oof", 4).alias("oof"))


@query(f"""
    WITH {_ROWS}, m AS (SELECT regime, count(*) AS n, CAST(sum((mu_a - mu_b) * (mu_a - mu_b)) AS DOUBLE) AS dd, CAST(sum((mu_a - mu_b) * (margin - mu_b)) AS DOUBLE) AS de, CAST(sum((margin - mu_b) * (margin - mu_b)) AS DOUBLE) AS ee FROM f GROUP BY 1), w AS (SELECT *, greatest(0, least(1, de / dd)) AS w FROM m)
    SELECT regime, n, round(w, 6) AS w, round(sqrt((ee - 2 * w * de + w * w * dd) / n), 6) AS rmse FROM w""")
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("margin", "mu_a", "mu_b")})
    return _all6(models.stack_two(rows, ["regime"], "margin", "mu_a", "mu_b"))


@query("""
    WITH p AS (SELECT p_partkey, [x for x in [p_size * 1.0, p_retailprice / 100, CASE WHEN p_partkey % 3 = 0 THEN 12.0 END] if x IS NOT NULL] AS m FROM part)
    SELECT p_partkey, round(sqrt(list_avg(list_transform(m, lambda x: (x - list_avg(m)) * (x - list_avg(m)))) + 9), 6) AS sigma FROM p""")
def ensemble_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = [F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.when(F.col("p_partkey") % 3 == 0, 12.0)]
    return table(spark, sf_dir, "part").select("p_partkey", r6(models.ensemble_sigma(members, F.lit(3.0))).alias("sigma"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax, stddev_pop(l_tax) OVER (PARTITION BY l_orderkey) <= 1e-12 AS flat FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT flat THEN round(l_tax, 6) END AS l_tax, CASE WHEN flat THEN 'l_tax' ELSE '' END AS reason FROM s""")
def credible_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.credible(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax"), ["l_orderkey"], ["l_tax"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", r6("l_tax").alias("l_tax"), "reason")


@query(f"""
    WITH {_ROWS}, p AS (SELECT regime, {_sql_cdf("((margin - mu_a) / sigma)")} AS u FROM f), g AS (SELECT range / 20.0 AS grid FROM range(1, 20))
    SELECT regime, CAST(grid AS DOUBLE) AS grid, round(avg((u <= grid)::INT), 6) AS mapped, round(abs(avg((u <= grid)::INT) - max(grid)), 6) AS gap FROM p, g GROUP BY ALL""")
def pit_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(n).cast("double") for n in ("margin", "mu_a", "sigma")}
    rows = _rows(spark, sf_dir).select("regime", models.pit(c["margin"], c["mu_a"], c["sigma"]).alias("u"))
    return _all6(models.pit_map(rows, ["regime"], "u"))


@query("""
    WITH o AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal AS y, 4000.0 + c_custkey % 7 AS p, count(*) OVER () AS n FROM customer), r AS (SELECT range AS rep FROM range(1, 21)),
    e AS (SELECT rep, avg(abs(o.p - m.y)) AS m FROM o, r JOIN o m ON m.i = (o.i + CAST('0x' || substring(md5('p:' || rep), 1, 8) AS BIGINT) % greatest(1, o.n - 1) + 1) % o.n GROUP BY 1)
    SELECT round(t.mae, 4) AS mae, round(avg(m) - 2 * stddev_samp(m), 4) AS low, round(avg(m) + 2 * stddev_samp(m), 4) AS high, t.mae BETWEEN avg(m) - 2 * stddev_samp(m) AND avg(m) + 2 * stddev_samp(m) AS inside FROM e, (SELECT avg(abs(p - y)) AS mae FROM o) t GROUP BY t.mae""")
def permutation_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast that knows nothing stays inside the band of shuffled labels."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (4000.0 + F.col("c_custkey") % 7).alias("p"))
    found = models.chance_band(rows, "p", "c_acctbal", "c_custkey")
    return found.select(*[F.round(c, 4).alias(c) for c in ("mae", "low", "high")], "inside")


_RATED = "r AS (SELECT o_custkey AS team, o_custkey % 5 AS grp, CAST(year(o_orderdate) AS INTEGER) AS season, avg(o_totalprice) / 1000 AS rating, count(*) AS n FROM orders GROUP BY ALL)"
_DESIGN = "d AS (SELECT a.*, 0.5 * b.rating + 0.5 * m.m AS prior FROM r a LEFT JOIN r b ON b.team = a.team AND b.season = a.season - 1 LEFT JOIN (SELECT grp, season, avg(rating) AS m FROM r GROUP BY ALL) m ON m.grp = a.grp AND m.season = a.season - 1)"


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), (F.col("o_custkey") % 5).alias("grp"), F.year("o_orderdate").alias("season")).agg((F.avg("o_totalprice") / 1000).alias("rating"), F.count("*").alias("n"))
    return models.prior_design(rows, "season", "team", "grp", "rating")


@query(f"WITH {_RATED}, {_DESIGN} SELECT team, season, round(prior, 9) AS prior, round(CASE WHEN prior IS NULL THEN rating ELSE (prior / 4 + rating * n / 9.0) / (1 / 4.0 + n / 9.0) END, 9) AS blended, round(CASE WHEN prior IS NULL THEN 9.0 / n ELSE 1 / (1 / 4.0 + n / 9.0) END, 9) AS variance FROM d")
def team_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last season's rating pulled to its group, and its blend with what was seen since."""
    mean, variance = models.blended(F.col("prior"), F.lit(4.0), F.col("rating"), 9.0 / F.col("n"))
    return _design(spark, sf_dir).select("team", "season", F.round("prior", 9).alias("prior"), F.round(mean, 9).alias("blended"), F.round(variance, 9).alias("variance"))


@query(f"""
    WITH {_RATED}, {_DESIGN}, x AS (SELECT season, rating AS y, prior AS a, n AS b FROM d WHERE prior IS NOT NULL), m AS (SELECT season, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM x GROUP BY 1)
    SELECT season, n, round((ay * bb - yb * ab) / nullif(aa * bb - ab * ab, 0), 4) AS b1, round((yb * aa - ay * ab) / nullif(aa * bb - ab * ab, 0), 4) AS b2 FROM m WHERE n > 5""")
def prior_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.prior_fit(_design(spark, sf_dir), ["season"], "rating", "prior", "n").where("n > 5")
    return found.select("season", "n", F.round("b1", 4).alias("b1"), F.round("b2", 4).alias("b2"))


@query("""
    WITH d AS (SELECT s_suppkey, range AS draw, (CAST('0x' || substring(md5('d:' || s_suppkey || ':' || range), 1, 8) AS BIGINT) + 0.5) / 4294967296 AS u FROM supplier, range(200)) SELECT s_suppkey, round(avg(u), 6) AS mean, round(avg((u > 0.9)::INT), 6) AS tail FROM d GROUP BY 1""")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.draws(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 200)
    return found.groupBy("s_suppkey").agg(r6(F.avg("u")).alias("mean"), r6(F.avg((F.col("u") > 0.9).cast("double"))).alias("tail"))


@query("""SELECT n_regionkey, '{"n_regionkey":' || n_regionkey || ',"nations":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation GROUP BY 1""")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.artifact(table(spark, sf_dir, "nation"), ["n_regionkey"], "nations", ["n_nationkey"], ["n_nationkey", "n_name"])
