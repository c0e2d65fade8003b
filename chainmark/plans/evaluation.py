"""Evaluation, settlement and gates on line items read as forecasts of games."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import asof, betting, distribution, evaluation, quality, ratings
from ..sources import store as stores
from .registry import query, r6, spread, table

#: Columns of a forecast as expressions that Spark and DuckDB read alike; doubles, as means of decimals are cut.
_ROW = {
    "game": "l_orderkey",
    "line_no": "l_linenumber",
    "regime": "l_returnflag",
    "status": "l_linestatus",
    "margin": "CAST(floor(l_quantity) AS INTEGER) - 25",
    "spread": "CAST(floor(l_extendedprice) AS INTEGER) % 29 - 14",
    "mu_a": "CAST(floor(l_quantity) - 25 + l_partkey % 13 - 6 AS DOUBLE)",
    "mu_b": "CAST(floor(l_quantity) - 25 + l_suppkey % 17 - 8 AS DOUBLE)",
    "sigma": "CAST(4 + l_partkey % 7 AS DOUBLE)",
    "p": "CAST(1 + l_partkey % 97 AS DOUBLE) / 99",
}
_ROWS = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ROW.items()) + " FROM lineitem)"
_ATS = "y AS (SELECT *, CASE WHEN margin + spread > 0 THEN 1.0 WHEN margin + spread < 0 THEN 0.0 END AS y FROM f)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _ROW.items()])


def _all6(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t in ("double",) or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _y() -> Column:
    return evaluation.covered(F.col("margin"), F.col("spread"))


@query(f"WITH {_ROWS} SELECT regime, count(*) FILTER (margin > 0) AS won, count(*) FILTER (margin < 0) AS lost, count(*) FILTER (margin + spread > 0) AS covered, count(*) FILTER (margin + spread = 0) AS pushed, count(*) FILTER (margin > spread) AS over FROM f GROUP BY 1")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    won, cover, over = evaluation.won(F.col("margin"), F.lit(0)), _y(), evaluation.over(F.col("margin"), F.col("spread"))
    return _rows(spark, sf_dir).groupBy("regime").agg(F.count_if(won == 1).alias("won"), F.count_if(won == 0).alias("lost"), F.count_if(cover == 1).alias("covered"), F.count_if(cover.isNull()).alias("pushed"), F.count_if(over == 1).alias("over"))


@query(f"""
    WITH {_ROWS}, {_ATS}, s AS (SELECT regime, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS rate FROM y WHERE y IS NOT NULL GROUP BY 1)
    SELECT regime, n, round(rate, 6) AS rate, round(0.5 - 3 * sqrt(0.25 / n), 6) AS low, round(0.5 + 3 * sqrt(0.25 / n), 6) AS high, rate BETWEEN 0.5 - 3 * sqrt(0.25 / n) AND 0.5 + 3 * sqrt(0.25 / n) AS plausible FROM s""")
def ats_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.plausibility(_rows(spark, sf_dir), ["regime"], F.col("p"), _y()))


@query(f"""
    WITH {_ROWS}, l AS (SELECT * FROM (VALUES (0.5, 0.6744897501960817), (0.8, 1.2815515655446004), (0.9, 1.6448536269514722), (0.95, 1.959963984540054)) AS x(level, z))
    SELECT CAST(level AS DOUBLE) AS level, count(*) AS n, round(avg(CASE WHEN margin BETWEEN mu_a - z * sigma AND mu_a + z * sigma THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(2 * z * sigma), 6) AS mean_width FROM f, l GROUP BY 1""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.interval_coverage(_rows(spark, sf_dir), "margin", "mu_a", "sigma"))


@query(f"""
    WITH {_ROWS}, e AS (SELECT *, mu_a - margin AS e FROM f), s AS (SELECT 'regime' AS family, regime AS value, e FROM e UNION ALL SELECT 'status', status, e FROM e UNION ALL SELECT 'favourite', CASE WHEN spread < 0 THEN 'home' ELSE 'away' END, e FROM e)
    SELECT family, value, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM s GROUP BY ALL""")
def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"regime": F.col("regime"), "status": F.col("status"), "favourite": F.when(F.col("spread") < 0, "home").otherwise("away")}
    return _all6(evaluation.slices(_rows(spark, sf_dir), families, F.col("mu_a") - F.col("margin")))


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN -110 - p_size END AS h, 100 + p_size AS a FROM part), q AS (SELECT *, 1 / (1 + 100.0 / -h) AS x, 1 / (1 + a / 100.0) AS y FROM p)
    SELECT p_partkey, 'DEVIGGED_AMERICAN' AS status, round(x / (x + y), 6) AS p_market, 'NOT_COMPUTED' AS without_prices FROM q""")
def market_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices where there are any; a constant half is no market."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, -110 - F.col("p_size")).alias("h"), (100 + F.col("p_size")).alias("a"), F.lit(0.5).alias("given"), F.lit(None).cast("int").alias("none"))
    found = evaluation.market_moneyline(rows, "h", "a", "given").select("p_partkey", "status", r6("p_market").alias("p_market"))
    empty = evaluation.market_moneyline(rows, "none", "none", "given").select("p_partkey", F.col("status").alias("without_prices"))
    return found.join(empty, "p_partkey")


@query(f"""
    WITH {_ROWS}, g AS (SELECT regime, game, line_no, CAST(p / 100 AS DOUBLE) AS stake, CASE WHEN margin + spread > 0 THEN 0.909 ELSE -1.0 END AS profit, mu_b FROM f),
    b AS (SELECT *, exp(sum(ln(1 + stake * profit)) OVER (PARTITION BY regime ORDER BY game, line_no, mu_b, stake, profit ROWS UNBOUNDED PRECEDING)) AS b FROM g),
    k AS (SELECT *, greatest(1.0, max(b) OVER (PARTITION BY regime ORDER BY game, line_no, mu_b, stake, profit ROWS UNBOUNDED PRECEDING)) AS peak FROM b)
    SELECT regime, count(*) AS bets, round(sum(stake * profit) / sum(stake), 6) AS roi, round(max(1 - b / peak), 6) AS max_drawdown, round(avg(stake * profit) / stddev_samp(stake * profit), 6) AS sharpe FROM k GROUP BY 1""")
def bet_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("regime", "game", "line_no", "mu_b", (F.col("p") / 100).alias("stake"), F.when(F.col("margin") + F.col("spread") > 0, 0.909).otherwise(-1.0).alias("profit"))
    return _all6(evaluation.economics(rows, ["regime"], ["game", "line_no", "mu_b", "stake", "profit"], "stake", "profit").drop("final"))


@query("""
    WITH b AS (SELECT l_partkey AS game, l_suppkey AS book, max(l_tax) AS bet FROM lineitem GROUP BY ALL), o AS (SELECT ps AS game, book, fair FROM (SELECT l_partkey AS ps, l_suppkey AS book, avg(l_discount) AS fair FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)),
    c AS (SELECT l_partkey AS game, median(l_discount) AS fair FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT b.game, b.book, round(coalesce(o.fair, c.fair), 6) AS close_fair, CASE WHEN o.fair IS NOT NULL THEN 'same_book' ELSE 'consensus' END AS close_source, o.fair IS NOT NULL AS headline
    FROM b LEFT JOIN o USING (game, book) LEFT JOIN c USING (game) WHERE coalesce(o.fair, c.fair) IS NOT NULL""")
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("game"), F.col("l_suppkey").alias("book"), "l_tax", "l_discount", "l_quantity")  # noqa: E741
    bets = l.groupBy("game", "book").agg(F.max("l_tax").alias("bet"))
    closes = l.where("l_quantity > 40").groupBy("game", "book").agg(F.avg("l_discount").alias("fair")).withColumn("row_id", F.xxhash64("game", "book"))
    consensus = l.where("l_quantity > 45").groupBy("game").agg(F.median("l_discount").alias("fair"))
    return _all6(evaluation.settle(bets, closes, consensus, ["game"], "book").select("game", "book", "close_fair", "close_source", "headline"))


_LADDER = """
    WITH p AS (SELECT p_partkey, p_size % 3 AS bet, p_size % 2 AS cl, 0.5 + p_size / 200.0 AS fair, CASE WHEN p_partkey % 4 = 0 THEN 0.4 END AS alt, CASE WHEN p_partkey % 3 = 0 THEN 0.6 END AS mb FROM part)
    SELECT p_partkey, round(CASE WHEN bet = cl THEN fair WHEN alt IS NOT NULL THEN alt WHEN mb IS NOT NULL THEN least(greatest(fair + mb - 0.55, 0), 1) END, 6) AS fair,
        CASE WHEN bet = cl THEN 'same_line' WHEN alt IS NOT NULL THEN 'alternate_quote' WHEN mb IS NOT NULL THEN 'model_dist' ELSE 'points_only' END AS how,
        CASE WHEN p_partkey % 10 = 0 THEN 'void_stale' WHEN p_partkey % 5 < 3 AND abs(bet - cl) > 0.5 THEN 'void_moved' ELSE 'ok' END AS gate FROM p"""


@query(_LADDER)
def line_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder from the close's line to the bet's, and whether the bet may still be confirmed."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).cast("double").alias("bet"), (F.col("p_size") % 2).cast("double").alias("close"), (0.5 + F.col("p_size") / 200.0).alias("fair"), F.when(k % 4 == 0, 0.4).alias("alt"), F.when(k % 3 == 0, 0.6).alias("mb"))
    value, how = evaluation.translated(F.col("bet"), F.col("close"), F.col("fair"), F.col("alt"), F.col("mb"), F.lit(0.55))
    market = F.when(k % 5 == 0, "spread").when(k % 5 < 3, "total").otherwise("h2h")
    return rows.select("p_partkey", r6(value).alias("fair"), how.alias("how"), evaluation.confirmation(market, F.col("bet"), F.col("close"), k % 10 == 0).alias("gate"))


@query("SELECT l_partkey, round(min(l_tax), 6) AS best, round(median(l_tax), 6) AS consensus, round(median(l_tax) - min(l_tax), 6) AS capture FROM lineitem GROUP BY 1")
def shopping_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.shopping(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_tax"))


@query(f"""
    WITH {_ROWS}, g AS (SELECT range / 100.0 AS w FROM range(101)), m AS (SELECT w, round(avg(abs(margin - w * mu_a - (1 - w) * mu_b)), 9) AS mae FROM f, g GROUP BY 1)
    SELECT CAST(arg_min(w, (mae, w)) AS DOUBLE) AS w, round(min(mae), 6) AS mae FROM m""")
def optimal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.mix_weight(_rows(spark, sf_dir), "margin", "mu_a", "mu_b"))


@query(f"""
    WITH {_ROWS}, g AS (SELECT regime, status, avg(CAST(mu_a - margin AS DOUBLE)) AS e, var_samp(CAST(mu_a - margin AS DOUBLE)) / count(*) AS v FROM f GROUP BY ALL), s AS (SELECT count(*) AS k, sum(1 / v) AS s1, sum(1 / v / v) AS s2, sum(e / v) AS sx, sum(e * e / v) AS sxx FROM g),
    q AS (SELECT k, sxx - sx * sx / s1 AS q, greatest(0, (sxx - sx * sx / s1 - k + 1) / (s1 - s2 / s1)) AS t FROM s)
    SELECT k, round(q, 6) AS q, round(CASE WHEN q > 0 THEN greatest(0, (q - k + 1) / q) ELSE 0 END, 6) AS i2, round(t, 6) AS tau2, round(sum(e / (v + t)) / sum(1 / (v + t)), 6) AS pooled, round(1 / sqrt(sum(1 / (v + t))), 6) AS se FROM g, q GROUP BY k, q, t""")
def random_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (F.col("mu_a") - F.col("margin")).cast("double")
    groups = _rows(spark, sf_dir).groupBy("regime", "status").agg(F.avg(e).alias("e"), (F.var_samp(e) / F.count("*")).alias("v"))
    return _all6(evaluation.random_effects(groups, "e", "v"))


@query(f"WITH {_ROWS} SELECT regime, count(*) AS n, round(avg(mu_a - mu_b), 6) AS mean_signed, round(avg(abs(mu_a - mu_b)), 6) AS mean_abs, round(avg(abs(margin - mu_a) - abs(margin - mu_b)), 6) AS error_gap, round(avg(CASE WHEN abs(margin - mu_a) > abs(margin - mu_b) THEN 1.0 ELSE 0.0 END), 6) AS share_worse FROM f GROUP BY 1")
def disagreement_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.disagreement(_rows(spark, sf_dir), ["regime"], "margin", "mu_a", "mu_b"))


@query(f"""
    WITH {_ROWS}, u AS (SELECT 'mu_a' AS forecast, margin - mu_a AS e FROM f UNION ALL SELECT 'mu_b', margin - mu_b FROM f UNION ALL SELECT 'spread', margin + spread FROM f) SELECT forecast, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM u GROUP BY 1""")
def forecast_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("spread", -F.col("spread"))
    return _all6(evaluation.comparison(rows, "margin", ["mu_a", "mu_b", "spread"]))


@query(f"""
    WITH {_ROWS}, q AS (SELECT quantile_cont(sigma, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM f)
    SELECT CAST(len(list_filter(cuts, lambda c: c < sigma)) AS INTEGER) AS decile, count(*) AS n, round(avg(sigma), 6) AS predicted, round(stddev_pop(mu_a - margin), 6) AS realised FROM f, q GROUP BY 1""")
def sigma_informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumns({"sigma": F.col("sigma").cast("double"), "e": F.col("mu_a") - F.col("margin")})
    return _all6(evaluation.sigma_deciles(rows, "sigma", "e"))


@query(f"""
    WITH {_ROWS}, e AS (SELECT regime, CAST(mu_b - margin AS DOUBLE) AS e FROM f), m AS (SELECT regime, avg(e) AS m FROM e GROUP BY 1), c AS (SELECT regime, count(*) AS n, avg(pow(e - m, 2)) AS c2, avg(pow(e - m, 3)) AS c3, avg(pow(e - m, 4)) AS c4 FROM e JOIN m USING (regime) GROUP BY 1)
    SELECT regime, n, round(c3 / pow(c2, 1.5), 6) AS skewness, round(c4 / c2 / c2 - 3, 6) AS excess, round(n / 6 * (pow(c3 / pow(c2, 1.5), 2) + pow(c4 / c2 / c2 - 3, 2) / 4), 4) AS jb FROM c""")
def residual_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("e", F.col("mu_b") - F.col("margin"))
    return evaluation.jarque_bera(rows, ["regime"], "e").select("regime", "n", r6("skewness").alias("skewness"), r6("excess").alias("excess"), F.round("jb", 4).alias("jb"))


@query("SELECT user_id, CASE WHEN value - 5 < 20 AND 20 < value + 5 THEN round(value - 5, 6) END AS q10, CASE WHEN value - 5 < 20 AND 20 < value + 5 THEN round(value + 5, 6) END AS q90, event_id FROM events")
def interval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").withColumn("band", evaluation.coherent(v - 5, F.lit(20), v + 5))
    return rows.select("user_id", r6("band.q10").alias("q10"), r6("band.q90").alias("q90"), "event_id")


@query("""
    WITH t AS (SELECT user_id, CASE WHEN 0.5 + value % 10 / 20 >= 0.85 THEN 'strong_lean' WHEN 0.5 + value % 10 / 20 >= 0.7 THEN 'clear_lean' WHEN 0.5 + value % 10 / 20 >= 0.575 THEN 'lean' ELSE 'toss_up' END AS tier FROM events WHERE value IS NOT NULL),
    s AS (SELECT user_id, count(*) AS n, avg((tier = 'strong_lean')::INT) AS a, avg((tier = 'toss_up')::INT) AS b FROM t GROUP BY 1) SELECT user_id, n, round(a, 6) AS strong_share, round(b, 6) AS bottom_share, a > 0.5 OR b < 0.05 AS degenerate FROM s""")
def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", betting.tier(0.5 + F.col("value") % 10 / 20).alias("tier"))
    return _all6(evaluation.tier_histogram(rows, ["user_id"], "tier"))


_GATE = "SELECT l_orderkey, '{c}' AS feature, count(*) AS n, round(stddev_pop({c}), 6) AS sd, round(avg(({c} = 0)::INT), 6) AS zero_rate, stddev_pop({c}) <= 1e-12 AS flat FROM lineitem GROUP BY 1"


@query(" UNION ALL ".join(_GATE.format(c=c) for c in ("l_tax", "l_discount")))
def block_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all6(evaluation.block_gates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_tax", "l_discount"]))


@query("SELECT l_suppkey, round(max(l_tax), 6) AS best, arg_min(l_orderkey, (-l_tax, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def best_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = betting.best_price(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax", "l_orderkey"), ["l_suppkey"], "l_tax", "l_orderkey")
    return found.select("l_suppkey", r6("l_tax").alias("best"), "l_orderkey")


_BUCKET = "(abs(mu_a) >= 3.5)::INT + (abs(mu_a) >= 7.5)::INT + (abs(mu_a) >= 14.5)::INT + (abs(mu_a) >= 21.5)::INT"


@query(f"""
    WITH {_ROWS}, o AS (SELECT {_BUCKET} AS bucket, CAST(margin - round_even(mu_a, 0) AS INTEGER) AS offset_ FROM f), b AS (SELECT * FROM o UNION ALL SELECT -1, offset_ FROM o),
    c AS (SELECT bucket, offset_, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT *, CASE WHEN n >= 5 THEN n / avg(n) OVER (PARTITION BY bucket) ELSE 1.0 END AS w, sum(n) OVER (PARTITION BY bucket) AS rows_ FROM c)
    SELECT CAST(bucket AS INTEGER) AS bucket, offset_ AS k, round(w / avg(w) OVER (PARTITION BY bucket), 6) AS weight FROM w WHERE rows_ >= 40 OR bucket = -1""")
def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = distribution.key_number_kernel(_rows(spark, sf_dir).withColumn("mu_a", F.col("mu_a").cast("double")), "mu_a", "margin")
    return kernel.select("bucket", F.explode("kernel").alias("k", "weight")).select("bucket", "k", r6("weight").alias("weight"))


@query("""
    WITH k AS (SELECT range - 80 AS k, CASE range - 80 WHEN 3 THEN 2.0 WHEN -3 THEN 1.5 ELSE 1.0 END AS w FROM range(161)), g AS (SELECT s_suppkey, s_acctbal / 1000 - 4 AS mu FROM supplier),
    z AS (SELECT s_suppkey, mu, k, w, (k + 0.5 - mu) / 14.0 AS hi, (k - 0.5 - mu) / 14.0 AS lo FROM g, k),
    e AS (SELECT *, 1 / (1 + abs(hi) * 0.2316419) AS th, 1 / (1 + abs(lo) * 0.2316419) AS tl FROM z),
    t AS (SELECT *, exp(-hi * hi / 2) / sqrt(2 * pi()) * th * (0.319381530 + th * (-0.356563782 + th * (1.781477937 + th * (-1.821255978 + th * 1.330274429)))) AS uh, exp(-lo * lo / 2) / sqrt(2 * pi()) * tl * (0.319381530 + tl * (-0.356563782 + tl * (1.781477937 + tl * (-1.821255978 + tl * 1.330274429)))) AS ul FROM e),
    m AS (SELECT s_suppkey, k, ((CASE WHEN hi >= 0 THEN 1 - uh ELSE uh END) - (CASE WHEN lo >= 0 THEN 1 - ul ELSE ul END)) * CASE k - round_even(mu, 0) WHEN 3 THEN 2.0 WHEN -3 THEN 1.5 ELSE 1.0 END AS q FROM t)
    SELECT s_suppkey, round(sum(q) FILTER (k > 0) / (sum(q) - sum(q) FILTER (k = 0)), 6) AS win FROM m GROUP BY 1""")
def kernel_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin distribution under a kernel of key numbers."""
    kernel = F.create_map(F.lit(3), F.lit(2.0), F.lit(-3), F.lit(1.5))
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey").select("s_suppkey", distribution.pmf(F.col("s_acctbal") / 1000 - 4, F.lit(14.0), kernel).alias("dist"))
    return rows.select("s_suppkey", r6(distribution.cover(F.col("dist"), F.lit(0))[0]).alias("win"))


@query(f"WITH {_ROWS} SELECT regime, round(greatest(-0.95, least(0.95, coalesce(corr(mu_a - margin, mu_b - margin), 0))), 6) AS rho, round(avg(mu_a), 6) AS mu, round(sqrt(avg(sigma * sigma) + var_pop(mu_a)), 6) AS sigma FROM f GROUP BY 1")
def bivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual correlation and the mixture's moments by regime."""
    rows = _rows(spark, sf_dir)
    rho = rows.groupBy("regime").agg(distribution.residual_correlation(F.col("mu_a") - F.col("margin"), F.col("mu_b") - F.col("margin")).alias("rho"))
    return _all6(rho.join(distribution.mixture(rows.withColumns({c: F.col(c).cast("double") for c in ("mu_a", "sigma")}), ["regime"], "mu_a", "sigma"), "regime"))


@query("""
    SELECT 'l_tax' AS feature, round(avg((l_tax IS NULL)::INT), 6) AS null_share, round(max(l_tax) - min(l_tax), 6) AS span, max(l_tax) = min(l_tax) AS constant, round(corr(l_tax, l_quantity), 6) AS correlation, abs(corr(l_tax, l_quantity)) > 0.99 AS leaks FROM lineitem
    UNION ALL SELECT 'l_quantity', avg((l_quantity IS NULL)::INT), max(l_quantity) - min(l_quantity), max(l_quantity) = min(l_quantity), round(corr(l_quantity, l_quantity), 6), true FROM lineitem""")
def feature_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null share, span and suspicious correlation with the label of every feature."""
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_quantity"))
    gates = quality.null_gates(rows, ["l_tax", "l_quantity"]).select("feature", "null_share", "span", "constant")
    return _all6(gates.join(quality.leaks(rows, ["l_tax", "l_quantity"], "label"), "feature"))


@query("""
    WITH a AS (SELECT user_id, event_id, ts, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = user_id AND o_orderdate < ts) AS newest FROM events)
    SELECT event_id, count(o_orderkey) AS n, round(median(o_totalprice), 6) AS line FROM a LEFT JOIN orders ON o_custkey = user_id AND o_orderdate = newest GROUP BY 1""")
def latest_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders at the latest instant before each event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_totalprice", "o_orderdate")
    found = asof.asof_latest_set(e, o, ["user_id"], "ts", "o_orderdate").join(o.withColumnRenamed("o_orderdate", "__set_ts"), ["user_id", "__set_ts"], "left")
    return found.groupBy("event_id").agg(F.count("o_orderkey").alias("n"), r6(F.median("o_totalprice")).alias("line"))


@query("SELECT o_orderkey, round(pow(0.5, (2000 - year(o_orderdate)) / 2.0), 6) AS weight, round(1 / (1 + pow(10.0, -(o_totalprice % 400 - 200) / 400)), 6) AS p, round(ln((0.01 + o_orderkey % 90 / 100.0) / (0.99 - o_orderkey % 90 / 100.0)), 6) AS logit FROM orders")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, q = F.col("o_totalprice") % 400 - 200, 0.01 + F.col("o_orderkey") % 90 / 100.0
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(numbers.decay(2000 - F.year("o_orderdate"), 2)).alias("weight"), r6(ratings.elo_expected(price)).alias("p"), r6(evaluation.logit(q)).alias("logit"))


@query("""
    WITH u AS (SELECT n_nationkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('n' || n_nationkey)) AS h FROM nation)
    SELECT n_nationkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE substring(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM u""")
def named_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("n"), F.col("n_nationkey"))).alias("id"))


_SEASONS = stores.TableSpec("orders_by_year", "o_orderkey long, price double, season int", ("season",), ("season", "o_orderkey"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1")
def store_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of seasons from the store, and SQL over its registered tables."""
    store = stores.Store(spark, f"{stores.scratch(spark)}/store-{uuid.uuid4().hex}", [_SEASONS])
    store.overwrite(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("season")), _SEASONS.name)
    store.register()
    years = store.seasons(_SEASONS.name, 1995, 1997).select("season").distinct()
    return spark.sql(f"SELECT season, count(*) AS n, round(sum(price), 2) AS total FROM {_SEASONS.name} GROUP BY season").join(years, "season")


@query("SELECT status, count(*) AS n FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN year(o_orderdate) = 1996 THEN 'changed' WHEN year(o_orderdate) = 1997 THEN 'missing' END AS status FROM orders) WHERE status IS NOT NULL GROUP BY 1")
def store_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which partitions of a copy are missing or have other content."""
    at = f"{stores.scratch(spark)}/inventory-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    o = o.repartition("season").sortWithinPartitions("season", "o_orderkey").persist()
    for name, rows in (("a", o), ("b", o.where("season <> 1997").withColumn("o_orderkey", F.when(F.col("season") == 1996, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))))):
        rows.write.partitionBy("season").json(f"{at}/{name}")
    part = lambda name: stores.inventory(spark, f"{at}/{name}").groupBy(F.regexp_extract("path", "season=[0-9]+", 0).alias("path")).agg(F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias("sha256"))
    return stores.compare_inventories(part("a"), part("b")).groupBy("status").agg(F.count("*").alias("n"))
