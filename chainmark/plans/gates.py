"""Gates, rates and rules of eras on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import evaluation, records
from .calibration import _MARKETS, _markets, _newton
from .evaluation import _ROWS, _all6, _rows, _y
from .registry import query, r6, table


@query(f"WITH {_ROWS}, {_MARKETS}, {_newton('cox', 'ln(p / (1 - p))', 0.0)} SELECT round(a, 5) AS intercept, round(b, 5) AS slope FROM cox WHERE market = 'moneyline'")
def calibration_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = evaluation.calibration_slope(_markets(spark, sf_dir).where("train and market = 'moneyline'"), "p", "y")
    return spark.range(1).select(F.round(F.lit(a), 5).alias("intercept"), F.round(F.lit(b), 5).alias("slope"))


@query("""
    WITH s AS (SELECT l_returnflag AS family, l_shipmode_ AS member, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY ALL),
    p AS (SELECT family, member, 1 / (1 + abs(m - 25.5) / (sd / sqrt(n))) AS p FROM s)
    SELECT family, member, round(p, 6) AS p, round(0.05 / count(*) OVER w, 6) AS "limit", bool_and(p <= 0.05 / n_) OVER w AS promoted FROM (SELECT *, count(*) OVER (PARTITION BY family) AS n_ FROM p) WINDOW w AS (PARTITION BY family)""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family is promoted if all its members pass the limit divided by their number."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("member")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"))
    p = s.select("family", "member", (1 / (1 + F.abs(F.col("m") - 25.5) / (F.col("sd") / F.sqrt("n")))).alias("p"))
    return _all6(evaluation.bonferroni_gate(p, ["family"], "p"))


@query("SELECT l_returnflag, count(*) AS n, CAST(ceil(count(*) * pow(stddev_samp(l_tax) / sqrt(count(*)) * 2.8015852 / 0.001, 2)) AS BIGINT) AS needed FROM lineitem GROUP BY 1")
def power_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that would show an effect of a thousandth."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.stddev_samp("l_tax").alias("sd"))
    return s.select("l_returnflag", "n", evaluation.power_n(F.col("n"), F.col("sd") / F.sqrt("n"), 0.001).cast("long").alias("needed"))


@query("""
    WITH c AS (SELECT unnest([{'name': 'l_quantity', 'r': corr(l_quantity, l_extendedprice)}, {'name': 'l_tax', 'r': corr(l_tax, l_extendedprice)}, {'name': 'l_discount', 'r': corr(l_discount, l_extendedprice)}, {'name': 'l_linenumber', 'r': corr(l_linenumber, l_extendedprice)}]) AS x FROM lineitem)
    SELECT CAST(row_number() OVER (ORDER BY abs(x.r) DESC, x.name) AS INTEGER) AS place, x.name AS name FROM c QUALIFY place <= 2""")
def top_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = evaluation.top_correlated(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_discount", "l_linenumber"], "l_extendedprice", 2)
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, name string")


@query(f"""
    WITH {_ROWS}, s AS (SELECT regime, count(*) AS n, CAST(count(*) FILTER ((p >= 0.5) = (margin + spread > 0)) AS DOUBLE) AS k FROM f WHERE margin + spread <> 0 GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS r FROM s)
    SELECT regime, n, round(r, 6) AS rate, round((r + z * z / (2 * n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((r + z * z / (2 * n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z""")
def bounded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that carry their bounds."""
    rows = _rows(spark, sf_dir).withColumn("y", _y()).where("y is not null")
    return evaluation.rates(rows, ["regime"], (F.col("p") >= 0.5) == (F.col("y") == 1)).select("regime", "n", r6("rate.value").alias("rate"), r6("rate.low").alias("low"), r6("rate.high").alias("high"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-09-01' THEN 10 ELSE 5 END AS minutes, CASE WHEN o_orderkey % 14 <= CASE WHEN o_orderdate < TIMESTAMP '1996-09-01' THEN 10 ELSE 5 END THEN 'usable' ELSE 'too_old' END AS status FROM orders""")
def snapshot_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old a snapshot may be depends on the era of the decision."""
    o = table(spark, sf_dir, "orders")
    minutes = dates.tolerance_minutes(F.col("o_orderdate"), "1996-09-01")
    return o.select("o_orderkey", minutes.alias("minutes"), F.when(F.col("o_orderkey") % 14 <= minutes, "usable").otherwise("too_old").alias("status"))


@query("""
    SELECT p_partkey, substring(sha256('p_retailprice=' || printf('%.6f', p_retailprice) || chr(10) || 'p_size=' || printf('%.6f', CAST(p_size AS DOUBLE))), 1, 12) AS hash FROM part""")
def feature_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve digits that change with any feature's name or value, not with the order of columns."""
    return table(spark, sf_dir, "part").select("p_partkey", text.pair_hash({"p_size": F.col("p_size"), "p_retailprice": F.col("p_retailprice")}).alias("hash"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def published_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only listed columns of the expected types leave."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return records.same_signature(records.publishable(rows, {"key", "name"}, {"secret"}), [("key", "bigint"), ("name", "string")])
