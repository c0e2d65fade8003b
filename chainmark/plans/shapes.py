"""Stacking of three members and shapes of residuals, on line items read as forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import shape, stacking
from .analytics import _sql_cdf
from .evaluation import _ROWS, _all6, _rows
from .registry import query, r6, table

_ONE, _TWO = ("a", "b", "c"), (("a", "b"), ("a", "c"), ("b", "c"))
_PAIR = "greatest(0, least(1, sum(({p} - {q}) * (y - {q})) / sum(({p} - {q}) * ({p} - {q}))))"


# every subset of three members in closed form; of the feasible solutions the least loss
@query(f"""
    WITH {_ROWS}, d AS (SELECT regime, CAST(margin AS DOUBLE) AS y, mu_a AS a, mu_b AS b, CAST(spread AS DOUBLE) AS c FROM f),
    pairs AS (SELECT regime, {', '.join(_PAIR.format(p=p, q=q) + f' AS w{p}{q}' for p, q in _TWO)},
        sum((a - c) * (a - c)) AS uu, sum((b - c) * (b - c)) AS vv, sum((a - c) * (b - c)) AS uv, sum((a - c) * (y - c)) AS ue, sum((b - c) * (y - c)) AS ve FROM d GROUP BY 1),
    t AS (SELECT *, (ue * vv - ve * uv) / (uu * vv - uv * uv) AS ta, (ve * uu - ue * uv) / (uu * vv - uv * uv) AS tb FROM pairs),
    w AS (SELECT regime, wab AS wa, 1 - wab AS wb, 0.0 AS wc FROM t UNION ALL SELECT regime, wac, 0.0, 1 - wac FROM t UNION ALL SELECT regime, 0.0, wbc, 1 - wbc FROM t UNION ALL SELECT regime, ta, tb, 1 - ta - tb FROM t WHERE ta >= 0 AND tb >= 0 AND ta + tb <= 1),
    l AS (SELECT regime, wa, wb, wc, count(*) AS n, sqrt(avg((y - wa * a - wb * b - wc * c) * (y - wa * a - wb * b - wc * c))) AS rmse FROM w JOIN d USING (regime) GROUP BY ALL),
    best AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY regime ORDER BY rmse) = 1)
    SELECT regime, n, round(wa, 6) AS w_a, round(wb, 6) AS w_b, round(wc, 6) AS w_c, round(rmse, 6) AS rmse FROM best""")
def simplex_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("regime", F.col("margin").cast("double").alias("y"), F.col("mu_a").alias("a"), F.col("mu_b").alias("b"), F.col("spread").cast("double").alias("c"), F.lit(True).alias("oof"))
    found = stacking.stack(rows, ["regime"], "y", list(_ONE), "oof")
    return _all6(found.select("regime", "n", *[F.get("weights", i).alias(f"w_{m}") for i, m in enumerate(_ONE)], "rmse"))


@query(f"""
    WITH {_ROWS}, z AS (SELECT regime, (margin - mu_a) / sigma AS z, {_sql_cdf("((margin - mu_a) / sigma)")} AS u FROM f),
    r AS (SELECT regime, u, row_number() OVER (PARTITION BY regime ORDER BY z) AS i, count(*) OVER (PARTITION BY regime) AS n FROM z)
    SELECT regime, max(n) AS n, round(max(greatest(abs(i * 1.0 / n - u), abs(u - (i - 1) * 1.0 / n))), 6) AS ks FROM r GROUP BY 1""")
def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far standardised residuals are from the normal distribution."""
    rows = _rows(spark, sf_dir).withColumn("z", (F.col("margin") - F.col("mu_a")) / F.col("sigma")).withColumn("id", F.monotonically_increasing_id())
    return _all6(shape.kolmogorov(rows, ["regime"], "z", "id", numbers.normal_cdf(F.col("z"))))


@query("""
    WITH s AS (SELECT l_suppkey, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    y AS (SELECT s_suppkey AS l_suppkey, s_acctbal / 200 AS y FROM supplier)
    SELECT l_suppkey, any_value(n) AS n, round(avg(abs(v - y)) - sum((2 * i - 1 - n) * v) / (any_value(n) * any_value(n)), 6) AS crps FROM s JOIN y USING (l_suppkey) GROUP BY 1""")
def sample_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a supplier as a sample that forecasts one number."""
    draws = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    outcomes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 200).alias("y"))
    return shape.empirical_crps(draws, ["l_suppkey"], "l_quantity", "id", outcomes, "y").select("l_suppkey", "n", r6("crps").alias("crps"))
