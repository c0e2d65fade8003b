"""Calibrators of three markets, and bootstraps of any statistic, on line items read as forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrators, inference
from .evaluation import _ROWS, _all6, _rows
from .registry import query

# probabilities are rounded: engines differ in the last digit of exp
_MARKETS = """
    m AS (
        SELECT game, 'moneyline' AS market, mu_a AS x, CASE WHEN margin > 0 THEN 1.0 WHEN margin < 0 THEN 0.0 END AS y FROM f
        UNION ALL SELECT game, 'spread', mu_a + spread, CASE WHEN margin + spread > 0 THEN 1.0 WHEN margin + spread < 0 THEN 0.0 END FROM f
        UNION ALL SELECT game, 'total', 24 * p - 12, CASE WHEN margin > spread THEN 1.0 WHEN margin < spread THEN 0.0 END FROM f),
    r AS (SELECT market, round(1 / (1 + exp(-x / 12)), 9) AS p, CAST(y AS DOUBLE) AS y, game % 2 = 0 AS train, game % 26 AS week FROM m WHERE y IS NOT NULL),
    pts AS (SELECT market, p, sum(y) AS s, CAST(count(*) AS DOUBLE) AS n FROM r WHERE train GROUP BY ALL)"""

_ISOTONIC = """
    run AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM pts WINDOW w AS (PARTITION BY market ORDER BY p ROWS UNBOUNDED PRECEDING)),
    pair AS (SELECT a.market, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM run a JOIN run b ON a.market = b.market AND a.i <= b.i),
    low AS (SELECT market, j, k, min(m) OVER (PARTITION BY market, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS g FROM pair),
    fit AS (SELECT market, k AS i, greatest(1e-6, least(1 - 1e-6, max(g))) AS value FROM low GROUP BY ALL),
    iso AS (SELECT run.market, p, n, value FROM run JOIN fit USING (market, i))"""


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, p, y, train, week) of every forecast, one scan for all markets."""
    side = lambda d: F.when(d > 0, 1.0).when(d < 0, 0.0)
    margin, spread = F.col("margin"), F.col("spread")
    each = {"moneyline": (F.col("mu_a"), side(margin)), "spread": (F.col("mu_a") + spread, side(margin + spread)), "total": (24 * F.col("p") - 12, side(margin - spread))}
    some = F.inline(F.array(*[F.struct(F.lit(k).alias("market"), x.cast("double").alias("x"), y.alias("y")) for k, (x, y) in each.items()]))
    rows = _rows(spark, sf_dir).select("game", some).where("y is not null")
    return rows.select("market", F.round(1 / (1 + F.exp(-F.col("x") / 12)), 9).alias("p"), "y", (F.col("game") % 2 == 0).alias("train"), (F.col("game") % 26).alias("week"))


# the min-max formula of isotonic regression, over all pairs of points
@query(f"WITH {_ROWS}, {_MARKETS}, {_ISOTONIC} SELECT market, round(p, 6) AS p, n, round(value, 6) AS value FROM iso")
def isotonic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = calibrators.points(_markets(spark, sf_dir).where("train"), ["market"], "p", "y")
    fit = calibrators.apply_steps(pts, ["market"], "p", calibrators.isotonic(pts, ["market"]), "value")
    return _all6(fit.select("market", "p", "n", "value"))


def _newton(name: str, x: str, penalty: float, steps: int = 14) -> str:
    out = [f"{name}0 AS (SELECT market, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM pts GROUP BY 1)"]
    for i in range(steps):
        out.append(f"""{name}s{i} AS (
            SELECT market, any_value(a) AS a, any_value(b) AS b, sum(e) AS g, sum(e * x) - {penalty} * any_value(b) AS gx, sum(w) AS h, sum(w * x) AS hx, sum(w * x * x) + {penalty} AS hxx
            FROM (SELECT market, a, b, {x} AS x, s - n / (1 + exp(-a - b * {x})) AS e, n / (1 + exp(-a - b * {x})) * (1 - 1 / (1 + exp(-a - b * {x}))) AS w FROM pts JOIN {name}{i} USING (market)) GROUP BY 1),
        {name}d{i} AS (SELECT market, a, b, (hxx * g - hx * gx) / (h * hxx - hx * hx) AS da, (h * gx - hx * g) / (h * hxx - hx * hx) AS db FROM {name}s{i}),
        {name}{i + 1} AS (SELECT market, a + da / greatest(1, abs(da) / 4, abs(db) / 4) AS a, b + db / greatest(1, abs(da) / 4, abs(db) / 4) AS b FROM {name}d{i})""")
    return ", ".join(out) + f", {name} AS (SELECT * FROM {name}{steps})"


@query(f"""
    WITH {_ROWS}, {_MARKETS}, {_newton('platt', 'p', 1.0)}, {_newton('cox', 'ln(p / (1 - p))', 0.0)}
    SELECT market, 'platt' AS kind, round(a, 5) AS a, round(b, 5) AS b FROM platt UNION ALL SELECT market, 'cox', round(a, 5), round(b, 5) FROM cox
    UNION ALL SELECT market, 'beta', CASE WHEN b > 0 THEN round(a, 5) ELSE 0 END, CASE WHEN b > 0 THEN round(b, 5) ELSE 1 END FROM cox""")
def logistic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt and beta maps and the calibration slope of every market."""
    pts = calibrators.kept(calibrators.points(_markets(spark, sf_dir).where("train"), ["market"], "p", "y"))
    each = [f(pts, ["market"]).select("market", F.lit(k).alias("kind"), F.round("a", 5).alias("a"), F.round("b", 5).alias("b")) for k, f in (("platt", calibrators.platt), ("cox", calibrators.cox), ("beta", calibrators.beta))]
    return each[0].unionByName(each[1]).unionByName(each[2])


_LOSS = "-(y * ln(greatest(1e-15, least(1 - 1e-15, {0}))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, {0}))))"


@query(f"""
    WITH {_ROWS}, {_MARKETS}, {_ISOTONIC},
    v AS (SELECT DISTINCT market, p FROM r WHERE NOT train),
    a AS (SELECT v.market, v.p, iso.p AS p0, iso.value AS v0 FROM v ASOF LEFT JOIN iso ON v.market = iso.market AND v.p >= iso.p),
    b AS (SELECT v.market, v.p, iso.p AS p1, iso.value AS v1 FROM v ASOF LEFT JOIN iso ON v.market = iso.market AND v.p <= iso.p),
    cal AS (SELECT market, p, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END AS q FROM a JOIN b USING (market, p)),
    gain AS (SELECT market, week, {_LOSS.format('p')} - ({_LOSS.format('q')}) AS d FROM r JOIN cal USING (market, p) WHERE NOT train),
    k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY week) - 1 AS b, count(*) OVER (PARTITION BY market) AS blocks FROM (SELECT market, week, sum(d) AS s, count(*) AS n FROM gain GROUP BY ALL)),
    x AS (SELECT market, rep, CAST('0x' || substring(md5('gate:' || rep || ':' || b), 1, 8) AS BIGINT) % blocks AS b FROM k, (SELECT range AS rep FROM range(200))),
    boot AS (SELECT x.market, rep, sum(s) / sum(n) AS m FROM x JOIN k ON x.market = k.market AND x.b = k.b GROUP BY ALL),
    c AS (SELECT market, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM boot GROUP BY 1),
    e AS (SELECT market, CAST(sum(n) AS BIGINT) AS n, sum(s) / sum(n) AS delta FROM k GROUP BY 1)
    SELECT market, 'isotonic' AS kind, n, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, low > 0 AS applied FROM e JOIN c USING (market)""")
def calibration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps fitted on even games, let through or not by odd ones, weeks as blocks."""
    rows = _markets(spark, sf_dir)
    maps = calibrators.Calibrators(rows.where("train").withColumn("oof", F.lit(True)), "market", "p", "y", "oof")
    # enough rows a bin in all but the smallest tables; the rule itself has its tests
    maps.steps, maps.kinds = calibrators.kept(calibrators.isotonic(maps.points, ["market"])), calibrators.kept(maps.kinds.withColumn("kind", F.lit("isotonic")))
    return _all6(maps.gate(rows.where("not train"), ["week"], 200).drop("p"))


@query(f"""
    WITH {_ROWS}, d AS (SELECT regime, game % 20 AS week, mu_a - spread AS x, margin - spread AS y FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY week) - 1 AS b, count(*) OVER (PARTITION BY regime) AS blocks FROM (SELECT regime, week, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(x * y) AS DOUBLE) AS sxy, CAST(sum(y * y) AS DOUBLE) AS syy FROM d GROUP BY ALL)),
    x AS (SELECT regime, rep, CAST('0x' || substring(md5('ols:' || rep || ':' || b), 1, 8) AS BIGINT) % blocks AS b FROM k, (SELECT range AS rep FROM range(200))),
    m AS (SELECT k.regime, rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM x JOIN k ON x.regime = k.regime AND x.b = k.b GROUP BY ALL),
    t AS (SELECT regime, -1 AS rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM k GROUP BY 1),
    u AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM (SELECT * FROM m UNION ALL SELECT * FROM t)),
    w AS (SELECT regime, rep, 'slope' AS statistic, slope AS v FROM u UNION ALL SELECT regime, rep, 'intercept', (sy - slope * sx) / n FROM u UNION ALL SELECT regime, rep, 'correlation', (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) FROM u),
    g AS (SELECT regime, statistic, max(v) FILTER (rep < 0) AS estimate, stddev_samp(v) FILTER (rep >= 0) AS se, quantile_cont(v, 0.025) FILTER (rep >= 0) AS low, quantile_cont(v, 0.975) FILTER (rep >= 0) AS high, count(*) FILTER (rep >= 0 AND v <= 0) AS down, count(*) FILTER (rep >= 0 AND v >= 0) AS up FROM w GROUP BY ALL)
    SELECT regime, statistic, blocks AS n_blocks, round(estimate, 6) AS estimate, round(se, 6) AS se, round(low, 6) AS low, round(high, 6) AS high, round(least(1.0, 2 * least((down + 1) / 201.0, (up + 1) / 201.0)), 6) AS p
    FROM g JOIN (SELECT regime, max(blocks) AS blocks FROM k GROUP BY 1) USING (regime)""")
def encompassing_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the forecast's distance from the line tell the result's? Slopes with errors by whole weeks."""
    rows = _rows(spark, sf_dir).withColumn("week", F.col("game") % 20)
    return _all6(inference.line_bootstrap(rows, ["regime"], ["week"], F.col("mu_a") - F.col("spread"), F.col("margin") - F.col("spread"), 200))
