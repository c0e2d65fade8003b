"""Window computations, dates and geometry on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import windows
from .registry import query, r6, table


@query("""
    WITH RECURSIVE x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, i, n, value AS s FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, x.n, (1 - pow(0.5, 1 / 6.5)) * x.value + pow(0.5, 1 / 6.5) * s.s FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
    SELECT user_id, round(s, 6) AS ewma FROM s WHERE i = n""")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.ewma(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 6.5)
    return found.select("user_id", r6("ewma").alias("ewma"))


@query("""
    SELECT user_id, round(avg(value) FILTER (k <= 3) - avg(value), 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY 1""")
def last3_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n_delta(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", r6("delta").alias("delta"))


@query("""
    SELECT o_orderkey, o_custkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_mean FROM orders""")
def expanding_prior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = windows.prior_mean("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", r6(mean).alias("prior_mean"))


@query("""
    SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS rest_days, coalesce(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) < 6, false) AS short,
        lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["o_orderdate", "o_orderkey"]
    rest = F.date_diff("o_orderdate", windows.gap("o_orderdate", ["o_custkey"], order)).cast("long")
    rows = table(spark, sf_dir, "orders").withColumns({"rest_days": rest, "next_key": F.lead("o_orderkey").over(windows.Window.partitionBy("o_custkey").orderBy(*order))})
    return rows.select("o_orderkey", "rest_days", F.coalesce(F.col("rest_days") < 6, F.lit(False)).alias("short"), "next_key")


@query("""
    WITH y AS (SELECT DISTINCT o_custkey, o_orderstatus, year(o_orderdate) AS season FROM orders),
    i AS (SELECT *, season - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY season) AS island FROM y)
    SELECT o_custkey, o_orderstatus, CAST(season AS INTEGER) AS season, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, island ORDER BY season) AS tenure FROM i""")
def islands_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("season")).distinct()
    found = windows.tenures(years, ["o_custkey"], "o_orderstatus", "season")
    return found.select("o_custkey", "o_orderstatus", "season", F.col("tenure").cast("long").alias("tenure"))


@query("""
    WITH z AS (SELECT event_id, user_id, ts, CASE WHEN value > 20 THEN 1 WHEN value < 2 THEN -1 ELSE 0 END AS side FROM events),
    n AS (SELECT *, CASE WHEN lag(side) OVER w = side THEN 0 ELSE 1 END AS new FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
    SELECT event_id, side <> 0 AND row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) % 3 = 0 AS alarm FROM r""")
def streak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("value") > 20, 3.0).when(F.col("value") < 2, -3.0).otherwise(0.0)
    return windows.streak_alarm(table(spark, sf_dir, "events").withColumn("z", z), ["user_id"], ["ts", "event_id"], "z").select("event_id", "alarm")


@query("""
    WITH o AS (SELECT c_mktsegment AS segment, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 100.0 ELSE -55.0 END AS change FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT *, 1000000 + sum(change) OVER (PARTITION BY segment ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS b FROM o),
    p AS (SELECT *, greatest(1000000.0, max(b) OVER (PARTITION BY segment ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM b)
    SELECT segment, round(CAST(arg_max(b, (o_orderdate, o_orderkey)) AS DOUBLE), 6) AS final, round(CAST(max((peak - b) / peak) AS DOUBLE), 6) AS max_drawdown FROM p GROUP BY 1""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("segment"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 100.0).otherwise(-55.0).alias("change"))
    found = windows.drawdown(rows, ["segment"], ["o_orderdate", "o_orderkey"], "change", 1_000_000)
    return found.select("segment", r6("final").alias("final"), r6("max_drawdown").alias("max_drawdown"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", r6(windows.zscore("c_acctbal", ["c_nationkey"])).alias("z"))


@query("""
    WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS x,
        rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS y FROM part)
    SELECT p_brand, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rank_correlation(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", r6("rho").alias("rho"))


@query("""
    WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY source ORDER BY md5('s1' || CAST(doc_id AS VARCHAR)), doc_id) AS j, n_chars FROM documents)
    SELECT a.doc_id, a.source, b.n_chars AS permuted FROM o a JOIN o b ON a.source = b.source AND a.i = b.j""")
def permute_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return windows.permute_in_group(rows, ["source"], "n_chars", "doc_id", "s1").select("doc_id", "source", "permuted")


@query("""
    WITH s AS (SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 THEN 1 ELSE 0 END AS INTEGER) AS season FROM orders),
    l AS (SELECT *, make_date(season, 9, 1) + CAST((8 - isodow(make_date(season, 9, 1))) % 7 AS INTEGER) AS labor FROM s)
    SELECT o_orderkey, season, CAST(greatest(0, floor(date_diff('day', labor, CAST(o_orderdate AS DATE)) / 7) + 1) AS INTEGER) AS week FROM l""")
def season_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", dates.season_of(F.col("o_orderdate")).alias("season"))
    return rows.select("o_orderkey", "season", dates.week_of(F.col("o_orderdate"), F.col("season")).alias("week"))


@query("""
    WITH k AS (SELECT event_id, ts, date_trunc('week', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS monday FROM events),
    c AS (SELECT *, ((monday + INTERVAL 30 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS tue, ((monday + INTERVAL 126 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS sat FROM k)
    SELECT event_id, tue AS tuesday, CASE WHEN tue < ts THEN tue ELSE greatest(CASE WHEN sat < ts THEN sat END, ts - INTERVAL 5 MINUTE) END AS as_of FROM c""")
def decision_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", dates.decision_instants(F.col("ts")).alias("c"))
    tuesday, candidates = F.get("c", F.lit(0)), F.concat("c", F.array(dates.slot_close(F.col("ts"))))
    return rows.select("event_id", tuesday.alias("tuesday"), dates.feature_as_of(F.col("ts"), tuesday, candidates).alias("as_of"))


@query("""
    SELECT o_orderkey, ((o_orderdate + INTERVAL 20 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS kickoff,
        round(date_diff('minute', o_orderdate, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') / 60, 6) AS offset_hours FROM orders""")
def tz_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.local_to_utc(d + F.expr("INTERVAL 20 HOURS")).alias("kickoff"), r6(dates.offset_hours(d, "America/Los_Angeles")).alias("offset_hours"))


@query("""
    WITH p AS (SELECT n_nationkey AS k, n_nationkey * 3.1 - 40 AS lat, n_nationkey * 7.3 - 90 AS lon FROM nation)
    SELECT a.k AS a, b.k AS b, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km
    FROM p a JOIN p b ON b.k = (a.k + 1) % 25""")
def haversine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    place = lambda s: n.select(F.col("n_nationkey").alias(s), (F.col("n_nationkey") * 3.1 - 40).alias(f"lat_{s}"), (F.col("n_nationkey") * 7.3 - 90).alias(f"lon_{s}"))
    a, b = place("a"), place("b")
    km = numbers.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, F.col("b") == (F.col("a") + 1) % 25).select("a", "b", F.round(km, 3).alias("km"))
