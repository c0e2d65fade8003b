"""Joins and relational idioms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import asof, windows
from .registry import query, r6, table


@query("""
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS prior_id, p.ts AS prior_ts, p.value AS prior_value
    FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') p ON e.user_id = p.user_id AND e.ts > p.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("prior_id"), F.col("ts").alias("prior_ts"), F.col("value").alias("prior_value"))
    return asof.asof_join(left, right, ["user_id"], "ts", "prior_ts", "prior_id")


@query("""
    SELECT o_custkey, o_orderkey, o_orderdate, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def asof_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    found = asof.latest_before(o, ["o_custkey"], "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), "o_orderkey")
    return found.withColumn("o_totalprice", r6("o_totalprice"))


@query("""
    SELECT e.event_id, p.event_id AS prior_id FROM (SELECT *, ts - INTERVAL 6 HOUR AS bound FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.bound >= p.ts""")
def asof_double_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At or before the decision six hours ahead, and so strictly before the event."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("bound"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("prior_id"), F.col("ts").alias("prior_ts"))
    return asof.asof_join(left, right, ["user_id"], "bound", "prior_ts", "prior_id", inclusive=True).select("event_id", "prior_id")


@query("""
    SELECT l_partkey, max(l_shipdate) AS at, round(median(l_extendedprice), 6) AS consensus, count(DISTINCT l_suppkey) AS n_books
    FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_partkey) AS newest FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01') WHERE l_shipdate = newest GROUP BY l_partkey""")
def latest_set_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    newest = asof.latest_set(rows.select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), ["l_partkey"], "l_shipdate")
    return newest.groupBy("l_partkey").agg(F.max("l_shipdate").alias("at"), r6(F.median("l_extendedprice")).alias("consensus"), F.countDistinct("l_suppkey").alias("n_books"))


@query("""
    SELECT user_id, CAST(ts AS DATE) AS day,
        round(coalesce(max(value) FILTER (event_type = 'view'), max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'signup')), 6) AS value,
        CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'view' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'click' WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'signup' END AS source
    FROM events GROUP BY ALL""")
def ladder_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("view", "click", "signup")
    best = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    value, label = asof.ladder(*[(k, F.col(k)) for k in kinds])
    return best.select("user_id", "day", r6(value).alias("value"), label.alias("source"))


@query("""
    WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT * FROM events WHERE event_type = 'view'),
    h AS (SELECT c.event_id, count(v.event_id) AS n, min(v.event_id) AS m FROM c LEFT JOIN v ON c.user_id = v.user_id AND abs(epoch_us(c.ts) - epoch_us(v.ts)) <= 36 * 3600000000 GROUP BY 1)
    SELECT event_id, CASE WHEN n = 1 THEN m END AS match_id, n, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'quarantined' ELSE 'unmatched' END AS status FROM h""")
def range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("match_id"))
    return asof.interval_match(e.where("event_type = 'click'"), views, ["user_id"], "ts", "ts", "event_id", "match_id", 36)


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_semi")


@query("""
    SELECT d.source, count(*) AS required, count(l.doc_id) AS observed, round(count(l.doc_id) / count(*), 6) AS share
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("required"), F.count("seen").alias("observed"), r6(F.count("seen") / F.count("*")).alias("share"))


@query("""
    SELECT c.c_nationkey AS home, s.s_nationkey AS away, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def role_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
    SELECT l_partkey, round(arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)), 6) AS open, round(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)), 6) AS close,
        abs(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) - arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber))) >= 20000 AS moved
    FROM lineitem GROUP BY l_partkey""")
def open_close_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open against close of one key by a single aggregate instead of a self join."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    both = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_extendedprice", order).alias("open"), F.max_by("l_extendedprice", order).alias("close"))
    return both.select("l_partkey", r6("open").alias("open"), r6("close").alias("close"), (F.abs(F.col("close") - F.col("open")) >= 20000).alias("moved"))


@query("""
    WITH d AS (SELECT event_type, round(avg(value), 6) AS v FROM events GROUP BY 1), a AS (SELECT user_id, event_type, avg(value) FILTER (value > 30) AS v FROM events GROUP BY ALL)
    SELECT a.user_id, a.event_type, round(coalesce(a.v, d.v), 6) AS value, CASE WHEN a.v IS NULL THEN 'default' ELSE 'own' END AS source FROM a LEFT JOIN d USING (event_type)""")
def fill_null_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    default = e.groupBy("event_type").agg(r6(F.avg("value")).alias("d"))
    own = e.groupBy("user_id", "event_type").agg(F.avg(F.when(F.col("value") > 30, F.col("value"))).alias("v"))
    return own.join(default, "event_type", "left").select("user_id", "event_type", r6(F.coalesce("v", "d")).alias("value"), F.when(F.col("v").isNull(), "default").otherwise("own").alias("source"))


@query("""
    SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL""")
def scan_pruned_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= at("1999-01-01")) & (F.col("l_shipdate") < at("2000-01-01")))
    return rows.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
    SELECT event_id, user_id, event_type, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1""")
def minute_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key and clock slot."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("slot", F.date_trunc("hour", "ts"))
    return windows.pick_first(rows, ["user_id", "event_type", "slot"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("slot")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) > 1")
def dup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("slot", F.date_trunc("hour", "ts"))
    return windows.duplicates(rows, ["user_id", "event_type", "slot"]).select("event_id", "user_id", "event_type")


@query("""
    SELECT user_id, mode, n FROM (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS mode, count(*) AS n FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, mode) = 1""")
def mode_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"))
    return windows.mode_smallest(rows, ["user_id"], "week")


@query("""
    SELECT nation, side FROM (SELECT DISTINCT c_nationkey AS nation, 'customer' AS side FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier)
    UNION ALL SELECT nation, 'both' FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT nation, 'only' FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""")
def union_diff_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a, b = c.select(F.col("c_nationkey").alias("nation")), s.select(F.col("s_nationkey").alias("nation"))
    only = c.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation")).join(s.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation")), "nation", "left_anti").distinct()
    parts = [(a.distinct(), "customer"), (b.distinct(), "supplier"), (a.intersect(b), "both"), (only, "only")]
    out = None
    for df, side in parts:
        tagged = df.withColumn("side", F.lit(side))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("""
    SELECT n_nationkey, lower(trim(regexp_replace(n_name, '[ \\t\\n\\r]+', ' ', 'g'))) AS name, CAST(n_regionkey AS VARCHAR) || ':' || CAST(n_nationkey AS VARCHAR) AS key,
        substring(sha256(CAST(n_regionkey AS VARCHAR) || '|' || n_name), 1, 32) AS id FROM nation""")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", text.normal_name(F.col("n_name")).alias("name"), text.composite_key(F.col("n_regionkey"), F.col("n_nationkey")).alias("key"), text.row_id(F.col("n_regionkey"), F.col("n_name")).alias("id"))


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS alias FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k INT, missing STRING")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing", F.col("p.k").cast("string")).alias("alias"))


@query(r"""
    SELECT doc_id, len(regexp_extract_all(text, '(?:token|api_key|secret|password) ?[=:] ?"[0-9A-Za-z_\-]{16,}"')) AS n_secrets, regexp_matches(text, '(?i)all rights reserved') AS reserved FROM documents""")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r'(?:token|api_key|secret|password) ?[=:] ?"[0-9A-Za-z_\-]{16,}"'), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_secrets"), F.col("text").rlike("(?i)all rights reserved").alias("reserved"))


@query("SELECT p_type, p_partkey, round(p_retailprice, 6) AS p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("p_type", "p_partkey", r6("p_retailprice").alias("p_retailprice"), "place")
