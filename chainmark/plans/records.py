"""Row filters, alignment and checks across tables on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, records
from .registry import query, r6, table


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') AS excluded FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def kickoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.kickoff_filter(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "excluded")


@query("SELECT o_orderkey FROM orders WHERE (year(o_orderdate), month(o_orderdate)) < (1996, 5)")
def prior_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    return records.prior_rows(o, ["season", "week"], [1996, 5]).select("o_orderkey")


@query("""
    WITH r AS (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN ' none ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'no line' END AS reason FROM lineitem) SELECT l_orderkey, count(*) AS n FROM r WHERE l_linenumber <> 1 AND l_returnflag <> 'R' AND (reason IS NULL OR lower(trim(reason)) IN ('', 'nan', 'none')) GROUP BY 1""")
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") == 1).alias("continuity"), (F.col("l_returnflag") == "R").alias("warm_up"), F.when(k == 0, "NaN").when(k == 1, " none ").when(k == 2, "").when(k == 4, "no line").alias("reason"))
    return records.scored(rows, "continuity", "warm_up", "reason").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY 1")
def lockbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked seasons are left out before the check, which would refuse them."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"))
    return records.lockbox(o.where("season <> 1998"), "season", [1998]).groupBy("season").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name, round(CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END, 6) AS fine, coalesce(CASE WHEN c_acctbal > 1000 THEN c_mktsegment END, 'unknown') AS segment, 'live' AS source FROM customer JOIN nation ON n_nationkey = c_nationkey")
def coercion_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").withColumn("padded", F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where(records.same_side(F.col("padded"), F.col("n_name")))
    rows = records.defaults(rows.withColumn("segment", F.when(F.col("c_acctbal") > 1000, F.col("c_mktsegment"))), {"segment": F.lit("unknown"), "source": F.lit("live")})
    return rows.select("c_custkey", "n_name", r6(records.in_range(F.col("c_acctbal"), 0, 5000)).alias("fine"), "segment", "source")


@query("SELECT o_orderkey, round(o_totalprice, 6) AS price FROM orders")
def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is null in most rows is dropped, another stays."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", r6("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 10 == 0, 1).alias("rare"))
    return records.drop_sparse(rows, ["price", "rare"], 0.5)


@query("SELECT p_partkey, list_sort([p_size * 1.0, p_retailprice % 50, 20.0])[1] AS low, CASE WHEN p_partkey % 7 > 0 THEN (25 BETWEEN list_sort([p_size * 1.0, p_retailprice % 50, 20.0])[1] AND list_sort([p_size * 1.0, p_retailprice % 50, 20.0])[3])::INT END AS hit FROM part")
def quantile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = records.sorted_quantiles(F.col("p_size").cast("double"), F.col("p_retailprice") % 50, F.lit(20.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"), F.when(F.col("p_partkey") % 7 > 0, 25.0).alias("y"))
    return rows.select("p_partkey", F.get("q", F.lit(0)).alias("low"), records.interval_hit(F.col("y"), F.get("q", F.lit(0)), F.get("q", F.lit(2))).alias("hit"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round(value, 6) END AS value, CASE WHEN event_id % 3 > 0 THEN round(value, 6) END AS nested FROM events")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("value"), F.array(F.struct(v.alias("x"))).alias("nested"))
    return records.no_nans(rows).select("event_id", r6("value").alias("value"), r6(F.get("nested", F.lit(0))["x"]).alias("nested"))


@query("SELECT c_custkey, o_orderkey, round(price, 6) AS price FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) JOIN (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) USING (c_custkey)")
def require_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with orders beside its last one, and the greatest key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("price"), "o_orderdate")
    games = o.groupBy("c_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    found = records.require_one(games, o.select("c_custkey", F.col("o_orderkey").alias("k"), "price", "o_orderdate"), ["c_custkey"], ["o_orderdate", "k"])
    return found.select("c_custkey", "o_orderkey", r6("price").alias("price"))


@query("""
    WITH a AS (SELECT l_partkey AS game, l_suppkey AS book, avg(l_extendedprice) AS x FROM lineitem WHERE l_quantity > 25 GROUP BY ALL), b AS (SELECT l_partkey AS game, l_suppkey AS book, avg(l_extendedprice) AS y FROM lineitem WHERE l_quantity <= 25 GROUP BY ALL),
    j AS (SELECT * FROM a FULL JOIN b USING (game, book)), s AS (SELECT game, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, avg(x - y) AS s, median(x) - median(y) AS m FROM j GROUP BY 1)
    SELECT game, CASE WHEN n > 0 THEN 'books' WHEN m IS NOT NULL THEN 'medians' ELSE 'one_sided' END AS basis, n, round(coalesce(s, m), 8) AS gap FROM s""")
def book_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("game"), F.col("l_suppkey").cast("string").alias("book"), "l_quantity", F.col("l_extendedprice").alias("v"))  # noqa: E741
    side = lambda cond: l.where(cond).groupBy("game", "book").agg(F.avg("v").alias("v"))
    found = records.reconcile(side("l_quantity > 25"), side("l_quantity <= 25"), "game", "book", "v")
    return found.select("game", "basis", "n", F.round("gap", 8).alias("gap"))


@query("""
    WITH c AS (SELECT l_partkey, median(l_quantity) AS line, count(DISTINCT l_suppkey) AS n_books FROM lineitem GROUP BY 1)
    SELECT l_partkey, any_value(line) AS line, any_value(n_books) AS n_books, arg_min(l_orderkey, (l_suppkey, l_orderkey)) FILTER (l_quantity = line) AS source_row FROM lineitem JOIN c USING (l_partkey) GROUP BY 1""")
def consensus_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.consensus(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity", "l_orderkey")


@query("""
    WITH w AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS nth, coalesce(o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), false) AS falls FROM orders) SELECT o_orderkey, CAST(nth AS INTEGER) AS nth, falls FROM w""")
def season_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    order = ["o_orderdate", "o_orderkey"]
    return o.select("o_orderkey", records.nth_of_season(["o_custkey"], "season", order).alias("nth"), records.falls("o_totalprice", ["o_custkey"], order).alias("falls"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS game, CASE WHEN o_orderkey % 5 > 0 THEN 'home:' || o_custkey END AS team FROM orders")
def parse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 5 == 0, "no key").otherwise(F.concat(F.col("o_orderkey"), F.lit(":home:"), F.col("o_custkey")))
    game, team = records.split_key(F.col("key"))
    return table(spark, sf_dir, "orders").withColumn("key", key).select("o_orderkey", game.alias("game"), team.alias("team"))


@query("""
    SELECT 'event_before_ingest' AS "check", count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_shipdate > TIMESTAMP '1998-06-01') AS failures FROM lineitem
    UNION ALL SELECT 'not_after_bound', count(*), count(*) FILTER (l_shipdate > TIMESTAMP '1999-01-01') FROM lineitem UNION ALL SELECT 'no_negative_score', count(*), count(*) FILTER (l_quantity - 5 < 0) FROM lineitem""")
def temporal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_shipdate").alias("event"), at("1998-06-01").alias("ingested"), (F.col("l_quantity") - 5).alias("score"))
    return records.temporal_checks(rows, "event", "ingested", F.col("l_returnflag") == "R", at("1999-01-01"), ["score"])


@query("""
    WITH p AS (SELECT l_orderkey AS k, round(sum(l_quantity), 2) AS parts FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, floor(o_totalprice / 1000) AS total FROM orders WHERE o_orderkey % 7 > 0)
    SELECT k, parts, total, coalesce(abs(parts - total) <= 8, false) AS agrees FROM p FULL JOIN o USING (k)""")
def cross_table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against the whole within eight points; rows of one side never agree."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    whole = table(spark, sf_dir, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("t"))
    return records.totals_agree(parts, whole, ["k"], "l_quantity", "t", 8).withColumn("parts", F.round("parts", 2))


@query("SELECT l_partkey, l_suppkey, round(max(l_quantity) FILTER (l_returnflag = 'R') - max(l_quantity) FILTER (l_returnflag = 'A'), 6) AS move FROM lineitem GROUP BY ALL HAVING abs(max(l_quantity) FILTER (l_returnflag = 'R') - max(l_quantity) FILTER (l_returnflag = 'A')) >= 20")
def line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "close").when(F.col("l_returnflag") == "A", "open")
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", kind)
    return records.moved_far(rows, ["l_partkey", "l_suppkey"], "kind", "l_quantity", 20).select("l_partkey", "l_suppkey", r6("move").alias("move"))


@query("SELECT * FROM (VALUES ('l_tax', 'live'), ('flat', 'constant'), ('empty', 'all_null'), ('absent', 'missing')) AS x(feature, status)")
def inert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"flat": F.lit(1), "empty": F.lit(None).cast("double")})
    return records.inert(rows, ["l_tax", "flat", "empty", "absent"])


_PAIRS = "o AS (SELECT o_orderkey AS id, o_custkey % 6 AS a, o_orderkey // 2 % 6 AS b, o_orderdate AS ts FROM orders)"


@query(f"""
    WITH {_PAIRS}, l AS (SELECT * FROM o WHERE id % 2 = 0 AND id % 10 > 0), r AS (SELECT id AS rid, a, b, ts FROM o WHERE id % 2 = 1),
    p AS (SELECT l.id, count(rid) AS n, min(rid) AS rid FROM l LEFT JOIN r ON l.a = r.a AND l.b = r.b AND abs(date_diff('second', l.ts, r.ts)) <= 36 * 3600 GROUP BY 1), s AS (SELECT l.id, count(rid) AS n, min(rid) AS rid FROM l LEFT JOIN r ON l.a = r.b AND l.b = r.a AND abs(date_diff('second', l.ts, r.ts)) <= 36 * 3600 GROUP BY 1),
    m AS (SELECT id, CASE WHEN p.n > 0 THEN p.n ELSE s.n END AS n, CASE WHEN p.n > 0 THEN p.rid ELSE s.rid END AS rid FROM p JOIN s USING (id) UNION ALL SELECT id, 1, 7 FROM o WHERE id % 10 = 0)
    SELECT id, CASE WHEN n = 1 THEN rid END AS rid, n, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'quarantined' ELSE 'unmatched' END AS status FROM m""")
def pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs matched within 36 hours in either order; earlier matches are reused."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 6).alias("a"), (F.floor(F.col("o_orderkey") / 2) % 6).alias("b"), F.col("o_orderdate").alias("ts"))
    known = o.where("id % 10 = 0").select("id", F.lit(7).cast("long").alias("rid"))
    right = o.where("id % 2 = 1").withColumnRenamed("id", "rid")
    return asof.match_either(o.where("id % 2 = 0"), right, [], ("a", "b"), "ts", "ts", "id", "rid", 36, known)


@query("""
    WITH x AS (SELECT p_partkey, 1990 + p_size % 40 AS season, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS snap, p_size % 24 AS age, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice - 1 END AS cl FROM part), y AS (SELECT *, CASE WHEN season >= 2021 AND snap IS NOT NULL THEN 'snapshot' WHEN cl IS NOT NULL THEN 'close' END AS source FROM x)
    SELECT p_partkey, round(CASE source WHEN 'snapshot' THEN snap WHEN 'close' THEN cl END, 6) AS line, source, CASE WHEN source = 'snapshot' THEN CASE WHEN age <= 12 THEN 'within_tolerance' ELSE 'stale_snapshot' END WHEN source = 'close' THEN CASE WHEN season >= 2021 THEN 'fallback' ELSE 'before_cutover' END END AS label FROM y""")
def line_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line, source, label = asof.line_ladder(1990 + F.col("p_size") % 40, 2021, F.when(k % 3 > 0, F.col("p_retailprice")), F.col("p_size") % 24, F.when(k % 5 > 0, F.col("p_retailprice") - 1))
    return table(spark, sf_dir, "part").select("p_partkey", r6(line).alias("line"), source.alias("source"), label.alias("label"))
