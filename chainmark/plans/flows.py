"""Captures, partitioned stores and streams on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.ratings import TOGETHER
from ..sources import payloads
from ..sources.store import Store, TableSpec, delete_on_exit, scratch
from ..streaming import captures
from ..streaming import ratings as streaming
from .analytics import _games
from .registry import SQL, query, r6, table

ORDERS = TableSpec("orders_by_year", "o_orderkey long, o_custkey long, price double, version int, season int", ("season",), ("season", "o_orderkey"))


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS book, l_linestatus AS market, CAST(l_linenumber AS VARCHAR) AS side, l_quantity AS line, l_extendedprice AS price,
        n AS n_books FROM lineitem JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items packed as nested JSON events, then parsed back."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    outcome = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("point"))
    markets = l.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list(outcome).alias("outcomes"))
    books = markets.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("key"), "outcomes")).alias("markets"))
    events = books.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("key"), "markets")).alias("bookmakers"))
    packed = events.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), "bookmakers")).alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"))
    return payloads.quotes(packed).select("id", "book", "market", "side", "line", "price", "n_books")


@query("""
    SELECT l_orderkey, l_linenumber, 'open' AS line_type, l_tax AS spread, l_quantity AS total FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'close', l_discount, CASE WHEN l_quantity > 25 THEN l_quantity END FROM lineitem""")
def open_close_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("late", F.when(F.col("l_quantity") > 25, F.col("l_quantity")))  # noqa: E741
    return payloads.open_and_close(l, ["l_orderkey", "l_linenumber"], {"spread": ("l_tax", "l_discount"), "total": ("l_quantity", "late")})


@query("""
    SELECT user_id, round(avg(value) FILTER (hour(ts) = 12), 6) AS at_noon FROM events GROUP BY user_id""")
def hourly_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    packed = hours.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.format_string("%02d:00", "h").alias("t"), "v"))).alias("x"))
    return packed.select("user_id", r6(payloads.at_hour(F.col("x.t"), F.col("x.v"), F.lit("12:00"))).alias("at_noon"))


def _store(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", [ORDERS])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("version"), F.year("o_orderdate").alias("season"))
    return store, o


@query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) >= 1996 THEN -1.0 ELSE o_totalprice END AS price,
        CASE WHEN o_orderkey % 3 = 0 AND year(o_orderdate) >= 1996 THEN 2 ELSE 1 END AS version, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year; later versions replace some rows of some years."""
    store, o = _store(spark, sf_dir)
    store.overwrite(o, ORDERS.name)
    newer = o.where("o_orderkey % 3 = 0 and season >= 1996").withColumns({"price": F.lit(-1.0), "version": F.lit(2)})
    store.upsert(newer.unionByName(newer.withColumn("version", F.lit(0))), ORDERS.name, F.col("version"))
    return store.read(ORDERS.name)


@query("""
    WITH v AS (SELECT o_custkey, o_orderkey, 1 AS version FROM orders UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_orderkey % 4 = 0)
    SELECT o_custkey, count(*) AS n, CAST(max(version) AS INTEGER) AS newest, true AS same FROM v GROUP BY 1""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions appended to a key; the second append of the same rows changes nothing."""
    store, o = _store(spark, sf_dir)
    store.overwrite(o, ORDERS.name)
    newer = o.where("o_orderkey % 4 = 0").withColumn("version", F.lit(2))
    store.append(newer, ORDERS.name)
    store.append(newer, ORDERS.name)
    same = store.same(o.unionByName(newer), ORDERS.name) and not store.same(o, ORDERS.name)
    return store.read(ORDERS.name).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("version").alias("newest")).withColumn("same", F.lit(same))


@query("""
    SELECT 'kept' AS place, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 300000
    UNION ALL SELECT 'quarantine', count(*) FROM orders WHERE NOT o_totalprice BETWEEN 0 AND 300000""")
def store_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, o = _store(spark, sf_dir)
    store.append_checked(o, ORDERS.name, [quality.between("price", 0, 300_000)], F.col("version"), "orders")
    place = lambda df, name: df.select(F.lit(name).alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    return place(store.read(ORDERS.name), "kept").unionByName(place(store.quarantined(ORDERS.name), "quarantine"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND o_custkey = 7")
def store_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, o = _store(spark, sf_dir)
    store.overwrite(o, ORDERS.name)
    return store.read(ORDERS.name, season=[1996, 1997], o_custkey=7).select("o_orderkey", "price")


@query("SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events")
def stream_minute_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures.stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = captures.drain(captures.minute_dedupe(rows.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days"))
    return found.select("user_id", "event_type", F.col("minute").cast("timestamp_ntz").alias("minute"))


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS captures, count(*) < 80 AS late FROM events GROUP BY 1""")
def stream_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures.stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    found = captures.drain(captures.cadence(rows, "ts", "6 hours", 80), "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH RECURSIVE x AS (SELECT user_id, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT user_id, 0 AS i, CAST(0.1 AS DOUBLE) AS a FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, least(1.0, greatest(0.0, s.a + CAST(0.05 AS DOUBLE) * (0.1 - x.miss))) FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
    SELECT user_id, n, round(a, 6) AS alpha FROM s JOIN x USING (user_id, i) WHERE i = n""")
def stream_adaptive_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures.stream(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id").cast("string"))
    found = captures.drain(captures.adaptive_alpha(rows, "user_id", "order", F.col("value") > 20), "update", ["user_id"])
    return found.select("user_id", "n", r6("alpha").alias("alpha"))


LATEST = TableSpec("latest_events", "user_id long, event_id long, ts timestamp_ntz, part int", ("part",), ("user_id",))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_into_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late batches merged into a table: the stream's files come once more behind newer rows, and change nothing."""
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", [LATEST])
    rows = captures.stream(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("user_id") % 4).cast("int").alias("part"))
    for late in (rows.where("hour(ts) >= 12"), rows):
        captures.into_store(late, store, LATEST.name, F.struct("ts", "event_id"))
    return store.read(LATEST.name).select("user_id", "ts", "event_id")


#: Batches that results come in, and rows of a file, about.
BATCHES, ARRIVING = 4, 250_000


@query(SQL["elo_fold"])
def stream_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that arrive in hashed order, in four batches: the ratings are those of the ordered fold."""
    at = f"{scratch(spark)}/results-{uuid.uuid4().hex}"
    games = _games(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("league", "game", "ts", "season", "home", "away", "margin", "neutral")
    n, leagues = games.agg(F.count("*"), F.approx_count_distinct("league")).first()
    files = max(1, -(-n // (BATCHES * ARRIVING)))  # of a batch: a batch rates all games so far, so more rows make larger batches, not more
    games.repartition(BATCHES * files, F.xxhash64(F.lit("arrival"), "game")).write.parquet(at)
    delete_on_exit(spark, at)
    stream = spark.readStream.schema(games.schema).option("maxFilesPerTrigger", files).parquet(at)
    groups = max(1, -(-leagues // TOGETHER), min(4 * spark.sparkContext.defaultParallelism, leagues // 8))
    found = captures.drain(streaming.elo_stream(stream, "36500 days", groups=groups), "update", ["league", "game"])
    return found.select("game", *[r6(c).alias(c) for c in ("home_before", "away_before", "p_home", "home_after", "away_after")])
