"""Point-in-time joins: nothing at or after the bound is visible.

A column bound is answered by one union and one window per key: at equal times
left rows sort before right rows, so a right row exactly at the bound loses.
The key is hash-partitioned once; no pair of rows is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str, inclusive: bool = False, suffix: str = "_right") -> DataFrame:
    """Each left row with the latest right row of its keys strictly before ``left_ts``.

    Unmatched left rows stay. Right columns that collide get ``suffix``. Among
    right rows of one time the greatest ``tie`` wins; it should be unique.
    ``inclusive`` admits right rows exactly at the bound.
    """
    taken = set(left.columns)
    names = {c: c + suffix if c in taken else c for c in right.columns if c not in keys}
    lrow, rrow = F.struct(*left.columns), F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    rank = 1 if inclusive else 0
    l = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(rank).alias("__side"), lrow.alias("__l"), F.lit(None).cast(right.select(rrow.alias("r")).schema["r"].dataType).alias("__r"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"))  # noqa: E741
    r = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(1 - rank).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), rrow.alias("__r"), F.col(tie).alias("__tie"))
    seen = Window.partitionBy(*keys).orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = l.unionByName(r).withColumn("__r", F.last("__r", ignorenulls=True).over(seen)).where(F.col("__l").isNotNull())
    return joined.select("__l.*", *[F.col(f"__r.{n}").alias(n) for n in names.values()])


def latest_before(rows: DataFrame, keys: list[str], ts: str, bound: Column, tie: str) -> DataFrame:
    """The newest row of each key strictly before one bound."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(ts, tie))
    return rows.where(F.col(ts) < bound).groupBy(*keys).agg(newest.alias("r")).select("r.*")


def latest_set(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows at the newest time of each key, by one window over the key."""
    newest = F.max(ts).over(Window.partitionBy(*keys))
    return rows.withColumn("__newest", newest).where(F.col(ts) == F.col("__newest")).drop("__newest")


def asof_latest_set(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str) -> DataFrame:
    """Each left row's instant joined to every right row at the latest time before it.

    Adds ``right_ts`` as ``__set_ts``; join ``right`` on (keys, __set_ts) to
    aggregate the set.
    """
    times = right.select(*keys, F.col(right_ts).alias("__set_ts")).distinct().withColumn("__t", F.col("__set_ts"))
    return asof_join(left, times, keys, left_ts, "__t", "__set_ts").drop("__t")


def ladder(*rungs: tuple[str, Column]) -> tuple[Column, Column]:
    """First rung with a value, and its name."""
    label = F.lit(None).cast("string")
    for name, value in reversed(rungs):
        label = F.when(value.isNotNull(), F.lit(name)).otherwise(label)
    return F.coalesce(*[v for _, v in rungs]), label


def interval_match(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, left_id: str, right_id: str, hours: float) -> DataFrame:
    """(left id, right id, n, status): right rows of equal keys within ``hours`` either way.

    Exactly one hit is matched, several are quarantined, none is unmatched.
    Times are cut into buckets as wide as the interval; a right row stands in its
    own and the neighbouring ones. Within (keys, bucket) hits are the difference
    of two running counts, so no pair of rows is formed.
    """
    width = int(hours * 3600 * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / width)
    none = F.lit(None)
    l = left.select(*keys, F.col(left_id).alias("__l"), none.alias("__rid"), micros(left_ts).alias("__t"), bucket(left_ts).alias("__b"), F.lit(0).alias("__one"))  # noqa: E741
    around = F.explode(F.array(bucket(right_ts) - 1, bucket(right_ts), bucket(right_ts) + 1))
    r = right.select(*keys, none.cast(left.schema[left_id].dataType).alias("__l"), F.col(right_id).alias("__rid"), micros(right_ts).alias("__t"), around.alias("__b"), F.lit(1).alias("__one"))
    cell = Window.partitionBy(*keys, "__b").orderBy("__t")
    upto = cell.rangeBetween(Window.unboundedPreceding, width)
    below = cell.rangeBetween(Window.unboundedPreceding, -width - 1)
    both = l.unionByName(r).withColumns({"__n": F.sum("__one").over(upto) - F.coalesce(F.sum("__one").over(below), F.lit(0)), "__last": F.last("__rid", ignorenulls=True).over(upto)})
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    counted = both.where((F.col("__one") == 0) & F.col("__l").isNotNull() & keyed).select("__l", F.col("__n").alias("n"), F.col("__last").alias("__rid"))
    # a left id that occurs twice counts the hits of all its rows
    counted = counted.groupBy("__l").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("__rid"))).alias("__rid"))
    out = left.select(F.col(left_id).alias("__l")).join(counted, "__l", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    status = F.when(n == 1, "matched").when(n > 1, "quarantined").otherwise("unmatched")
    return out.select(F.col("__l").alias(left_id), F.when(n == 1, F.col("__rid")).alias(right_id if right_id != left_id else right_id + "_right"), n.alias("n"), status.alias("status"))


def match_either(left: DataFrame, right: DataFrame, keys: list[str], pair: tuple[str, str], left_ts: str, right_ts: str, left_id: str, right_id: str, hours: float, known: DataFrame | None = None) -> DataFrame:
    """(left id, right id, n, status): as ``interval_match`` by keys and pair; rows unmatched so are tried with the pair swapped.

    ``known`` holds (left id, right id) of earlier matches, which are taken over and not searched again.
    """
    a, b = pair
    found = left.sparkSession.createDataFrame([], left.select(left_id).schema) if known is None else known.select(left_id)
    fresh = left.join(found, left_id, "left_anti")
    first = interval_match(fresh, right, [*keys, a, b], left_ts, right_ts, left_id, right_id, hours)
    again = fresh.join(first.where("status = 'unmatched'").select(left_id), left_id, "left_semi")
    turned = right.withColumnsRenamed({a: "__x", b: "__y"}).withColumnsRenamed({"__x": b, "__y": a})
    second = interval_match(again, turned, [*keys, a, b], left_ts, right_ts, left_id, right_id, hours)
    out = first.where("status <> 'unmatched'").unionByName(second)
    if known is None:
        return out
    return out.unionByName(known.select(left_id, right_id, F.lit(1).cast("long").alias("n"), F.lit("matched").alias("status")))


def line_ladder(season: Column, cutover: int, snapshot: Column, snapshot_age_hours: Column, close: Column, tolerance: float = 12.0) -> tuple[Column, Column, Column]:
    """(line, source, label): snapshots from the cutover on, closing lines before it or where there is no snapshot; the label tells old snapshots."""
    later = season >= cutover
    line, source = ladder(("snapshot", F.when(later, snapshot)), ("close", close))
    label = F.when(source == "snapshot", F.when(snapshot_age_hours <= tolerance, "within_tolerance").otherwise("stale_snapshot")).when(source == "close", F.when(later, "fallback").otherwise("before_cutover"))
    return line, source, label
