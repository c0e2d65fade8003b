"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents are linked if they share a value of a ``by`` column (by default the
text). A shared value is a hub: its members' shards vote for its label, and
members move to it, so that no pair of documents is ever formed.

1. Every document begins in the shard that its row's hash names.
2. Rounds. Each hub takes the shard with most of its members among those with
   room for the others; members want the label of the hub with most votes (of
   several). A shard admits what its quota allows: the even share less the bytes
   of linked documents that stay. Larger hubs are admitted first, whole; the
   rest chooses again. A hub larger than a shard's share is split beforehand, by
   the hash of the row, into as few parts as shards can hold.
3. Documents without links fill the room that is left, by hash.
4. Balance. Shards above the even share send documents to those below: unlinked
   ones first, then whole hubs, each time in bins no larger than a quarter of
   the excess (where there are none, half of it, then all of it), until the
   excess is gone.

Quotas are cumulative sums over at most shards x 64 x BINS bins, never over
documents; the driver sees one row a shard. Everything is joins, map-side
combined sums and broadcasts of such bounded tables. Slots number a shard's
documents by input partition and, inside one, by row.

Defined cases: a null text has size 1 and no links, its CRC is that of no
bytes; empty texts are equal texts; repeated rows are rows of their own, linked
by their text; a null id is kept; documents larger than the even share leave
their shard above it; ties of votes go by the hash of hub and shard; texts of
any length are only measured and hashed; other columns stay in ``doc``,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import Workspace

SHARDS, ROUNDS, BALANCES, BINS = 16, 6, 10, 256
#: Share of a shard that a part of a split hub takes.
FULL = 0.9
#: Excess of the fullest shard over the even share at which balancing ends.
EVEN = 0.001
#: Bits of a row's number below its partition's.
_ROW = 33


def _bits(size: Column) -> Column:
    return F.length(F.bin(size))


def _sums(rows: DataFrame, shards: int, column: str = "shard") -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(column).agg(F.sum("size")).collect()}  # one row a shard
    return [found.get(i, 0) or 0 for i in range(shards)]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def linked(rows: DataFrame, by: list[str], share: float, work: Workspace) -> DataFrame:
    """(row, size, hub, bytes): members of hubs of at least two rows, large hubs in parts."""
    each = None
    for i, c in enumerate(by):
        some = rows.where(F.col(c).isNotNull()).select("row", "size", F.xxhash64(F.lit(i), c).alias("hub"))
        each = some if each is None else each.unionByName(some)
    hubs = each.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    hubs = work.keep(hubs.select("hub", "bytes", F.greatest(F.lit(1), F.ceil(F.col("bytes") / (FULL * share))).alias("parts")), "hubs")
    part = F.when(F.col("parts") > 1, F.xxhash64("hub", F.pmod(F.xxhash64("row"), F.col("parts")))).otherwise(F.col("hub"))
    return each.join(hubs, "hub").select("row", "size", part.alias("hub"), F.ceil(F.col("bytes") / F.col("parts")).cast("long").alias("bytes"))


def propagate(members: DataFrame, shards: int, share: float, several: bool, work: Workspace) -> DataFrame:
    """(row, hub, bytes, shard) of linked rows after the rounds; ``several``: rows may have more than one hub."""
    spark = members.sparkSession
    state = work.keep(members.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "state")
    room = [share] * shards
    for r in range(ROUNDS):
        rooms = _small(spark, list(enumerate(map(float, room))), "shard int, room double")
        votes = state.groupBy("hub", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("here"), F.first("bytes").alias("bytes"))
        best = F.max(F.struct("n", F.xxhash64("hub", "shard"), "shard"))
        labels = work.keep(votes.join(rooms, "shard").where("bytes - here <= room").groupBy("hub").agg(best.alias("x")).select("hub", F.col("x.n").alias("votes"), F.col("x.shard").alias("label")), f"labels{r}")
        # a hub that fits beside none of its members goes where it fits
        fits = F.filter(F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(x)).alias("room")) for i, x in enumerate(room)]), lambda x: x["room"] >= F.col("bytes"))
        other = F.get(fits, F.pmod(F.xxhash64("hub"), F.greatest(F.lit(1), F.size(fits))).cast("int"))["shard"]
        want = F.coalesce("label", other, "shard")
        wanted = state.join(labels, "hub", "left").select("row", "size", "hub", "bytes", "shard", want.alias("want"), F.coalesce("votes", F.lit(0)).alias("votes"))
        if several:
            one = wanted.groupBy("row").agg(F.max(F.struct("votes", F.xxhash64("hub"), "want", "hub", "bytes")).alias("x"), F.first("size").alias("size"), F.first("shard").alias("shard"))
            leads = work.keep(one.select("row", "size", "x.hub", "x.bytes", "shard", "x.want"), f"wanted{r}")
        else:
            leads = work.keep(wanted.drop("votes"), f"wanted{r}")
        stay = _sums(leads.where("shard = want"), shards)
        quota = [share - s for s in stay]
        bin_ = [(64 - _bits(F.col("bytes"))).alias("bits"), F.pmod(F.xxhash64(F.lit(r), "hub"), F.lit(BINS)).alias("bin")]
        bins = leads.where("shard <> want").groupBy("want", *bin_).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("want").orderBy("bits", "bin"))
        quotas = _small(spark, list(enumerate(map(float, quota))), "want int, quota double")
        let = work.keep(bins.withColumn("run", run).join(quotas, "want").where("run <= quota").select("want", "bits", "bin", "size", F.lit(True).alias("goes")), f"let{r}")
        came = _sums(let, shards, "want")
        if not sum(came):
            break
        moved = leads.select("*", *bin_).join(F.broadcast(let.drop("size")), ["want", "bits", "bin"], "left").select("row", F.when(F.col("goes"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "size", "hub", "bytes")
        if several:
            moved = members.join(moved.select("row", "shard"), "row")
        state = work.keep(moved, f"state{r}")
        room = [max(0.0, q - c) for q, c in zip(quota, came, strict=True)]
    if several:
        one = state.groupBy("row").agg(F.max(F.struct("bytes", "hub", "shard")).alias("x"))
        return one.select("row", "x.hub", "x.bytes", "x.shard")
    return state.select("row", "hub", "bytes", "shard")


def _flows(loads: list[int], share: float) -> list[tuple[int, float, float, int]]:
    """(from, lo, hi, to): which stretch of a full shard's excess goes to which shard below the share."""
    give = [(i, x - share) for i, x in enumerate(loads) if x > share]
    take = sorted(((share - x, j) for j, x in enumerate(loads) if x < share), reverse=True)
    out, k, left = [], 0, take[0][0] if take else 0.0
    for i, excess in give:
        at = 0.0
        while at < excess and k < len(take):
            size = min(excess - at, left)
            out.append((i, at, at + size, take[k][1]))
            at, left = at + size, left - size
            if left <= 0:
                k += 1
                left = take[k][0] if k < len(take) else 0.0
    return out


def balance(base: DataFrame, shards: int, share: float, work: Workspace) -> DataFrame:
    """``base`` (row, key, linked, bits, size, shard, ...) with shards of even bytes.

    Moves are tables of bins; the rows stay where they are written, and a round
    reads them through the moves so far.
    """
    spark, now, parts = base.sparkSession, base, 4
    for r in range(BALANCES):
        loads = _sums(now, shards)
        if max(loads) - share <= EVEN * share:
            break
        bin_ = F.pmod(F.xxhash64(F.lit(r), "key"), F.lit(BINS)).alias("bin")
        excess = _small(spark, [(i, float(x - share)) for i, x in enumerate(loads) if x > share], "shard int, excess double")
        bins = now.join(excess, "shard").groupBy("shard", "excess", "linked", "bits", bin_).agg(F.sum("size").alias("size")).where(parts * F.col("size") <= F.col("excess"))
        run = F.sum("size").over(Window.partitionBy("shard").orderBy("linked", F.col("bits").desc(), "bin"))
        going = bins.withColumn("run", run).where("run <= excess").withColumn("mid", F.col("run") - F.col("size") / 2).withColumnRenamed("shard", "from")
        flows = _small(spark, _flows(loads, share), "shard int, lo double, hi double, to int")
        moves = going.join(flows, (F.col("shard") == F.col("from")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi"))).select("shard", "linked", "bits", "bin", "to")
        moves = work.keep(moves, f"moves{r}")
        if not moves.head(1):
            parts //= 2
            if not parts:
                break
            continue
        now = now.select("*", bin_).join(F.broadcast(moves), ["shard", "linked", "bits", "bin"], "left").withColumn("shard", F.coalesce("to", "shard")).select(*base.columns)
    return now


def slots(placed: DataFrame, work: Workspace) -> DataFrame:
    """``placed`` with slot: rows of a shard in the order of their numbers, gapless from 0."""
    part = F.shiftright("row", _ROW).alias("part")
    counts = work.keep(placed.groupBy(part, "shard").agg(F.count("*").alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = work.keep(counts.select("part", "shard", before.alias("before")), "offsets")
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    return placed.withColumn("part", part).withColumn("inside", inside).join(offsets, ["part", "shard"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("long")).drop("part", "before", "inside")


def shard(docs: DataFrame, text: str = "text", keep: list[str] | None = None, by: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """Columns ``keep`` (all by default, in the struct ``doc``) with size, text_crc32, law, shard, slot and grown_shard."""
    work = Workspace(docs.sparkSession, "sharding")
    links = by or [text]
    body = F.coalesce(F.col(text), F.lit(""))
    values = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"by{i}") for i, c in enumerate(links)]
    rows = work.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(keep or docs.columns)).alias("doc"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *values), "rows")
    share = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    found = propagate(linked(rows, [f"by{i}" for i in range(len(links))], share, work), shards, share, len(links) > 1, work)
    found = work.keep(found, "linked")
    sizes = found.join(rows.select("row", "size"), "row").select("shard", "size") if share else found.select("shard", F.lit(0).alias("size"))
    room = [max(0.0, share - x) for x in _sums(sizes, shards)]
    ends, total = [], sum(room) or 1.0
    for x in room[:-1]:
        ends.append((ends[-1] if ends else 0.0) + x / total)
    drawn = F.pmod(F.xxhash64(F.lit("fill"), "row"), F.lit(1 << 40)) / float(1 << 40)
    filled = F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda e: e <= drawn)).cast("int")
    base = rows.select("row", "size", "text_crc32", "doc").join(found, "row", "left")
    base = base.select("row", "size", "text_crc32", "doc", F.coalesce("shard", filled).alias("shard"), F.coalesce("hub", "row").alias("key"), F.col("hub").isNotNull().alias("linked"), _bits(F.coalesce("bytes", "size")).alias("bits"))
    even = balance(work.keep(base, "base"), shards, share, work)
    out = slots(even.select("row", "doc", "size", "text_crc32", "shard"), work)
    return out.select("doc", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
