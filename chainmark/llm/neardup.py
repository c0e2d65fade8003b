"""Near-duplicate documents by SuperMinHash signatures.

A document's set is its distinct five-word shingles. Equal sets are one class
first. A class gets a SuperMinHash signature: every element draws, level by
level, a value above the level and a slot from its own random permutation, and
the levels stop as soon as no slot can fall any more. Slots form bands; classes
that share a band are candidates.

Candidates are never expanded into pairs. In a band's bucket every member is
compared with the bucket's smallest and largest member, on full sets, and
union-find (star contractions) joins what is linked. Buckets whose members then
still lie in several parts are searched to the end by counting shingles among
their members: shingles of at most RARE members are joined (of the smaller of
two sets only as many as must meet one that both have), which costs at most
RARE rows a shingle. Links without a shared rare shingle need two sets that
consist mostly of frequent ones, one of them almost wholly; only such sets are
compared in cells of bounded blocks. So texts that share a large passage but
differ otherwise cost no more than their shingles, and no link inside a bucket
is missed. Pairs of similarity 0.75 share no band once in about 190,000 cases.

Defined cases: null or wordless texts have the empty set, are linked with
nothing and kept; texts of fewer words than a shingle are one shingle; rows
with a null id are linked with nothing, have no component and are kept; rows
that share an id are one node. An empty table gives no rows. Texts are read a few
megabytes at a time, a longer one by itself; columns other than the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import grams, inside_rows, mix, texts
from .work import Workspace

SHINGLE, SLOTS, BAND = 5, 128, 4
PERCENT = 75
BLOCK = 128
#: A shingle of more members than this is frequent.
RARE = 64
#: Rows, copies counted, of a task that compares cells.
LOT = 1000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_LOW = _U(0xFFFFFFFF)


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots) of sets that stand one after the other in ``elements``."""
    out = np.empty((len(counts), slots), np.int64)
    dense = counts <= 2 * slots
    for some in (np.flatnonzero(dense), np.flatnonzero(~dense)):
        if len(some):
            picked = np.repeat(np.isin(np.arange(len(counts)), some), counts)
            out[some] = _signatures(elements[picked], counts[some], slots, bool(dense[some[0]]))
    return out


def _signatures(e: np.ndarray, counts: np.ndarray, slots: int, dense: bool) -> np.ndarray:
    """dense: keep whole permutations (small sets, many levels), else only the swaps."""
    owner = np.repeat(np.arange(len(counts)), counts)
    sig = np.full(len(counts) * slots, np.iinfo(np.int64).max, np.int64)
    order = np.tile(np.arange(slots, dtype=np.int16), (len(e), 1)) if dense else None
    swaps: list[np.ndarray] = []
    for level in range(slots):
        draw = mix(e + _U((level + 1) * int(_STEP) % (1 << 64)))
        k = level + (((draw & _LOW) * _U(slots - level)) >> _U(32)).astype(np.int64)
        if dense:
            rows = np.arange(len(e))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, level]
        else:
            slot = k.copy()
            for earlier in range(level - 1, -1, -1):
                slot[slot == swaps[earlier]] = earlier
            # a swap target met again stands where the earlier swap left it
            swaps.append(k)
        np.minimum.at(sig, owner * slots + slot, (np.int64(level) << 32) | (draw >> _U(32)).astype(np.int64))
        open_ = sig.reshape(-1, slots).max(1) >= np.int64(level + 1) << 32
        stay = open_[owner]
        if not stay.any():
            break
        if not stay.all():
            e, owner = e[stay], owner[stay]
            order = order[stay] if dense else None
            swaps = [s[stay] for s in swaps]
    return sig.reshape(-1, slots)


def bands(signatures: np.ndarray, rows: int = BAND) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    s = signatures.view(_U).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(s.shape[1], dtype=_U) * _STEP, s.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _STEP + s[:, :, i])
    return key.view(np.int64)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, elements, counts): each row's distinct shingles, sorted."""
    for t in texts(column, lower=True):
        shingles, fine = grams(t.hashes, SHINGLE), inside_rows(t.count, SHINGLE)
        parts = []
        for n, before in zip(t.count.tolist(), t.before.tolist(), strict=True):
            if n >= SHINGLE:
                parts.append(np.unique(shingles[before : before + n - SHINGLE + 1]))
            else:
                parts.append(mix(grams(t.hashes[before : before + n], n) + _U(n)) if n else np.zeros(0, _U))
        assert not len(fine) or fine.sum() == sum(max(0, n - SHINGLE + 1) for n in t.count.tolist())
        yield t.first, np.concatenate(parts) if parts else np.zeros(0, _U), np.array([len(p) for p in parts], np.int64)


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, elements, counts in _sets(batch.column(1)):
            has = np.flatnonzero(counts)
            digests = np.zeros((2, len(counts)), np.int64)
            if len(has):
                starts = (np.cumsum(counts) - counts)[has]
                for i, seed in enumerate((11, 12)):
                    digests[i, has] = np.add.reduceat(mix(elements + _U(seed)), starts).view(np.int64)
            keys = bands(superminhash(elements, counts[has])) if len(has) else np.zeros((0, SLOTS // BAND), np.int64)
            sizes = np.zeros(len(counts) + 1, np.int32)
            sizes[1:][has] = keys.shape[1]
            lists = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts), pa.array(digests[0]), pa.array(digests[1]), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, elements, counts in _sets(batch.column(1)):
            ends = np.cumsum(counts)
            data = [elements[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(data, pa.binary())], names=["node", "items"])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, of sorted distinct elements."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks each row (a, b, items of a, items of b)."""
    for batch in batches:
        x, y = batch.column("xa"), batch.column("xb")
        fine = [linked(np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(fine, pa.bool_())], names=["a", "b", "linked"])


def _cell(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links between parts, of which one for two parts is enough: all left rows against all right rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    values, where = np.unique(np.concatenate([r[2] for r in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), [len(r[2]) for r in right])
    by = np.argsort(where, kind="stable")
    owner, bounds = owner[by], np.append(np.searchsorted(where[by], np.arange(len(values))), len(where))
    sizes = np.array([len(r[2]) for r in right])
    for node, part, items in left:
        at = np.searchsorted(values, items)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == items)]
        spans = [owner[bounds[i] : bounds[i + 1]] for i in at.tolist()]
        both = np.bincount(np.concatenate(spans), minlength=len(right)) if spans else np.zeros(len(right), np.int64)
        for j in np.flatnonzero((both > 0) & (100 * both >= PERCENT * (sizes + len(items) - both))).tolist():
            if find(part) != find(right[j][1]):
                root[find(part)] = find(right[j][1])
                out.append((node, right[j][0]))
    return out


def _lot(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, cell in pdf.groupby(["grp", "family", "lb", "rb"], sort=False):
        rows = {s: [(n, p, np.frombuffer(x, _U)) for n, p, x in zip(c["node"], c["part"], c["items"], strict=True)] for s, c in cell.groupby("side")}
        if len(rows) == 2:
            out += _cell(rows["left"], rows["right"])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node) of sets (node, items)."""
    for batch in batches:
        for node, items in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
            tokens = np.frombuffer(items.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), node))], names=["token", "node"])


def weighed(members: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """(node, part, n, common, rare): set size, frequent shingles, and the rare ones that recur, rarest first."""
    held = members.join(sets, "node")
    tokens = work.keep(held.select("node", "items").mapInArrow(exploded, "token long, node long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.sort_array(F.collect_list(F.when(F.col("df") <= RARE, F.struct("df", "token"))))
    per = tokens.join(often, "token").groupBy("node").agg(F.count_if(F.col("df") > RARE).alias("common"), rare["token"].alias("rare"))
    sized = held.select("node", "part", (F.octet_length("items") / 8).cast("long").alias("n"))
    return sized.join(per, "node").withColumns({"need": F.ceil(2 * PERCENT * F.col("n") / (100 + PERCENT)), "most": F.ceil(PERCENT * F.col("n") / 100)})


def sharing_rare(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of different parts and fitting sizes that share a rare shingle.

    The smaller of two linked sets has ``need`` shingles in common with the
    other, at most ``common`` of them frequent.
    """
    more = F.col("need") - F.col("common")
    probes = F.when(more <= 0, F.size("rare")).otherwise(F.greatest(F.lit(0), F.size("rare") - more + 1)).cast("int")
    probe = nodes.select("node", "part", "n", F.explode(F.slice("rare", F.lit(1), probes)).alias("token"))
    index = nodes.select(F.col("node").alias("other"), F.col("part").alias("of"), F.col("n").alias("size"), F.explode("rare").alias("token"))
    met = probe.join(index, "token").where(f"part <> of and n <= size and 100 * n >= {PERCENT} * size")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _frequent(nodes: DataFrame, groups: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """Links between parts without a shared rare shingle: mostly frequent sets, one of the two almost wholly so."""
    label = groups.withColumnsRenamed({"u": "node", "v": "grp"})
    heavy = nodes.where("common >= most").select("node", "part", (F.col("common") >= F.col("need")).alias("dense")).join(label, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    heavy = work.keep(heavy, "heavy")
    sized = heavy.groupBy("grp", "part").agg(F.count("*").alias("n"))
    ranked = sized.groupBy("grp").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = heavy.join(ranked.select("grp", "main"), "grp").withColumn("off", F.col("part") != F.col("main"))
    # every pair has a side off the main part and a dense side: dense and off beside all, or off beside dense
    roles = F.array(*[F.when(c, F.struct(F.lit(family).alias("family"), F.lit(side).alias("side"))) for family, side, c in (("all", "left", F.col("dense") & F.col("off")), ("all", "right", F.lit(True)), ("dense", "left", F.col("off") & ~F.col("dense")), ("dense", "right", F.col("dense") & ~F.col("off")))])
    rows = rows.select("node", "part", "grp", F.inline(F.array_compact(roles)))
    n = rows.groupBy("grp", "family").agg(F.ceil(F.count_if(F.col("side") == "left") / BLOCK).alias("lbs"), F.ceil(F.count_if(F.col("side") == "right") / BLOCK).alias("rbs")).where("lbs > 0 and rbs > 0")
    rows = work.keep(rows.join(n, ["grp", "family"]), "roles")
    spread = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    mine = lambda k: F.pmod(F.xxhash64("node", "side"), k)
    keys = ["node", "part", "grp", "family", "side"]
    left = rows.where("side = 'left'").select(*keys, mine(F.col("lbs")).alias("lb"), spread(F.col("rbs")).alias("rb"))
    right = rows.where("side = 'right'").select(*keys, mine(F.col("rbs")).alias("rb"), spread(F.col("lbs")).alias("lb"))
    cells = left.unionByName(right).join(sets, "node")
    copies = rows.agg(F.sum(F.when(F.col("side") == "left", F.col("rbs")).otherwise(F.col("lbs")))).first()[0] or 0
    lot = F.pmod(F.xxhash64("grp", "family", "lb", "rb"), F.lit(max(1, -(-copies // LOT))))
    return cells.withColumn("lot", lot).groupBy("lot").applyInPandas(lambda pdf: _lot(pdf), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are linked, on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("xb")), "b")
    return both.mapInArrow(verified, "a long, b long, linked boolean").where("linked").select("a", "b")


def _rest(keyed: DataFrame, pairs: DataFrame, parts: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame | None:
    """Links that are left between the parts of band buckets with more than one; None if there is no such bucket."""
    named = keyed.select("node", "band").join(parts.withColumnsRenamed({"u": "node", "v": "part"}), "node", "left").withColumn("part", F.coalesce("part", "node"))
    mixed = named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band")
    members = work.keep(named.join(mixed, "band").select("node", "part").distinct(), "members")
    if not members.limit(1).count():
        return None
    nodes = work.keep(weighed(members, sets, work), "weighed")
    found = work.keep(verify(sharing_rare(nodes), sets), "rare")
    if not nodes.where("common >= need").limit(1).count():
        return found
    return found.unionByName(_frequent(nodes, components(pairs, work, "groups"), sets, work))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    work = Workspace(docs.sparkSession, "neardup")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = work.keep(rows.mapInArrow(features, FEATURES), "features")
    classes = found.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = work.keep(classes, "classes")
    keyed = classes.select("node", "n", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = keyed.join(hubs, "band").select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    pairs = work.keep(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = work.keep(rows.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(full_sets, "node long, items binary").distinct(), "sets")
    sized = sets.select("node", F.octet_length("items").alias("n"))
    close = pairs.join(sized.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    close = close.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b").distinct()
    links = work.keep(verify(close, sets).distinct(), "links")
    parts = components(links, work, "parts")
    more = _rest(keyed, pairs, parts, sets, work)
    more = None if more is None else work.keep(more.distinct(), "more")
    if more is not None and more.limit(1).count():
        parts = components(links.unionByName(more), work, "whole")
    named = classes.select("d1", "d2", F.col("node").alias("u")).join(parts, "u", "left").select("d1", "d2", F.coalesce("v", "u").alias("component"))
    out = found.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    lone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
