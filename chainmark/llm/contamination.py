"""Benchmark decontamination as a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one
window). Its set holds its word shingles; containment must be whole, so one
token is a necessary prefix, and the cheapest is the shingle rarest in the
corpus. Everything is tables and joins, however large the benchmark:

1. Windows. Equal windows of all items are one row, known by their MD5; which
   items hold them is a table of its own.
2. Rarity. One pass over the documents counts the benchmark's shingles; a bit
   table of fixed size keeps other shingles out of the shuffle.
3. Prefixes. Each window's rarest shingle, with its offset there.
4. Join. A second pass emits the document shingles that may be prefixes, with
   the position and the words around; they join the prefixes. Length and
   position bounds drop windows that would leave the document; the others
   compare all words of the window exactly.

Bit tables have at most BITS bits (8 MiB), whatever they stand for; a benchmark
that fills them costs shuffled shingles, never results. Prefixes are broadcast
only while they hold at most BROADCAST_ROWS rows.

Defined cases: null or wordless texts have no words, no hits and are not
contaminated; a wordless item or one with a null id has no window; rows of
``benchmark`` that share an id are one item; repeated documents are judged one
by one (equal texts are searched alike and each row gets the result). Empty
tables give no rows or no hits. Texts are read a few megabytes at a time, a
longer one by itself; other columns stay in ``doc``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LETTERS, Texts, grams, inside_rows, texts
from .work import Workspace

WINDOW, SHINGLE = 13, 5
BITS = 1 << 26
BROADCAST_ROWS = 200_000
#: As LETTERS with capitals, for counting without lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII = bytes(range(256)).lower()
_U = np.uint64


def _words(t: Texts, at: int, n: int) -> bytes:
    return b" ".join(t.bytes_of(i) for i in range(at, at + n)).translate(_ASCII)


def _read(column: pa.Array) -> Iterator[Texts]:
    return texts(column, LETTERS, lower=True)


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, words, shingles): every window of every item; shingles as hashes by offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for t in _read(batch.column(1)):
                out = []
                for row, (n, before) in enumerate(zip(t.count.tolist(), t.before.tolist(), strict=True)):
                    size = min(n, WINDOW)
                    if not n or ids[t.first + row] is None:
                        continue
                    short = grams(t.hashes[before : before + n], min(size, SHINGLE)).view(np.int64)
                    for at in range(n - size + 1):
                        out.append({"item_id": ids[t.first + row], "n": size, "words": _words(t, before + at, size), "shingles": short[at : at + size - min(size, SHINGLE) + 1].tolist()})
                    if len(out) > 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("words", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    return benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, "item_id string, n int, words binary, shingles array<long>")


class Bits:
    """A bit table; a hash that is not in it belongs to no row it stands for."""

    def __init__(self, places: np.ndarray, masks: np.ndarray, bits: int) -> None:
        self.last = _U(bits - 1)
        self.words = np.zeros(bits // 64, _U)
        self.words[places] = masks

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.last
        return ((self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).astype(bool)


def _bits(hashes: DataFrame, column: str) -> dict[int, Broadcast]:
    """By shingle length (column ``n``) the bit table of ``column``; at most BITS / 64 rows a length reach the driver."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1).cast("long"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int")))
    found = hashes.groupBy("n", F.shiftright(at, 6).alias("place")).agg(mask.alias("mask")).toArrow()
    n, place, masks = (found.column(c).to_numpy() for c in ("n", "place", "mask"))
    context = hashes.sparkSession.sparkContext
    return {int(x): context.broadcast(Bits(place[n == x], masks[n == x].view(_U), BITS)) for x in np.unique(n)}


def _spots(t: Texts, sets: dict[int, Broadcast]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shingle length, positions, hashes) of the shingles that a bit table may hold."""
    for n, bits in sets.items():
        hashes = grams(t.hashes, n)
        some = np.flatnonzero(bits.value.may_hold(hashes) & inside_rows(t.count, n)[: len(hashes)])
        yield n, some, hashes[some]


def rarity(docs: DataFrame, shingles: DataFrame, text: str) -> DataFrame:
    """(n, shingle, often): corpus frequency of the shingles that occur; ``shingles`` is (n, shingle)."""
    sets = _bits(shingles, "shingle")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _read(batch.column(0)):
                for n, _, hashes in _spots(t, sets):
                    values, often = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), n, np.int32)), pa.array(values.view(np.int64)), pa.array(often)], names=["n", "shingle", "often"])

    return docs.select(text).mapInArrow(count, "n int, shingle long, often long").groupBy("n", "shingle").agg(F.sum("often").alias("often"))


def prefixes(cut: DataFrame, docs: DataFrame, text: str, work: Workspace) -> DataFrame:
    """(wid, size, words, n, shingle, offset): each different window with its rarest shingle."""
    each = work.keep(cut.groupBy("wid").agg(F.first("n").alias("size"), F.first("words").alias("words"), F.first("shingles").alias("shingles")), "windows")
    tokens = each.select("wid", F.least("size", F.lit(SHINGLE)).alias("n"), F.posexplode("shingles").alias("offset", "shingle"))
    often = work.keep(rarity(docs, tokens.select("n", "shingle").distinct(), text), "rarity")
    ranked = tokens.join(often, ["n", "shingle"], "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "offset", "n")).alias("t"))
    return each.join(ranked, "wid").select("wid", "size", "words", "t.n", "t.shingle", "t.offset")


def _emitter(sets: dict[int, Broadcast]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Possible prefix tokens of every text: position, words before and words after, up to a window each way."""
        for batch in batches:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            for t in _read(batch.column("text")):
                row, before, ends, out = t.row, t.before, t.before + t.count, []
                for n, some, hashes in _spots(t, sets):
                    for p, h in zip(some.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        r = int(row[p])
                        a, b = max(int(before[r]), p - WINDOW + 1), min(int(ends[r]), p + WINDOW)
                        out.append((h1[t.first + r], h2[t.first + r], n, h, p - int(before[r]), p - a, _words(t, a, b - a)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h1", "h2", "n", "shingle", "at", "back", "around"])

    return emit


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of prefix tokens beside a window, those whose document has all of its words there."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            around, start = r["around"].split(b" "), r["back"] - r["offset"]
            if start >= 0 and b" ".join(around[start : start + r["size"]]) == r["words"]:
                out.append((r["h1"], r["h2"], r["at"] - r["offset"], r["size"], r["wid"]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h1", "h2", "start", "size", "wid"])


def _covered(spans: Column) -> Column:
    """Words inside at least one of (start, size), given sorted."""
    end = lambda s: s["start"] + s["size"]
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), end(s) - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], end(s)).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step)["n"]


def hits(docs: DataFrame, benchmark: DataFrame, work: Workspace, text: str = "text") -> DataFrame:
    """(h1, h2, n_hit, n_items, items_sha256) of every text with an occurring window, known by two hashes."""
    cut = work.keep(windows(benchmark).withColumn("wid", F.md5("words")), "cut")
    held = work.keep(cut.select("wid", "item_id").distinct(), "held")
    found = work.keep(prefixes(cut, docs, text, work), "prefixes")
    keyed = docs.where(F.col(text).isNotNull()).select(*text_key(F.col(text)), F.col(text).alias("text"))
    tokens = keyed.mapInArrow(_emitter(_bits(found.select("n", "shingle"), "shingle")), "h1 long, h2 long, n int, shingle long, at long, back int, around binary")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    met = tokens.join(side, ["n", "shingle"]).where("back >= offset")
    spans = work.keep(met.select("h1", "h2", "at", "back", "around", "offset", "size", "words", "wid").mapInArrow(_verified, "h1 long, h2 long, start long, size int, wid string").distinct(), "spans")
    inside = spans.groupBy("h1", "h2").agg(_covered(F.sort_array(F.collect_set(F.struct("start", "size")))).alias("n_hit"))
    named = spans.select("h1", "h2", "wid").distinct().join(held, "wid").groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return inside.join(named, ["h1", "h2"]).select("h1", "h2", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, one_in: int = 20) -> DataFrame:
    """Columns ``keep`` (all by default, in the struct ``doc``) with n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one in ``one_in`` of its words lies
    inside an occurring window.
    """
    work = Workspace(docs.sparkSession, "contamination")
    found = work.keep(hits(docs, benchmark, work, text), "hits")
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), *text_key(F.col(text)), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    out = rows.join(found, ["h1", "h2"], "left").select("doc", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    return annotate(docs, benchmark, **options).where(~F.col("contaminated")).select("doc.*")
