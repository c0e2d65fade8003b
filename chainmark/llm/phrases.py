"""Phrase mining with hash pruning (PCY, DHP) and Apriori.

Pass n over the texts counts phrases of n words exactly and, of those of n + 1
words, only buckets of a hash:

* a phrase is counted exactly only if its bucket reached ``support`` in the
  pass before and, by Apriori, both of its parts of n - 1 words are frequent;
* a bucket counts phrases of n + 1 words whose two parts of n words passed
  those tests (DHP), and counts no further than ``support``.

What is sent to the tasks are two bit tables of BITS bits (4 MiB each, whatever
the corpus): the buckets that reached ``support`` and the hashes of the frequent
phrases. Both err on one side only: they may let a phrase through, which the
exact count then drops. Counts are kept by the phrase's text, never by a hash.
Tasks add up their own counts before the shuffle, buckets in a table of BITS
small numbers, so a frequent word or language is one row a task.

Defined cases: a null text is empty; a null language is ``und``; rows are
counted as often as they occur, whatever their id; phrases cross neither
punctuation nor rows; of equal scores and counts the phrase smaller in UTF-8
comes first; texts of any length are taken whole (memory follows the longest);
columns other than the text and the language are not read. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contamination import Bits
from .words import Texts, grams, mix, texts
from .work import Workspace

SUPPORT, LONGEST, TOP = 30, 4, 2000
BITS = 1 << 25
#: Parts of a language in which its best phrases are found first.
PARTS = 64
_U = np.uint64
_ROWS = 1 << 17
#: Bytes of text that a task takes at a time, and rows that reach it together: a worker stays small beside its executor.
_SLICE, _BATCH = 1 << 19, 2000
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_STOPS
_INSIDE[[0x20, 0x09]] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SCHEMA = "lang string, phrase string, bucket long, n long"
_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_NAMES = ["lang", "phrase", "bucket", "n"]


def _batch(lang: pa.Array, phrase: pa.Array, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], names=_NAMES)


class _Slice:
    """Words of some rows: their hashes by language, numbers by text, and which stand next to each other in a piece."""

    def __init__(self, t: Texts, lang: np.ndarray, of_lang: np.ndarray, bits: int) -> None:
        row, self.bits = t.row, bits
        self.lang = lang[t.first + row]
        self.salt = of_lang[self.lang]
        self.hashes = t.hashes
        stops = np.append(np.int32(0), np.cumsum(_STOPS[t.data], dtype=np.int32))
        self.next = np.zeros(len(row), bool)  # word k + 1 follows k in one piece
        self.next[:-1] = (row[1:] == row[:-1]) & (stops[t.begin[1:]] == stops[t.end[:-1]])
        edges = np.column_stack([t.begin, t.end]).ravel().astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges if len(edges) else np.zeros(1, np.int64)), pa.py_buffer(_LOWER[t.data])])
        coded = whole.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
        self.code, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_string())

    def whole(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        out = np.ones(len(self.next), bool)
        for i in range(n - 1):
            out[: len(out) - i] &= self.next[i:]
            out[len(out) - i :] = False
        return out

    def hash(self, n: int) -> np.ndarray:
        """Of the n words from each word on; zero where fewer are left."""
        out = np.zeros(len(self.hashes), _U)
        found = grams(self.hashes, n)
        out[: len(found)] = mix(found ^ self.salt[: len(found)])
        return out & _U(self.bits - 1)

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place, number of places) of every different phrase of n words that begins in ``at``; by text, not by hash."""
        size = max(1, len(self.words))
        key = self.lang[at] * size + self.code[at]
        for i in range(1, n):
            key = np.unique(key, return_inverse=True)[1] * size + self.code[at + i]
        _, first, often = np.unique(key, return_index=True, return_counts=True)
        return at[first], often

    def phrase(self, at: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.code[at + i])) for i in range(n)], pa.scalar(" ", pa.large_string()))


def _pass(n: int, last: bool, support: int, bits: int, buckets: Broadcast | None, parts: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0 if last else bits, np.min_scalar_type(support))
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.to_pylist()], _U)
            for t in texts(batch.column(1), _INSIDE, lower=True, size=_SLICE):
                if not len(t.hashes):
                    continue
                s = _Slice(t, lang, of_lang, bits)
                hashes, live = s.hash(n), s.whole(n)
                if n > 1:
                    frequent = parts.value.may_hold(s.hash(n - 1))
                    live &= buckets.value.may_hold(hashes) & frequent
                    live[:-1] &= frequent[1:]
                at, often = s.counted(np.flatnonzero(live), n)
                yield _batch(names.take(pa.array(s.lang[at])), s.phrase(at, n), hashes[at], often)
                if n == 1:
                    total = np.bincount(s.lang)
                    some = np.flatnonzero(total)
                    yield _batch(names.take(pa.array(some)), pa.nulls(len(some)), np.full(len(some), -1), total[some])
                if not last:
                    both = live & s.whole(n + 1)
                    both[:-1] &= live[1:]
                    bucket, often = np.unique(s.hash(n + 1)[both], return_counts=True)
                    bucket = bucket.astype(np.int64)
                    seen[bucket] = np.minimum(seen[bucket] + often, support)
        used = np.flatnonzero(seen)
        for k in range(0, len(used), _ROWS):
            some = used[k : k + _ROWS]
            yield _batch(pa.nulls(len(some)), pa.nulls(len(some)), some, seen[some])

    return run


def _bits(rows: DataFrame, bits: int) -> Broadcast:
    """Bit table of the column ``bucket``; at most ``bits`` / 64 rows reach the driver."""
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").bitwiseAND(63).cast("int")))
    found = rows.groupBy(F.shiftright("bucket", 6).alias("place")).agg(mask.alias("mask")).toArrow()
    return rows.sparkSession.sparkContext.broadcast(Bits(found.column("place").to_numpy(), found.column("mask").to_numpy().view(_U), bits))


def frequent(docs: DataFrame, work: Workspace, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, words, f) of every phrase of 1 to ``longest`` words that occurs ``support`` times; (lang, n) words of a language."""
    read = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conf = docs.sparkSession.conf
    before = conf.get(_PER_BATCH)
    conf.set(_PER_BATCH, str(min(int(before), _BATCH)))
    try:
        return _passes(read, work, support, longest, bits)
    finally:
        conf.set(_PER_BATCH, before)


def _passes(read: DataFrame, work: Workspace, support: int, longest: int, bits: int) -> tuple[DataFrame, DataFrame]:
    buckets = parts = totals = None
    found = []
    for n in range(1, longest + 1):
        rows = read.mapInArrow(_pass(n, n == longest, support, bits, buckets, parts), _SCHEMA)
        sums = rows.groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        kept = work.keep(sums.where((F.col("n") >= support) | (F.col("bucket") < 0)), f"pass{n}")
        if n == 1:
            totals = kept.where("bucket < 0").select("lang", "n")
        exact = kept.where(F.col("phrase").isNotNull())
        found.append(exact.select("lang", "phrase", F.lit(n).alias("words"), F.col("n").alias("f")))
        if n < longest:
            buckets, parts = _bits(kept.where("phrase is null and bucket >= 0"), bits), _bits(exact, bits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    a, l and r count the phrase and the two parts of its weakest cut, the score
    is floor(2000000 a / (l + r)); a phrase is left out where one that holds it
    occurs at least 80 % as often.
    """
    work = Workspace(docs.sparkSession, "phrases")
    known, totals = frequent(docs, work, text, lang, support, longest, bits)
    candidates = known.where("words > 1").withColumnRenamed("f", "a")
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    side = lambda part, f: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    met = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # products can pass 64 bits; decimals of 38 digits divide exactly
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # every shorter phrase inside: its first word and its number of words
    spans = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(size).alias("size")) for size in range(2, longest) for i in range(1, longest - size + 2)])
    inside = candidates.where("words > 2").select("lang", "phrase", "words", "a", F.explode(spans).alias("x")).where("x.size < words and x.at + x.size <= words + 1")
    inside = inside.select("lang", F.expr("array_join(slice(split(phrase, ' '), x.at, x.size), ' ')").alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("m"))
    rows = scored.join(longer, ["lang", "phrase"], "left").where(F.col("m").isNull() | (_wide("m") * 100 < _wide("a") * 80))
    # the best of each part of a language, then of all its parts: no task gets all phrases of a language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
