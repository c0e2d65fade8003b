"""Substring dedup on a De Bruijn graph of word k-mers.

Edges are k-mers (windows of ``k`` words), nodes the words they share. Most
edges occur once and never leave the machine that read them:

1. Pieces. Every window has a minimizer (its least 5-word hash); the windows of
   one minimizer form a piece, a nonbranching path inside its document. Equal
   passages are cut into equal pieces, but for their ends. A piece is emitted
   with its coordinates and with the pieces before and after it.
2. Repeats. A minimizer that occurs in one document only cannot lie in a
   repeated window; a join with the repeated ones keeps the other pieces.
3. Paths. Equal pieces are one path; its source is the smallest document that
   holds it, with the coordinates there.
4. Compaction. Path A continues in path B if every occurrence of A is followed
   by B and every occurrence of B preceded by A. A join of the paths with
   themselves finds these nonbranching steps; along the source's coordinates
   they chain into one compact path, and only its head is looked up in
   documents: where the head occurs, all of it does.
5. Branches. Paths that share a minimizer but differ (passage ends, edits) are
   opened again at their source coordinates into single windows, which are
   joined by window hash; each gets the smallest document of its window.
6. Verification. Every repeated span has coordinates in its source. The words
   there are read from the source's text and their SHA-256 goes to the copies;
   a span is removed only where the copy's own words give the same digest.

Steps 1 to 5 identify words by 64-bit hashes or wider; a collision there costs
a span that step 6 then refuses, and never removes words that differ.

Defined cases: null texts have no words; a null id ranks after all others, so
it is never a source for another row; rows that share an id never remove each
other's words and are judged one by one; rows that share id and text are
handled once and each get the result; an empty table gives no rows. Columns other
than the id and the text are not read, whatever their names. Texts of any length
are cut whole; a task's memory follows the longest text it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Texts, grams, inside_rows, mix, texts
from .work import Workspace

WINDOW, MINIMIZER = 13, 5
_U = np.uint64
#: Rank of a null id.
LAST = 2**63 - 1


def _minimizers(t: Texts, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, position of each one's minimizer) for windows inside rows."""
    fine = inside_rows(t.count, k)
    starts = np.flatnonzero(fine)
    if not len(starts):
        return starts, starts
    order = grams(t.hashes, m)
    best = order[: len(fine)].copy()
    at = np.arange(len(fine))
    for i in range(1, k - m + 1):
        other = order[i : i + len(fine)]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    return starts, at[starts]


def _pieces(t: Texts, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, minimizer hash, minimizer position) of every piece."""
    starts, at = _minimizers(t, k, m)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(_U), none
    row = t.row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    return row[first], starts[first], size, grams(t.hashes, m)[at[first]], at[first]


_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_table: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _table or len(_table[base]) < n:
        p = np.full(max(n, 1 << 16), base, _U)
        p[0] = 1
        _table[base] = np.multiply.accumulate(p)
    return _table[base][:n]


def _span_hash(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the words begin .. begin+size, any sizes."""
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes ^ _U(seed)) * _powers(_MULT, len(hashes)), out=total[1:])
    return mix((total[begin + size] - total[begin]) * _powers(_INVERSE, len(hashes) + 1)[begin] + size.astype(_U))


#: Where a piece is: its first window (59 bits) and how many windows it has (4 bits).
_SIZE = 15
PIECES = "minimizer long, piece long, doc long, key long, place long, prior long, following long"


def _marker(k: int, m: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Minimizers with the least and the greatest document of a slice."""
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for t in texts(batch.column("text")):
                row, _, _, minimizer, _ = _pieces(t, k, m)
                order = np.lexsort((docs[t.first + row], minimizer))
                minimizer, doc = minimizer[order], docs[t.first + row][order]
                new = np.flatnonzero(np.append(True, minimizer[1:] != minimizer[:-1])) if len(order) else order
                last = np.append(new[1:], len(order)) - 1 if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(minimizer[new].view(np.int64)), pa.array(doc[new]), pa.array(doc[last])], names=["minimizer", "low", "high"])

    return mark


def _cutter(k: int, m: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for t in texts(batch.column("text")):
                row, first, size, minimizer, _ = _pieces(t, k, m)
                piece = _span_hash(t.hashes, first, size + k - 1, 1).view(np.int64)
                # pieces of a row follow each other without a gap; 0: none
                prior, following = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                same = row[1:] == row[:-1]
                prior[1:][same], following[:-1][same] = piece[:-1][same], piece[1:][same]
                place = ((first - t.before[row]) << 4) | size
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (minimizer.view(np.int64), piece, docs[t.first + row], keys[t.first + row], place, prior, following)], names=["minimizer", "piece", "doc", "key", "place", "prior", "following"])

    return cut


def _opener(k: int):
    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Single windows of the pieces that are listed beside each text."""
        for batch in batches:
            docs, keys, lists = batch.column("doc").to_numpy(), batch.column("key").to_numpy(), batch.column("open").to_pylist()
            for t in texts(batch.column("text")):
                whole = grams(t.hashes, k).view(np.int64)
                at, size, row = [], [], []
                for r, before in enumerate(t.before.tolist()):
                    for x in lists[t.first + r]:
                        at.append(before + (x >> 4))
                        size.append(x & _SIZE)
                        row.append(r)
                if not at:
                    continue
                size = np.array(size, np.int64)
                windows = np.repeat(np.array(at, np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                owner = np.repeat(np.array(row, np.int64), size)
                proofs = (_span_hash(t.hashes, windows, np.full(len(windows), k, np.int64), 2) >> _U(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(whole[windows]), pa.array(proofs), pa.array(docs[t.first + owner]), pa.array(keys[t.first + owner]), pa.array(windows - t.before[owner])], names=["window", "proof", "doc", "key", "start"])

    return open_


def _words_digest(t: Texts, at: int, n: int) -> bytes:
    """First 16 bytes of the SHA-256 of n words joined by single spaces."""
    data = t.data[t.begin[at] : t.end[at + n - 1]].tobytes()
    return hashlib.sha256(b" ".join(data.split())).digest()[:16]


def _reader(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the listed spans of every text, read at their coordinates."""
        for batch in batches:
            docs, keys, lists = batch.column("doc").to_pylist(), batch.column("key").to_pylist(), batch.column("spans").to_pylist()
            for t in texts(batch.column("text")):
                out = []
                for r, before in enumerate(t.before.tolist()):
                    i = t.first + r
                    out += [(docs[i], keys[i], x["at"], x["windows"], _words_digest(t, before + x["at"], x["windows"] + k - 1)) for x in lists[i]]
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["source", "source_key", "source_at", "windows", "digest"])

    return read


def _remover(k: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, raw = batch.column("covered").to_pylist(), batch.column("text")
            for t in texts(raw):
                n_removed, digests, spans, kept = [], [], [], []
                begin, end = t.begin, t.end
                for r, (n, before) in enumerate(zip(t.count.tolist(), t.before.tolist(), strict=True)):
                    gone = np.zeros(n + 1, np.int64)
                    for x in lists[t.first + r] or ():
                        size = x["windows"] + k - 1
                        if _words_digest(t, before + x["at"], size) == x["digest"]:
                            gone[x["at"]] += 1
                            gone[x["at"] + size] -= 1
                    gone = np.cumsum(gone)[:n] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    data = t.data
                    left = b" ".join(data[b:e].tobytes() for b, e in zip(begin[before : before + n][~gone].tolist(), end[before : before + n][~gone].tolist(), strict=True)) if gone.any() else b" ".join(data[begin[before] : end[before + n - 1]].tobytes().split()) if n else b""
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if with_text else None)
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                first, size = t.first, len(t.count)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, size), pa.array(t.count.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return remove


SAME = ["minimizer", "piece", "size"]


def compact(paths: DataFrame) -> DataFrame:
    """(minimizer, piece, size, windows, source, source_key, source_at): heads of compact paths.

    ``paths`` also has last (the greatest document), and the one path that comes
    before (``only_prior``) and after (``only_following``) every occurrence, or 0.
    """
    copied = paths.where("source < last").select(*SAME, "source", "source_key", "source_at", "only_prior", "only_following")
    # the join that compacts: B follows A everywhere, A precedes B everywhere
    a = copied.where("only_following <> 0").select(F.col("piece").alias("prior_piece"), F.col("only_following").alias("piece"), F.col("source").alias("a_source"), F.col("source_key").alias("a_key"), (F.col("source_at") + F.col("size")).alias("a_end"))
    joined = copied.join(a, "piece").where("only_prior = prior_piece and source = a_source and source_key = a_key and source_at = a_end")
    inner = joined.select(*SAME, F.lit(False).alias("head")).distinct()
    marked = copied.join(inner, SAME, "left").withColumn("head", F.coalesce("head", F.lit(True)))
    along = Window.partitionBy("source", "source_key").orderBy("source_at", "minimizer", "piece").rowsBetween(Window.unboundedPreceding, 0)
    chained = marked.withColumn("chain", F.sum(F.col("head").cast("int")).over(along))
    first = F.min_by(F.struct(*SAME, "source_at"), F.struct("source_at", ~F.col("head")))
    return chained.groupBy("source", "source_key", "chain").agg(first.alias("h"), F.sum("size").alias("windows")).select("h.minimizer", "h.piece", "h.size", "windows", "source", "source_key", "h.source_at")


def _segments(windows: DataFrame) -> DataFrame:
    """Runs of windows (doc, key, start, source, source_key, source_at) that follow each other in both documents."""
    keys = ["doc", "key", "source", "source_key", "shift"]
    rows = windows.withColumn("shift", F.col("source_at") - F.col("start")).select(*keys, "start").distinct()
    island = F.col("start") - F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    runs = rows.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("at"), F.count("*").alias("windows"))
    return runs.select("doc", "key", "at", "windows", "source", "source_key", (F.col("at") + F.col("shift")).alias("source_at"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MINIMIZER, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept_text) of every row.

    ``spans`` are the removed ranges of words.
    """
    if not 0 < m <= k <= m + _SIZE - 1:
        raise ValueError("minimizers must be shorter than windows, by less than 15 words")
    work = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a row is known by its id and 64 bits of its text
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    marks = rows.select("doc", "text").mapInArrow(_marker(k, m), "minimizer long, low long, high long")
    shared = work.keep(marks.groupBy("minimizer").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("minimizer"), "shared")
    pieces = rows.select("doc", "key", "text").mapInArrow(_cutter(k, m), PIECES)
    pieces = work.keep(pieces.join(shared.hint("shuffle_hash"), "minimizer"), "pieces").withColumn("size", F.col("place").bitwiseAND(F.lit(_SIZE).cast("long")))
    start = F.shiftright("place", 4)
    least = F.min(F.struct("doc", "key", start.alias("at")))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0)
    paths = pieces.groupBy(*SAME).agg(least.alias("s"), F.max("doc").alias("last"), one("prior").alias("only_prior"), one("following").alias("only_following"))
    paths = work.keep(paths.select(*SAME, F.col("s.doc").alias("source"), F.col("s.key").alias("source_key"), F.col("s.at").alias("source_at"), "last", "only_prior", "only_following"), "paths")
    heads = work.keep(compact(paths), "heads")
    origin = ["source", "source_key", "source_at"]
    whole = pieces.join(heads, SAME).where("source < doc").select("doc", "key", start.alias("at"), "windows", *origin)
    # paths that meet another at their minimizer: their occurrences in rows of the source's id, window by window
    meet = paths.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer")
    sources = paths.join(meet, "minimizer").select(*SAME, F.col("source").alias("doc"))
    first = pieces.join(sources, [*SAME, "doc"]).select("doc", "key", "place")
    listed = work.keep(first.groupBy("doc", "key").agg(F.collect_set("place").alias("open")), "open")
    texts_of = rows.select("doc", "key", "text")
    opened = texts_of.join(listed.hint("shuffle_hash"), ["doc", "key"])
    windows = work.keep(opened.mapInArrow(_opener(k), "window long, proof int, doc long, key long, start long"), "windows")
    origins = windows.groupBy("window", "proof").agg(F.min(F.struct("doc", "key", "start")).alias("s"), F.max("doc").alias("last")).where("s.doc < last")
    origins = origins.select("window", "proof", F.col("s.doc").alias("source"), F.col("s.key").alias("source_key"), F.col("s.start").alias("source_at"))
    single = _segments(windows.join(origins, ["window", "proof"]).where("source < doc").select("doc", "key", "start", *origin))
    found = work.keep(whole.unionByName(single).distinct(), "found")
    # the words at the source's coordinates, read once for each different span
    asked = found.select(*origin, "windows").distinct().groupBy("source", "source_key").agg(F.collect_list(F.struct(F.col("source_at").alias("at"), "windows")).alias("spans"))
    asked = work.keep(asked.select(F.col("source").alias("doc"), F.col("source_key").alias("key"), "spans"), "asked")
    read = texts_of.join(asked.hint("shuffle_hash"), ["doc", "key"]).mapInArrow(_reader(k), "source long, source_key long, source_at long, windows long, digest binary")
    covered = found.join(work.keep(read.distinct(), "digests"), [*origin, "windows"]).groupBy("doc", "key").agg(F.collect_list(F.struct("at", "windows", "digest")).alias("covered"))
    covered = work.keep(covered, "covered")
    out = rows.join(covered.hint("shuffle_hash"), ["doc", "key"], "left").select("doc_id", "text", "covered")
    return out.mapInArrow(_remover(k, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept_text string")
