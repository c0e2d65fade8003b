"""Exact top-k inner products by distributed histogram selection.

Vectors are stored once as blocks: the ids and the matrix of up to BLOCK rows,
cut from each task's rows as they come. A cell is a query block beside a
candidate block; it scores its pair with one matrix product. The k-th score of
each query is found by refining histograms: every round each cell counts its
scores in the bins of the query's open interval, the counts of all cells are
added, and the interval shrinks to the bin that holds the k-th score, until it
is one integer wide. A last pass keeps scores above that value and, of those
equal to it, the smallest ids.

Query blocks are broadcast while they hold at most BROADCAST_BYTES, so no
candidate is shuffled; larger query sets are joined to the candidates by block.
A cell never reports bins below its own k-th score (the global k-th cannot be
lower) nor more than k ties, so what cells send does not grow with ties.

Defined cases: vectors that are null, or hold a null or non-finite component or
one whose scaled value is not finite, take no part; nor does a null id.
Repeated rows are candidates each and, among the queries, queries each; a query
excludes all rows with its own id. Shorter vectors count as padded with zeros.
Scores are exact integers of any size while they are compared; one outside the
long range counts as the nearest long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

#: Rows of a block at most.
BLOCK = 2048
BINS = 256
#: Query blocks of at most this size go to every executor.
BROADCAST_BYTES = 16 << 20
_LONG = 2**63 - 1
BLOCKS = "ids binary, width int, matrix binary"


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x), a whole number, of every vector that takes part."""
    # doubles of 2 ** 52 and more are whole already
    whole = lambda c: F.when(F.abs(c) < float(2**52), F.floor(F.when(F.abs(c) < float(2**52), c)).cast("double")).otherwise(c)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding).cast("array<double>"), lambda c: whole(c * scale)).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            ids, v = batch.column("vec_id").slice(at, BLOCK).to_numpy(), batch.column("v").slice(at, BLOCK)
            sizes = np.asarray(v.value_lengths())
            width = int(sizes.max(initial=0))
            matrix = np.zeros((len(ids), width))
            matrix[np.arange(width)[None, :] < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "width", "matrix"])


def blocks(vectors: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(block, ids, width, matrix); the numbers are set once the blocks are written."""
    kept = work.keep(vectors.select("vec_id", "v").mapInArrow(_packed, BLOCKS), f"{name}-rows")
    return work.keep(kept.withColumn("block", F.monotonically_increasing_id()), name)


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products; in doubles or longs wherever those are exact."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    if bound < 2**51:
        return q @ c.T
    if bound < 2**61:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip((whole(q) @ whole(c).T).astype(object), -_LONG, _LONG) if width else np.zeros((len(q), len(c)), object)


def _cells(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[tuple]:
    """(query block, query ids, their lo, candidate ids, scores, which are not of a query's own id), some queries at a time."""
    for batch in batches:
        for r in batch.to_pylist():
            own, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q, c = np.frombuffer(r["q_matrix"]).reshape(len(own), r["q_width"]), np.frombuffer(r["matrix"]).reshape(len(ids), r["width"])
            order = np.argsort(ids, kind="stable")
            ids, c, lo = ids[order], c[order], np.array(r["lo"], np.int64)
            for at in range(0, len(own), 256):
                some = slice(at, at + 256)
                yield r["q_block"], at, own[some], lo[some], ids, _scores(q[some], c, bound), own[some, None] != ids[None, :]


def _bins(scores: np.ndarray, lo: np.ndarray, shift: int) -> np.ndarray:
    """Bin above each query's lo, each 2**shift wide: -1 below, BINS beyond the last."""
    if scores.dtype == np.float64:
        return np.clip(np.floor((scores - lo[:, None]) * 2.0**-shift), -1, BINS).astype(np.int64)
    if scores.dtype == np.int64:
        return np.clip((scores - lo[:, None]) >> shift, -1, BINS)
    return np.clip((scores - lo.astype(object)[:, None]) >> shift, -1, BINS).astype(np.int64)


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=names)


def _counter(k: int, shift: int, bound: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, own, lo, _, scores, other in _cells(batches, bound):
            b = np.where(other, _bins(scores, lo, shift), -1) + 1
            n = np.bincount((b + np.arange(len(own))[:, None] * (BINS + 2)).ravel(), minlength=len(own) * (BINS + 2)).reshape(len(own), -1)
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            row, some = np.nonzero((n > 0) & (above < k) & (np.arange(BINS + 2) > 0))
            yield _table([[np.full(len(row), block)], [row + at], [some - 1], [n[row, some]]], ["q_block", "slot", "bin", "n"])

    return count


def _finisher(k: int, bound: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, own, lo, ids, scores, other in _cells(batches, bound):
            kth = lo[:, None].astype(scores.dtype)
            equal = (scores == kth) & other
            row, some = np.nonzero(((scores > kth) & other) | (equal & (np.cumsum(equal, axis=1) <= k)))
            yield _table([[np.full(len(row), block)], [row + at], [own[row]], [ids[some]], [scores[row, some]]], ["q_block", "slot", "query_id", "vec_id", "score"])

    return finish


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``.

    Both inputs are (vec_id long, v array<double>), as from ``integer_vectors``.
    """
    work = Workspace(vectors.sparkSession, "topk")
    stored, asked = blocks(vectors, work, "vectors"), blocks(queries, work, "queries")
    asked = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("matrix").alias("q_matrix"))

    # |score| <= product of norms; padded upwards before it bounds integers
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["matrix"]).reshape(-1, r["width"]) if r["width"] else np.zeros((0, 1))
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((m * m).sum(1)).max(initial=0.0))])], names=["m"])

    top = stored.select("width", "matrix").mapInArrow(norms, "m double").agg(F.max("m").alias("m")).first()["m"] or 0.0
    bound = top * top * (1 + 1e-9)
    limit = _LONG if bound >= _LONG else int(bound) + 1
    bytes_ = asked.agg(F.sum(F.octet_length("q_matrix"))).first()[0] or 0
    numbers = [r["q_block"] for r in asked.select("q_block").collect()]  # one a block of BLOCK queries
    # one row a query block: where its queries' intervals begin
    rows = F.octet_length("q_ids") / 8
    state = work.keep(asked.select("q_block", F.array_repeat(F.lit(-limit).cast("long"), rows.cast("int")).alias("lo")), "start")

    def cells(state: DataFrame) -> DataFrame:
        side = asked.join(state, "q_block")
        each = stored.select("ids", "width", "matrix", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>")).alias("q_block"))
        return each.join(F.broadcast(side) if bytes_ <= BROADCAST_BYTES else side, "q_block")

    shift = max(0, (2 * limit + 1).bit_length() - BINS.bit_length() + 1)
    while True:
        counts = cells(state).mapInArrow(_counter(k, shift, bound), "q_block long, slot long, bin long, n long")
        merged = counts.groupBy("q_block", "slot", "bin").agg(F.sum("n").alias("n")).groupBy("q_block", "slot").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        # the highest bin at which the count from the top reaches k; with fewer scores, the lowest
        walked = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("at")), lambda a, b: F.when(a["seen"] >= k, a).otherwise(F.struct((a["seen"] + b["n"]).alias("seen"), b["bin"].alias("at"))))
        chosen = merged.select("q_block", "slot", walked["at"].alias("bin")).groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bin"))).alias("bins"))
        # in two halves, so that no step leaves the long range
        step = lambda b: F.shiftleft(b, max(0, shift - 1))
        moved = lambda lo, b: lo + step(b) + (step(b) if shift else F.lit(0).cast("long"))
        at = lambda i: F.coalesce(F.try_element_at("bins", i.cast("long")), F.lit(0).cast("long"))
        state = work.keep(state.join(chosen, "q_block", "left").select("q_block", F.transform("lo", lambda lo, i: moved(lo, at(i))).alias("lo")), f"round{shift}")
        if not shift:
            break
        shift = max(0, shift - BINS.bit_length() + 1)

    hits = cells(state).mapInArrow(_finisher(k, bound), "q_block long, slot long, query_id long, vec_id long, score long")
    place = Window.partitionBy("q_block", "slot").orderBy(F.col("score").desc(), "vec_id")
    # the limit on the rank reaches below the shuffle: each task keeps k rows a query
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
