"""Mixing sources to target weights by entropy balancing.

Targets: the sources share all words by weight; a target stops at ``cap`` times
its source's words and the excess is shared again by weight. Rates: among all
rates with the target as their token total, those closest to one in relative
entropy are ``exp(lambda * size / mean size)``, at most ``cap``. The dual is
convex with one multiplier a source; damped Newton steps solve it, each a
distributed aggregate over the (source, size) histogram. Rounding: within
bounded buckets of a source, from long documents to short, each takes the
number of copies nearest to its rate plus the words still owed. Rows that
repeat id, source and size are counted first and dealt to buckets in lots of at
most BUCKET, so no bucket grows with a hot id.

Defined cases: null text has size 0 and takes nothing; a null source is a
source of its own, ranked last; repeated rows and null ids are rows like any
other; an empty table gives no rows. Ties are ordered by hash, so reruns agree.
Texts of any length are only counted; columns other than id, text and source are
not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that are rounded together.
BUCKET = 512
TOLERANCE, ROUNDS = 1e-9, 60


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, n, words): one row a source, by water-filling.

    The windows below run in one task over one row of five numbers a source;
    ten million sources would take it about a gigabyte.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    most = F.col("words") * F.lit(float(cap))
    rows = sources.withColumn("weight", weight).withColumn("full_at", most / F.col("weight"))
    all_, before = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("words").over(all_) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # sources fill up in order of full_at; the level is that of the first that does not, and falls after it
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_))
    target = F.when(F.col("level").isNull(), most).otherwise(F.least(most, F.col("level") * F.col("weight")))
    return rows.select("source", "n", "words", target.alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.exp(F.least(multiplier * size / mean, F.lit(math.log(cap))))


def multipliers(histogram: DataFrame, sources: DataFrame, work: Workspace, cap: float = 3.0) -> DataFrame:
    """(source, n, words, target, mean, multiplier): the dual solved by Newton steps."""
    mean, start = F.greatest(F.col("words") / F.col("n"), F.lit(1e-9)), F.log(F.col("target") / F.col("words"))
    done = (F.col("words") == 0) | (F.col("target") >= F.col("words") * cap)
    state = sources.select("source", "n", "words", "target", mean.alias("mean"), F.when(F.col("words") == 0, 0.0).when(done, 1e18).otherwise(start).alias("multiplier"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), done.alias("done"))
    state = work.keep(state, "dual0")
    for i in range(ROUNDS):
        if not state.where(~F.col("done")).limit(1).count():
            break
        h = histogram.withColumnRenamed("source", "of").join(state.where(~F.col("done")), F.col("of").eqNullSafe(F.col("source")))
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
        slope = F.when(F.col("multiplier") * F.col("size") / F.col("mean") < math.log(cap), F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)
        sums = h.groupBy("source", "n", "words", "target", "mean", "multiplier", "low", "high").agg(F.sum(F.col("docs") * F.col("size") * rate).alias("got"), F.sum(F.col("docs") * slope).alias("slope"))
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        inside = F.coalesce((F.col("got") > 0) & (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), F.lit(False))
        # within the bracket Newton's step on the logarithm, else the bracket's middle
        sums = sums.withColumns({"low": low, "high": high})
        near = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = sums.select("source", "n", "words", "target", "mean", F.when(near, F.col("multiplier")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("multiplier"), "low", "high", near.alias("done"))
        state = work.keep(state.where("done").unionByName(moved), f"dual{i + 1}")
    return state.select("source", "n", "words", "target", "mean", "multiplier")


def _rounded(pdf: pd.DataFrame, cap: int) -> np.ndarray:
    owed, copies = 0.0, np.zeros(len(pdf), np.int64)
    for i, (size, rate) in enumerate(zip(pdf["size"].tolist(), pdf["rate"].tolist(), strict=True)):
        if size:
            copies[i] = k = min(cap, max(0, math.floor(rate + owed / size + 0.5)))
            owed += (rate - k) * size
    return copies


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = work.keep(rows, "sizes")
    histogram = work.keep(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("words"))
    dual = multipliers(histogram, work.keep(targets(sources, weights, cap), "targets"), work, cap)
    dual = dual.withColumnRenamed("source", "of")
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    lots = counted.select("doc_id", "source", "size", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BUCKET))).alias("lot"))
    lots = lots.select("doc_id", "source", "size", F.least(F.lit(BUCKET).cast("long"), F.col("rows") - F.col("lot") * BUCKET).alias("rows"), F.xxhash64("doc_id", "size", "lot").alias("order"))
    rated = lots.join(dual, F.col("of").eqNullSafe(F.col("source"))).withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("mean"), cap))
    rated = rated.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", "order", "rows", F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / BUCKET)).alias("bucket"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        pdf = pdf.loc[pdf.index.repeat(pdf["rows"])].reset_index(drop=True)
        pdf["copies"] = _rounded(pdf, cap)
        pdf["taken"] = pdf["copies"] * pdf["size"]
        return pdf[["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken"]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return rated.groupBy("source", "bucket").applyInPandas(whole, f"doc_id {kind}, source string, size long, source_size long, target double, rate double, copies long, taken long")
