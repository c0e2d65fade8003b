"""Connected components of an edge table by alternating star contractions.

Every round hangs each node's larger neighbours on its smallest one (large
star), then its smaller neighbours on the smallest of them (small star), until
every edge leads to the smallest node of its component. All of it is joins and
map-side combined minima over the edge table, written between rounds; a node
with very many edges is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(u, v): for every node but the smallest of its component, that smallest one.

    ``edges`` is (a, b) of longs without nulls; loops and repeats do no harm.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, seen, i = work.keep(state, f"{name}0"), None, 0
    while True:
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return state
        seen, i = mark, i + 1
        wide = work.keep(_large(state).distinct(), f"{name}{i}a")
        work.drop(f"{name}{i - 1}")
        state = work.keep(_small(wide).distinct(), f"{name}{i}")
        work.drop(f"{name}{i}a")
