"""Calibration of market probabilities, and the test that decides whether a map is used.

Three kinds of maps. Isotonic regression pools adjacent violators on range
partitions, each by itself, and merges what they leave: between outcomes of 0
and 1 the lower hull of n rows has at most about 3 n^(2/3) corners, so the merge
sees hulls, never rows. Platt and beta maps are logistic regressions by Newton's
method; an iteration is one aggregate, two numbers a market go back. A map is
applied only if held-out log loss falls with a block-bootstrap bound above zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import log_loss
from ..sources.store import kept
from . import inference

INTERIOR = 1e-6
THIN_ROWS, THIN_VALUES = 200, 10
#: Stretches of [0, 1] by which probabilities meet the steps of a map.
BUCKETS = 1024


def points(df: DataFrame, by: list[str], p: str, y: str, weight: str | None = None) -> DataFrame:
    """(by, p, s, n): outcomes of equal probabilities together; rows without either are left out."""
    w = F.col(weight) if weight else F.lit(1)
    return df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(w * F.col(y)).cast("double").alias("s"), F.sum(w).cast("double").alias("n"))


def _pool(blocks: list[list[float]], lo: float, hi: float, s: float, n: float) -> None:
    """Adds a block at the right; blocks whose mean is not below their right neighbour's become one."""
    while blocks and blocks[-1][2] * n >= s * blocks[-1][3]:
        left = blocks.pop()
        lo, s, n = left[0], s + left[2], n + left[3]
    blocks.append([lo, hi, s, n])


def _pooled(by: list[str]):
    """Rows sorted by key and lo, in any batches: the pooled blocks of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blocks = None, []

        def out() -> pd.DataFrame:
            table = pd.DataFrame(blocks, columns=["lo", "hi", "s", "n"])
            for c, v in zip(by, key, strict=True):
                table[c] = pd.Series([v] * len(table), dtype=object)
            return table[[*by, "lo", "hi", "s", "n"]]

        for pdf in batches:
            for now, some in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                now = now if isinstance(now, tuple) else (now,)
                if key != now:
                    if blocks:
                        yield out()
                    key, blocks = now, []
                for row in some[["lo", "hi", "s", "n"]].itertuples(index=False):
                    _pool(blocks, *row)
        if blocks:
            yield out()

    return run


def isotonic(pts: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, value, n): the steps of the non-decreasing fit to (by, p, s, n); p rises from step to step."""
    kinds = ", ".join(f"{c} {pts.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}{', ' if by else ''}lo double, hi double, s double, n double"
    own = pts.select(*by, F.col("p").alias("lo"), F.col("p").alias("hi"), "s", "n")
    local = own.repartitionByRange(*by, "lo").sortWithinPartitions(*by, "lo").mapInPandas(_pooled(by), schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_pooled(by)(iter([pdf.sort_values("lo", kind="stable")])))

    merged = (local.groupBy(*by) if by else local.groupBy(F.lit(0))).applyInPandas(merge, schema)
    return merged.select(*by, "lo", "hi", F.greatest(F.lit(INTERIOR), F.least(F.lit(1 - INTERIOR), F.col("s") / F.col("n"))).alias("value"), "n")


def apply_steps(df: DataFrame, by: list[str], p: str, steps: DataFrame, name: str = "calibrated") -> DataFrame:
    """Adds the fit at ``p``: constant on a step, straight between steps, level beyond the ends; null without steps.

    A step is repeated for the stretches of [0, 1] it covers, so rows meet steps by key.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    cell = lambda c: F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(c * BUCKETS))).cast("int")


    w = Window.partitionBy(*by).orderBy("lo")
    side = steps.select(*by, "lo", "hi", "value", F.lead("lo").over(w).alias("__next"), F.lead("value").over(w).alias("__then"), F.row_number().over(w).alias("__i"))
    side = side.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.when(F.col("__i") == 1, -1.0).otherwise(F.col("lo")).alias("__lo"), F.col("hi").alias("__hi"), F.col("value").alias("__value"), F.coalesce("__next", F.lit(2.0)).alias("__next"), "__then")
    side = side.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__next")))))
    rows = df.withColumn("__p", F.col(p).cast("double")).withColumn("__cell", cell(F.col("__p")))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    met = rows.join(side.withColumnRenamed("__cell", "__at"), [*on, F.col("__cell") == F.col("__at"), F.col("__p") >= F.col("__lo"), F.col("__p") < F.col("__next")], "left")
    between = F.col("__value") + (F.col("__then") - F.col("__value")) * (F.col("__p") - F.col("__hi")) / (F.col("__next") - F.col("__hi"))
    value = F.when((F.col("__p") <= F.col("__hi")) | F.col("__then").isNull(), F.col("__value")).otherwise(between)
    return met.withColumn(name, value).select(*df.columns, name)


def logit(p: Column) -> Column:
    x = F.greatest(F.lit(INTERIOR), F.least(F.lit(1 - INTERIOR), p))
    return F.ln(x / (1 - x))


def logistic(pts: DataFrame, by: list[str], x: Column, penalty: float, iterations: int = 25) -> DataFrame:
    """(by, a, b, converged): y ~ 1 / (1 + exp(-a - b x)) of weighted points, ridge on b alone, by Newton's method.

    One aggregate an iteration; the driver sees a row a key, the number of
    which (markets) is bounded.
    """
    spark, rows = pts.sparkSession, pts.select(*by, x.alias("x"), "s", "n")
    theta = {tuple(r): (0.0, 0.0, False) for r in rows.select(*by).distinct().collect()}
    kinds = ", ".join(f"{c} {pts.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}{', ' if by else ''}a double, b double, converged boolean"
    table = lambda: spark.createDataFrame([(*k, *v) for k, v in theta.items()], schema)
    for _ in range(iterations):
        if not theta or all(v[2] for v in theta.values()):
            break
        both = rows.join(F.broadcast(table()), by) if by else rows.crossJoin(F.broadcast(table()))
        q = 1 / (1 + F.exp(-F.col("a") - F.col("b") * F.col("x")))
        w = F.col("n") * q * (1 - q)
        e = F.col("s") - F.col("n") * q
        sums = both.groupBy(*by).agg(*[F.sum(c).alias(f"m{i}") for i, c in enumerate((e, e * F.col("x"), w, w * F.col("x"), w * F.col("x") * F.col("x")))])
        for r in sums.collect():
            key = tuple(r[c] for c in by)
            a, b, _done = theta[key]
            h = np.array([[r.m2, r.m3], [r.m3, r.m4 + penalty]]) + 1e-12 * np.eye(2)
            da, db = map(float, np.linalg.solve(h, [r.m0, r.m1 - penalty * b]))
            size = max(1.0, abs(da) / 4, abs(db) / 4)  # no step beyond the range where it is trusted
            theta[key] = (a + da / size, b + db / size, bool(max(abs(da), abs(db)) < 1e-10))
    return table()


def cox(pts: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, converged): intercept and slope of the outcome on the logit; 0 and 1 where calibrated."""
    return logistic(pts, by, logit(F.col("p")), 1e-12)


def platt(pts: DataFrame, by: list[str]) -> DataFrame:
    return logistic(pts, by, F.col("p"), 1.0)


def beta(pts: DataFrame, by: list[str]) -> DataFrame:
    """As cox, but the identity where the slope is not above zero."""
    fit = cox(pts, by)
    good = F.col("converged") & (F.col("b") > 0)
    return fit.withColumns({"a": F.when(good, F.col("a")).otherwise(0.0), "b": F.when(good, F.col("b")).otherwise(1.0)})


def kinds(pts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, kind): isotonic if there are rows, values and rows a bin enough, else platt; none if all outcomes agree or rows are under four."""
    all_ = pts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count_distinct(F.round("p", 6)).alias("values"))
    least = F.greatest(F.lit(50), F.floor(F.col("n") / 20))
    all_ = all_.withColumn("least", least).withColumn("bins", F.greatest(F.lit(2), F.least(F.lit(20), F.floor(F.col("n") / F.col("least")))))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    cells = pts.alias("a").join(F.broadcast(all_.alias("b")), on) if by else pts.alias("a").crossJoin(F.broadcast(all_.alias("b")))
    cell = F.least(F.col("bins") - 1, F.floor(F.col("p") * F.col("bins")))
    full = cells.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], cell.alias("cell")).agg(F.sum("a.n").alias("m")).groupBy(*by).agg(F.min("m").alias("fewest"))
    both = all_.join(full, by) if by else all_.crossJoin(full)
    thin = (F.col("n") < THIN_ROWS) | (F.col("values") < THIN_VALUES) | (F.col("fewest") < F.col("least"))
    kind = F.when((F.col("n") < 4) | (F.col("s") <= 0) | (F.col("s") >= F.col("n")), "none").when(thin, "platt").otherwise("isotonic")
    return both.select(*by, F.col("n").cast("long").alias("n"), kind.alias("kind"))


class Calibrators:
    """Maps of several markets: fitted on out-of-fold rows, kept as tables, applied where the gate let them."""

    def __init__(self, train: DataFrame, market: str, p: str, y: str, out_of_fold: str) -> None:
        if train.where(~F.coalesce(F.col(out_of_fold), F.lit(False))).head(1):
            raise ValueError("rows that were fitted on cannot calibrate")
        self.market, self.p, self.y, by = market, p, y, [market]
        self.points = kept(points(train, by, p, y))
        self.kinds = kept(kinds(self.points, by))
        chosen = lambda kind: self.points.join(F.broadcast(self.kinds.where(F.col("kind") == kind).select(market)), market, "left_semi")
        self.steps = kept(isotonic(chosen("isotonic"), by))
        self.platt = kept(platt(chosen("platt"), by))
        self.gates: DataFrame | None = None

    def transform(self, df: DataFrame, name: str = "calibrated") -> DataFrame:
        """Adds the map's value, whether or not the gate let it; the probability itself where there is no map."""
        rows = apply_steps(df, [self.market], self.p, self.steps, "__iso")
        rows = rows.join(F.broadcast(self.platt.select(self.market, F.col("a").alias("__a"), F.col("b").alias("__b"))), self.market, "left")
        value = F.coalesce(F.col("__iso"), 1 / (1 + F.exp(-F.col("__a") - F.col("__b") * F.col(self.p))), F.col(self.p))
        return rows.withColumn(name, value).select(*df.columns, name)

    def gate(self, held_out: DataFrame, block: list[str], replicates: int = 500, alpha: float = 0.10, seed: str = "gate") -> DataFrame:
        """(market, kind, n, delta, low, high, applied): held-out log loss of no map less that of the map, by whole blocks."""
        rows = self.transform(held_out.where(F.col(self.y).isNotNull() & F.col(self.p).isNotNull()))
        gain = log_loss(F.col(self.p), F.col(self.y)) - log_loss(F.col("calibrated"), F.col(self.y))
        found = inference.block_bootstraps(rows, [self.market], block, gain, replicates, seed, 1 - alpha)
        self.gates = kept(self.kinds.select(self.market, "kind").join(found, self.market).withColumn("applied", (F.col("low") > 0) & (F.col("kind") != "none")))
        return self.gates

    def apply(self, df: DataFrame, name: str = "calibrated") -> DataFrame:
        """Adds the map's value where the gate let it, else the probability."""
        if self.gates is None:
            raise ValueError("no gate has been run")
        let = F.broadcast(self.gates.select(F.col(self.market), F.col("applied").alias("__let")))
        rows = self.transform(df, "__map").join(let, self.market, "left")
        return rows.withColumn(name, F.when(F.coalesce("__let", F.lit(False)), F.col("__map")).otherwise(F.col(self.p))).select(*df.columns, name)
