"""Convex stacking of any number of members, from one Gram aggregate a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simplex(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights w >= 0 that sum to one and minimise w'Gw - 2c'w, by an active set.

    The free members' problem has a linear solution; the step towards it stops
    where a weight would fall below zero, whose member is then fixed at zero; at
    its solution the member whose slope is lowest below the others' is freed.
    """
    n = len(cross)
    w, free = np.full(n, 1 / n), np.ones(n, bool)
    scale = max(1.0, float(np.abs(gram).max()))
    for _ in range(50 * n):
        k = int(free.sum())
        system = np.zeros((k + 1, k + 1))
        system[:k, :k], system[:k, k], system[k, :k] = gram[np.ix_(free, free)], 1, 1
        aim = np.zeros(n)
        aim[free] = np.linalg.lstsq(system, np.append(cross[free], 1.0), rcond=1e-13)[0][:k]
        down = free & (aim < -1e-15)
        if down.any():
            share = np.where(down, w / np.maximum(w - aim, 1e-300), np.inf)
            first = int(np.argmin(share))
            w = w + min(1.0, share[first]) * (aim - w)
            w[first], free[first] = 0.0, False
            continue
        w = aim
        slope = gram @ w - cross
        level = float(slope[free].mean())
        worst = int(np.argmin(np.where(free, np.inf, slope)))
        if free.all() or slope[worst] >= level - 1e-12 * scale:
            break
        free[worst] = True
    return np.maximum(w, 0) / np.maximum(w, 0).sum()


def stack(df: DataFrame, by: list[str], y: str, members: list[str], out_of_fold: str) -> DataFrame:
    """(by, n, weights, condition, rmse): weights in the order of ``members``; rows that lack one are left out.

    Members that were fitted on the rows they predict would be trusted for what
    they remember, so rows that are not out of fold are refused. A group is one
    row of sums, whatever its rows.
    """
    x = [F.col(m).cast("double") for m in members]
    if df.where(~F.coalesce(F.col(out_of_fold), F.lit(False))).head(1):
        raise ValueError("rows that were fitted on cannot be stacked")
    there = F.col(y).isNotNull()
    for m in members:
        there = there & F.col(m).isNotNull()
    n = len(members)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(c * F.col(y)).alias(f"c{i}") for i, c in enumerate(x)]
    grams = df.where(there).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).cast("double").alias("yy"), *[s.cast("double") for s in sums])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                gram = np.array([[getattr(r, f"g{min(i, j)}_{max(i, j)}") for j in range(n)] for i in range(n)])
                cross = np.array([getattr(r, f"c{i}") for i in range(n)])
                w = simplex(gram / r.n, cross / r.n)
                loss = max(0.0, float(w @ gram @ w - 2 * w @ cross + r.yy)) / r.n
                out.append((*[getattr(r, c) for c in by], int(r.n), w.tolist(), float(np.linalg.cond(gram)), loss**0.5))
            yield pd.DataFrame(out, columns=[*by, "n", "weights", "condition", "rmse"])

    kinds = "".join(f"`{c}` {grams.schema[c].dataType.simpleString()}, " for c in by)
    return grams.mapInPandas(solve, f"{kinds}n long, weights array<double>, condition double, rmse double")
