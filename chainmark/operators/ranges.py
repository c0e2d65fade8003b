"""Ordered computations over keys of any size: range parts, then small tables of parts.

A window over a key puts the key's rows into one task. Here rows are dealt to
range parts of (keys, order); a part is as large as a shuffle partition, however
large its key. What crosses parts (counts, sums, peaks, states) is one row a
key and part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import kept

PART = "__part"
#: Rows of a part, about; more rows make more parts, not larger ones.
ROWS = 250_000


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with PART: of two rows of a key the one in the lower part comes first; ties may lie in either."""
    by, n = [*keys, *order], -(-df.count() // ROWS)
    more = [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return kept(df.repartitionByRange(*more, *by).withColumn(PART, F.spark_partition_id()), "ranged")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of ``ranged`` with each part in one task, and as many tasks as parts."""
    return rows.repartition((rows.agg(F.max(PART)).first()[0] or 0) + 1, PART)


def _before(parts: DataFrame, keys: list[str], how: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a key and part
    return parts.withColumns({n: c.over(w) for n, c in how.items()})


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    names = {c: f"__s_{c}" for c in [*keys, PART]}
    side = side.select(*[F.col(c).alias(n) for c, n in names.items()], *columns)
    return rows.join(side, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Adds the row's number in its key's order, from 0; the order must be total."""
    rows = ranged(df, keys, order)
    counts = _before(rows.groupBy(*keys, PART).agg(F.count("*").alias("__n")), keys, {"__before": F.sum("__n")})
    own = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order)) - 1
    met = _joined(dealt(rows).withColumn("__own", own), counts, keys, ["__before"])
    return met.withColumn(name, (F.coalesce("__before", F.lit(0)) + F.col("__own")).cast("long")).select(*df.columns, name)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the row itself included; nulls count as zero."""
    rows = ranged(df.withColumns({f"__v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}), keys, order)
    parts = rows.groupBy(*keys, PART).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = _before(parts, keys, {f"__b_{n}": F.sum(f"__t_{n}") for n in sums})
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = _joined(dealt(rows).withColumns({f"__w_{n}": F.sum(f"__v_{n}").over(w) for n in sums}), before, keys, [f"__b_{n}" for n in sums])
    return met.withColumns({n: F.coalesce(f"__b_{n}", F.lit(0.0)) + F.col(f"__w_{n}") for n in sums}).select(*df.columns, *sums)


def highest(df: DataFrame, keys: list[str], order: list[str], value: str, least: float, name: str) -> DataFrame:
    """Adds the greatest value so far, the row itself included, and at least ``least``."""
    rows = ranged(df, keys, order)
    before = _before(rows.groupBy(*keys, PART).agg(F.max(value).alias("__m")), keys, {"__high": F.max("__m")})
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = _joined(dealt(rows).withColumn("__own", F.max(value).over(w)), before, keys, ["__high"])
    return met.withColumn(name, F.greatest(F.lit(least), F.col("__own"), F.col("__high"))).select(*df.columns, name)


def path(df: DataFrame, keys: list[str], order: list[str], change: Column) -> DataFrame:
    """(keys, final, fall): where a path of changes from 0 ends, and its greatest fall from an earlier height.

    A part is known by its sum, its greatest and least height and its own
    greatest fall; parts are put together without reading rows again.
    """
    rows = dealt(ranged(df.select(*keys, *[c for c in order if c not in keys], F.coalesce(change.cast("double"), F.lit(0.0)).alias("__d")), keys, order))
    w = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__h", F.sum("__d").over(w)).withColumn("__top", F.greatest(F.lit(0.0), F.max("__h").over(w)))
    parts = rows.groupBy(*keys, PART).agg(F.sum("__d").alias("__sum"), F.max("__h").alias("__most"), F.min("__h").alias("__least"), F.max(F.col("__top") - F.col("__h")).alias("__fall"))
    placed = _before(parts, keys, {"__at": F.sum("__sum")}).withColumn("__at", F.coalesce("__at", F.lit(0.0)))
    placed = placed.withColumn("__peak", F.col("__at") + F.col("__most"))
    peaked = _before(placed, keys, {"__high": F.max("__peak")})
    fall = F.greatest("__fall", F.greatest(F.lit(0.0), F.coalesce("__high", F.lit(0.0))) - F.col("__at") - F.col("__least"))
    return peaked.groupBy(*keys).agg(F.sum("__sum").alias("final"), F.max(fall).alias("fall"))


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, start: int, table: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Adds the state after each row of a machine with few states.

    ``table(values)`` has a row per value: the next state from each state. A key's
    rows in a part are one map from states to states, so parts are folded by
    themselves, the maps of a key in order, and then each part again from the
    states its keys begin in. A group is a part, which may hold many keys.
    """
    rows = ranged(df, keys, order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, PART])

    def placed(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Rows by key and order, and where each key's begin."""
        code = pdf.groupby(keys, dropna=False, sort=False).ngroup() if keys else 0
        pdf = pdf.assign(__code=code).sort_values(["__code", *order], kind="stable", na_position="first")
        edges = np.flatnonzero(np.diff(pdf["__code"].to_numpy(), prepend=-1))
        return pdf.drop(columns="__code"), edges

    def steps(values: np.ndarray) -> Iterator[list[int]]:
        for i in range(0, len(values), 1 << 16):
            yield from table(values[i : i + (1 << 16)]).tolist()

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = placed(pdf)
        begins, out, now = set(edges.tolist()), [], []
        for i, step in enumerate(steps(pdf[value].to_numpy(float))):
            if i in begins:
                out.append(now := list(step))
            else:
                now[:] = [step[s] for s in now]
        return pdf.iloc[edges][[*keys, PART]].assign(__map=out)

    maps = rows.select(*keys, PART, *[c for c in dict.fromkeys((*order, value)) if c not in keys]).groupBy(PART).applyInPandas(whole, f"{head}, __map array<int>")
    # a key's parts in order: the state that each begins in
    link = lambda a, m: F.struct(F.get(m["__map"], a["now"]).alias("now"), F.concat(a["begins"], F.array(F.struct(m[PART].alias(PART), a["now"].alias("__begin")))).alias("begins"))
    empty = F.struct(F.lit(start).alias("now"), F.array().cast(f"array<struct<{PART}:int,__begin:int>>").alias("begins"))
    folded = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(PART, "__map"))).alias("maps"))
    starts = kept(folded.select(*keys, F.inline(F.aggregate("maps", empty, link)["begins"])), "starts")

    def states(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = placed(pdf)
        first = pdf.iloc[edges][keys].merge(starts, on=keys, how="left") if keys else starts
        begin, out, now = dict(zip(edges.tolist(), first["__begin"].astype(int).tolist(), strict=True)), [], 0
        for i, step in enumerate(steps(pdf[value].to_numpy(float))):
            now = step[begin.get(i, now)]
            out.append(now)
        return pdf.drop(columns=PART).assign(**{name: np.array(out, np.int32)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.groupBy(PART).cogroup(starts.groupBy(PART)).applyInPandas(states, f"{schema}, {name} int")
