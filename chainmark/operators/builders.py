"""The contract of feature builders, and materialisation of what is not there yet.

A builder sees history only through ``History.before``, so nothing at or after
the bound can reach it; its output is checked against what it declared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof


class History:
    """Tables cut at an instant; each has a column that says when a row was knowable."""

    def __init__(self, tables: dict[str, DataFrame], known_at: dict[str, str], bound: Column) -> None:
        self._tables, self._known_at, self.bound = tables, known_at, bound

    def before(self, name: str) -> DataFrame:
        """Rows known strictly before the bound."""
        if name not in self._tables:
            raise KeyError(f"unknown table {name}")
        return self._tables[name].where(F.col(self._known_at[name]) < self.bound)

    def join_latest(self, left: DataFrame, name: str, keys: list[str], left_ts: str, tie: str) -> DataFrame:
        """The only join of entities inside a builder: the latest row before each left row, and before the bound."""
        return asof.asof_join(left, self.before(name), keys, left_ts, self._known_at[name], tie)


@dataclass(frozen=True)
class Builder:
    """``build`` makes (keys, features) from a history; a null policy is forbid, allow or indicator."""

    name: str
    keys: tuple[str, ...]
    build: Callable[[History], DataFrame]
    features: dict[str, str] = field(default_factory=dict)

    def run(self, history: History) -> DataFrame:
        """The declared columns only; forbidden nulls fail when they are read, indicators are added."""
        rows = self.build(history)
        if missing := [c for c in (*self.keys, *self.features) if c not in rows.columns]:
            raise ValueError(f"{self.name} lacks {', '.join(missing)}")
        out = []
        for c, policy in self.features.items():
            fail = F.raise_error(F.lit(f"{self.name}: {c} is null")).cast(rows.schema[c].dataType)
            out.append(F.when(F.col(c).isNull(), fail).otherwise(F.col(c)).alias(c) if policy == "forbid" else F.col(c))
            if policy == "indicator":
                out.append(F.col(c).isNull().alias(f"{c}_is_missing"))
        return rows.select(*self.keys, *out)


def new_rows(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a materialisation has still to compute: units without a stored row. Run again after a stop, it goes on."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def stale(units: DataFrame, sources: DataFrame, keys: list[str], built: str, changed: str) -> DataFrame:
    """(units, stale): units whose newest source row is later than when they were built, or that were never built."""
    newest = sources.groupBy(*keys).agg(F.max(changed).alias("__c"))
    return units.join(newest, keys, "left").withColumn("stale", F.coalesce(F.col(built) < F.col("__c"), F.col(built).isNull())).drop("__c")
