"""Constraint suites, partition status and audits: one aggregate pass a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row passes if ``holds`` is true; ``mostly`` is the share that has to."""

    name: str
    holds: Column
    severity: str = "fail"
    mostly: float = 1.0


def not_null(column: str, mostly: float = 1.0, severity: str = "fail") -> Rule:
    return Rule(f"{column} not null", F.col(column).isNotNull(), severity, mostly)


def between(column: str, low: float, high: float, severity: str = "fail") -> Rule:
    return Rule(f"{column} between {low} and {high}", F.col(column).isNull() | F.col(column).between(low, high), severity)


def in_set(column: str, values: list, severity: str = "fail") -> Rule:
    return Rule(f"{column} in set", F.col(column).isNull() | F.col(column).isin(values), severity)


def greater(column: str, other: str, severity: str = "fail") -> Rule:
    return Rule(f"{column} > {other}", F.col(column).isNull() | F.col(other).isNull() | (F.col(column) > F.col(other)), severity)


def exact_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame, if it has these columns and no others."""
    if set(df.columns) != set(names):
        raise ValueError(f"columns differ: {', '.join(sorted(set(df.columns) ^ set(names)))}")
    return df


def unique(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Rule]:
    """Adds a count over the key; the rule holds where it is one."""
    name = "__n_" + "_".join(keys)
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys))), Rule("unique " + ", ".join(keys), F.col(name) == 1)


def report(df: DataFrame, rules: list[Rule], by: list[str] | None = None) -> DataFrame:
    """(by, rule, severity, n, failures, passed): all rules in one scan."""
    counts = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"f{i}") for i, r in enumerate(rules)]
    sums = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *counts)
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"f{i}").alias("failures"), F.lit(1 - r.mostly).alias("slack")) for i, r in enumerate(rules)])
    rows = sums.select(*(by or []), "n", F.explode(each).alias("r"))
    return rows.select(*(by or []), F.col("r.rule").alias("rule"), F.col("r.severity").alias("severity"), "n", F.col("r.failures").alias("failures"), (F.col("r.failures") <= F.col("n") * F.col("r.slack")).alias("passed"))


def partition_status(results: DataFrame, by: list[str]) -> DataFrame:
    """Any failed fail-rule quarantines a partition, any failed flag-rule flags it."""
    rank = F.when(F.col("passed"), 0).when(F.col("severity") == "fail", 2).otherwise(1)
    worst = results.groupBy(*by).agg(F.max(rank).alias("__w"), F.sum(F.when(~F.col("passed"), F.col("failures")).otherwise(0)).alias("failures"))
    return worst.select(*by, F.when(F.col("__w") == 2, "QUARANTINED").when(F.col("__w") == 1, "FLAGGED").otherwise("PASSED").alias("status"), "failures")


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of the rules they break)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    tagged = df.withColumn("reasons", broken)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def frames_differ(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, reason) of rows that are missing on one side or differ beyond the tolerance.

    For point-in-time audits: left as stored, right as recomputed with history
    cut at the bound.
    """
    a = left.select(*keys, F.struct(*values).alias("__a"))
    b = right.select(*keys, F.struct(*values).alias("__b"))
    apart = F.lit(False)
    for v in values:
        x, y = F.col(f"__a.{v}"), F.col(f"__b.{v}")
        apart = apart | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x.cast("double") - y.cast("double")) > tolerance, F.lit(False))
    reason = F.when(F.col("__a").isNull(), "appeared").when(F.col("__b").isNull(), "vanished").when(apart, "changed")
    return a.join(b, keys, "full").select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())


def null_gates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, null_share, span, sd, constant): one aggregate for every numeric column."""
    sums = df.agg(*[x for c in columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__n"), (F.max(c) - F.min(c)).cast("double").alias(f"{c}__s"), F.stddev_pop(c).alias(f"{c}__d"))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").alias("null_share"), F.col(f"{c}__s").alias("span"), F.col(f"{c}__d").alias("sd")) for c in columns])
    return sums.select(F.inline(each)).withColumn("constant", ~F.coalesce(F.col("span") > 0, F.lit(False)))


def leaks(df: DataFrame, features: list[str], label: str, limit: float = 0.99) -> DataFrame:
    """(feature, correlation, leaks): features that know the label too well."""
    sums = df.agg(*[F.corr(c, label).alias(c) for c in features])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in features])
    return sums.select(F.inline(each)).withColumn("leaks", F.coalesce(F.abs("correlation") > limit, F.lit(False)))
