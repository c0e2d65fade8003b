"""Row filters, coercions, alignment and checks across tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

# Texts that stand for a missing reason.
SENTINELS = ("", "nan", "none", "null", "<na>")


def kickoff_filter(df: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """Rows at or after the instant; ``excluded`` counts the others in every row kept (0 rows kept: none to carry it)."""
    counted = df.agg(F.count_if(F.col(ts) < as_of).alias("excluded"))
    return df.where(F.col(ts) >= as_of).crossJoin(F.broadcast(counted))  # one row


def prior_rows(df: DataFrame, columns: list[str], bound: list[int]) -> DataFrame:
    """Rows strictly before the bound in lexicographic order, as (season, week) before (2023, 4)."""
    return df.where(F.struct(*[F.col(c).cast("long") for c in columns]) < F.struct(*[F.lit(b).cast("long") for b in bound]))


def present(reason: Column) -> Column:
    """The text, null if it only says that there is none."""
    return F.when(~F.lower(F.trim(reason)).isin(*SENTINELS), reason)


def scored(df: DataFrame, continuity: str, warm_up: str, reason: str) -> DataFrame:
    """Rows that count: no continuity rows, no warm-up, no reason for a null."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return df.where(no(continuity) & no(warm_up) & present(F.col(reason)).isNull())


def lockbox(df: DataFrame, season: str, locked: list[int], confirmatory: bool = False) -> DataFrame:
    """Refuses rows of locked seasons when they are read, unless the run confirms."""
    if confirmatory:
        return df
    return df.withColumn(season, F.when(F.col(season).isin(locked), F.raise_error(F.lit(f"{season} is locked")).cast(df.schema[season].dataType)).otherwise(F.col(season)))


def same_side(side: Column, name: Column) -> Column:
    return F.lower(F.trim(side)) == F.lower(F.trim(name))


def defaults(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Fills nulls, and adds columns that are not there."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in values.items()})


def in_range(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def sparse_columns(df: DataFrame, columns: list[str], limit: float) -> list[str]:
    """Columns whose share of nulls exceeds the limit; one aggregate."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > limit]


def drop_sparse(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    return df.drop(*sparse_columns(df, columns, limit))


def named_paths(kind: DataType, names: set[str], at: str = "") -> list[str]:
    """Where fields of these names lie in a schema, nested ones included."""
    if isinstance(kind, ArrayType):
        return named_paths(kind.elementType, names, at)
    if not isinstance(kind, StructType):
        return []
    out = []
    for f in kind.fields:
        path = f"{at}.{f.name}".lstrip(".")
        out += ([path] if f.name in names else []) + named_paths(f.dataType, names, path)
    return out


def publishable(df: DataFrame, allowed: set[str], denied: set[str]) -> DataFrame:
    """The frame, if its columns are all allowed and no field at any depth is denied."""
    if unknown := sorted(set(df.columns) - allowed):
        raise ValueError(f"columns not allowed: {', '.join(unknown)}")
    if found := named_paths(df.schema, denied):
        raise ValueError(f"denied fields: {', '.join(found)}")
    return df


def no_nans(df: DataFrame) -> DataFrame:
    """NaN as null in every column, nested ones included."""

    def clean(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def sorted_quantiles(*columns: Column) -> Column:
    """Row-wise quantiles in ascending order, as an array."""
    return F.array_sort(F.array(*columns))


def interval_hit(y: Column, low: Column, high: Column) -> Column:
    return F.when(y.isNotNull() & low.isNotNull() & high.isNotNull(), y.between(low, high).cast("int"))


def require_one(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every left row with the last right row of its key; a left row without one is an error when it is read."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in right.columns if c not in keys]), F.struct(*order)).alias("__r"))
    both = left.join(last, keys, "left")
    fail = F.raise_error(F.concat(F.lit("no feature row for "), F.concat_ws(":", *[F.col(k).cast("string") for k in keys])))
    return both.withColumn("__r", F.when(F.col("__r").isNull(), fail.cast(both.schema["__r"].dataType)).otherwise(F.col("__r"))).select(*left.columns, "__r.*")


def reconcile(left: DataFrame, right: DataFrame, game: str, book: str, value: str) -> DataFrame:
    """(game, basis, n, gap): mean gap over shared books, else the gap of the medians; a game on one side only has none."""
    side = lambda df, name: df.select(game, F.lower(book).alias("__b"), F.col(value).alias(name))
    both = side(left, "__x").join(side(right, "__y"), [game, "__b"], "full")
    shared = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    sums = both.groupBy(game).agg(F.count_if(shared).alias("n"), F.avg(F.when(shared, F.col("__x") - F.col("__y"))).alias("__s"), (F.median("__x") - F.median("__y")).alias("__m"))
    basis = F.when(F.col("n") > 0, "books").when(F.col("__m").isNotNull(), "medians").otherwise("one_sided")
    return sums.select(game, basis.alias("basis"), "n", F.coalesce("__s", "__m").alias("gap"))


def consensus(df: DataFrame, keys: list[str], book: str, value: str, row: str) -> DataFrame:
    """(keys, line, n_books, source_row): the median and the first row (by book, id) that quotes it, null if none does."""
    lines = df.where(F.col(value).isNotNull())
    middle = lines.groupBy(*keys).agg(F.median(value).alias("line"), F.countDistinct(book).alias("n_books"))
    names = [f"__k{i}" for i in range(len(keys))]
    side = middle.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("line").alias("__m"))
    hits = lines.join(side, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]).where(F.col(value).cast("double") == F.col("__m"))
    first = hits.groupBy(*names).agg(F.min(F.struct(F.col(book).isNotNull(), book, row))[row].alias("source_row"))
    met = middle.join(first, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left")
    return met.select(*keys, "line", "n_books", "source_row")


def nth_of_season(keys: list[str], season: str, order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys, season).orderBy(*order))


def falls(value: str, keys: list[str], order: list[str]) -> Column:
    """Whether a value that should never fall is less than the one before."""
    return F.coalesce(F.col(value) < F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(False))


def split_key(key: Column) -> tuple[Column, Column]:
    """(game, team) of ``game:team``; null parts where the key has another form."""
    fine = key.rlike("^[0-9]+:.+$")
    return F.when(fine, F.substring_index(key, ":", 1).try_cast("long")), F.when(fine, F.regexp_extract(key, "^[0-9]+:(.+)$", 1))


def feature_hash(names: list[str]) -> str:
    """12 hexadecimal digits that change with any name and with their order."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()[:12]


def same_signature(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """The frame, if its columns have these names and types in this order."""
    if df.dtypes != names:
        raise ValueError(f"expected {names}, got {df.dtypes}")
    return df


def temporal_checks(df: DataFrame, event: str, ingested: str, done: Column, as_of: Column, scores: list[str]) -> DataFrame:
    """(check, n, failures): known before it was ingested (completed rows), nothing after the bound, no negative score."""
    negative = F.lit(False)
    for c in scores:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    checks = {"event_before_ingest": done & (F.col(event) > F.col(ingested)), "not_after_bound": F.col(event) > as_of, "no_negative_score": negative}
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    return sums.select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in checks]))).select("check", "n", "failures")


def totals_agree(parts: DataFrame, whole: DataFrame, keys: list[str], part: str, total: str, within: float = 0.0) -> DataFrame:
    """(keys, parts, total, agrees): drives against the final score, or box rows against the game; orphans never agree."""
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("parts"))
    both = sums.join(whole.select(*keys, F.col(total).alias("total")), keys, "full")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("parts") - F.col("total")) <= within, F.lit(False)))


def moved_far(df: DataFrame, keys: list[str], kind: str, value: str, limit: float) -> DataFrame:
    """(keys, move) of lines whose close is at least ``limit`` from their opening; one aggregate, no join."""
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))
    return df.groupBy(*keys).agg((at("close") - at("open")).alias("move")).where(F.abs("move") >= limit)


def inert(df: DataFrame, registered: list[str]) -> DataFrame:
    """(feature, status) of registered features that are not there, all null, or of one value."""
    there = [c for c in registered if c in df.columns]
    sums = df.agg(*[x for c in there for x in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"))], F.lit(1).alias("__one"))
    status = lambda c: F.when(F.col(f"{c}__n") == 0, "all_null").when(F.col(f"{c}__d") < 2, "constant").otherwise("live") if c in there else F.lit("missing")
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), status(c).alias("status")) for c in registered])))
