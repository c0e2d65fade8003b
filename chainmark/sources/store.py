"""Partitioned Parquet tables: pruned reads, partition overwrites, upserts, quarantine.

A write replaces only the partitions it has rows for (dynamic partition
overwrite), so a repeated write of the same rows is a no-op in content.
Partition filters prune directories and other filters reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import quality


def scratch(spark: SparkSession) -> str:
    """A shared folder for tables that a query writes; a local one only for sessions of one machine that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (named or "file://" + tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """A work table's folder goes when the session's process ends: frames that are returned may read it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The frame written below the shared folder and read back: its lineage ends there, and later steps read it instead of computing it again."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/chainmark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class TableSpec:
    """Columns as DDL, partition columns among them, and the columns that identify a row."""

    name: str
    columns: str
    partition: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


class Store:
    """Tables below ``root``; unknown tables and columns are refused when the plan is built."""

    def __init__(self, spark: SparkSession, root: str, specs: list[TableSpec]) -> None:
        self.spark, self.root, self.specs = spark, root.rstrip("/"), {s.name: s for s in specs}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def spec(self, name: str) -> TableSpec:
        if name not in self.specs:
            raise KeyError(f"unknown table {name}")
        return self.specs[name]

    def read(self, name: str, **filters: object) -> DataFrame:
        """Rows whose columns equal a value or lie in a list; a table never written is empty."""
        spec = self.spec(name)
        names = [f.name for f in spec.schema]
        if unknown := [c for c in filters if c not in names]:
            raise KeyError(f"{name} has no column {', '.join(unknown)}")
        if self._exists(self._path(name)):
            rows = self.spark.read.schema(spec.schema).parquet(self._path(name)).select(*names)
        else:
            rows = self.spark.createDataFrame([], spec.schema)
        for c, want in filters.items():
            rows = rows.where(F.col(c).isin(list(want)) if isinstance(want, (list, tuple, set, range)) else F.col(c) == F.lit(want))
        return rows

    def seasons(self, name: str, first: int, last: int, column: str = "season") -> DataFrame:
        return self.read(name, **{column: range(first, last + 1)})

    def register(self) -> None:
        """Every table as a temporary view, for SQL."""
        for name in self.specs:
            self.read(name).createOrReplaceTempView(name)

    def _touched(self, rows: DataFrame, name: str) -> DataFrame:
        """Stored rows of the partitions that ``rows`` has rows for."""
        spec = self.spec(name)
        return self.read(name).join(F.broadcast(rows.select(*spec.partition).distinct()), list(spec.partition), "left_semi")  # one row a partition

    def same(self, df: DataFrame, name: str) -> bool:
        """Whether the partitions of ``df`` hold these rows already, by count and hashes of rows."""
        spec = self.spec(name)
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema])
        h = F.xxhash64(*rows.columns)
        mark = lambda x: x.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
        return mark(rows) == mark(self._touched(rows, name).select(*rows.columns))

    def append(self, df: DataFrame, name: str) -> None:
        """Adds rows; equal rows count once, so an append that is run again changes nothing. Versions of a key all stay."""
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spec(name).schema])
        self.overwrite(self._touched(rows, name).select(*rows.columns).unionByName(rows).distinct(), name)

    def overwrite(self, df: DataFrame, name: str, compare: bool = False) -> bool:
        """Replaces the partitions that ``df`` has rows for; a null partition value is refused.

        With ``compare`` nothing is written if they hold these rows already;
        returns whether it wrote.
        """
        if compare and self.same(df, name):
            return False
        spec = self.spec(name)
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema])
        for c in spec.partition:
            rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{name}: {c} is null"))).otherwise(F.col(c)))
        # rows of a partition spread over several files if there are many
        rows = rows.repartition(*spec.partition, F.pmod(F.xxhash64(*spec.key), F.lit(4))).sortWithinPartitions(*spec.partition, *spec.key)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*spec.partition).parquet(self._path(name))
        return True

    def upsert(self, df: DataFrame, name: str, newest: Column) -> None:
        """Rows of ``df`` replace those of equal key; among several the greatest ``newest`` stays.

        Only the partitions that ``df`` touches are read and written again.
        """
        spec = self.spec(name)
        key = list(spec.key)
        best = Window.partitionBy(*key).orderBy(newest.desc(), F.xxhash64(*df.columns))
        fresh = df.withColumn("rank_", F.row_number().over(best)).where("rank_ = 1").drop("rank_")
        touched = F.broadcast(df.select(*spec.partition).distinct())  # one row a partition
        kept = self.read(name).join(touched, list(spec.partition), "left_semi").join(fresh.select(*key), key, "left_anti")
        self.overwrite(kept.unionByName(fresh.select(*kept.columns)), name)

    def merge(self, df: DataFrame, name: str, newest: Column) -> None:
        """As ``upsert``, but stored rows compete too: a late row never replaces a newer one, and a repeat changes nothing."""
        columns = [f.name for f in self.spec(name).schema]
        self.upsert(self._touched(df, name).select(*columns).unionByName(df.select(*columns)), name, newest)

    def append_checked(self, df: DataFrame, name: str, rules: list[quality.Rule], newest: Column, origin: str) -> None:
        """Upserts rows that keep the rules; the others go to the table's quarantine, never away."""
        good, bad = quality.split(df, rules)
        self.upsert(good.select(*df.columns), name, newest)
        # an origin's rows replace those of an earlier run of it
        bad.withColumn("origin", F.lit(origin)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(f"{self.root}/_quarantine/{name}")

    def quarantined(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_quarantine/{name}")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_inventories(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, status): files that are missing, added or changed between two inventories."""
    a, b = left.select("path", F.col("sha256").alias("a")), right.select("path", F.col("sha256").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status is not null")
