"""Tables that an operator writes between its steps.

They go below the folder that the session names in ``spark.checkpoint.dir``,
which driver and executors share, so a lost executor loses none of them. Where
the setting is absent, a local folder serves sessions of one machine; on a
cluster it is an error.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="chainmark-")


def root(spark: SparkSession) -> str:
    """Folder for work tables; never a machine-local one on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = _local()
    return named.rstrip("/")


class Workspace:
    """Work tables of one operator call.

    ``keep`` writes a frame and returns the table read back: lineage ends
    there and later steps need no shuffle files from before. ``drop`` removes
    a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.at = f"{root(spark)}/chainmark/{name}-{uuid.uuid4().hex}"
        self._leaves = False

    def path(self, table: str) -> str:
        return f"{self.at}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        conf, path = self.spark.conf, self.path(table)
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        self._delete_on_exit()
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete_on_exit(self) -> None:
        """The folder goes when the session's process ends; frames that are returned may read it until then."""
        if not self._leaves:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)
            self._leaves = True

    def drop(self, table: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
