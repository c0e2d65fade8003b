"""Structured Streaming for polled captures: dedupe, cadence, keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import Store, scratch


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def minute_dedupe(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """One row per key and minute; a repeat within the watermark is dropped, state older than it goes."""
    return rows.withColumn("minute", F.date_trunc("minute", ts)).withWatermark("minute", delay).dropDuplicatesWithinWatermark([*keys, "minute"])


def cadence(rows: DataFrame, ts: str, length: str, expected: int, delay: str = "1 hour") -> DataFrame:
    """(start, captures, late): captures per window and whether there are fewer than expected."""
    n = rows.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("captures"))
    return n.select(F.col("w.start").alias("start"), "captures", (F.col("captures") < expected).alias("late"))


def adaptive_alpha(rows: DataFrame, key: str, order: str, missed: Column, target: float = 0.1, gamma: float = 0.05) -> DataFrame:
    """(key, n, alpha) after each batch: alpha moves by gamma * (target - missed), kept in [0, 1].

    Rows of a batch are folded in the order of ``order``; the state of a key is
    two numbers and outlives the batch.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, alpha = state.get if state.exists else (0, target)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for miss in rows["missed"].tolist():
            alpha = min(1.0, max(0.0, alpha + gamma * (target - miss)))
        n += len(rows)
        state.update((n, alpha))
        yield pd.DataFrame({key: [k[0]], "n": [n], "alpha": [alpha]})

    kind = rows.schema[key].dataType.simpleString()
    shaped = rows.select(key, F.col(order).alias("at"), missed.cast("double").alias("missed"))
    return shaped.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, alpha double", "n long, alpha double", "update", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, mode: str = "append", key: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Runs a stream over all that is there; its result as a table.

    Files and the stream's checkpoint lie below ``at`` (by default a new place
    in the shared folder); called again with the same place the stream goes on
    where it stopped. In complete mode every batch replaces the table. In update
    mode each batch is written beside the earlier ones under its number (so a
    batch that is run again replaces itself), and a ``key``'s newest row counts.
    """
    at = at or f"{scratch(rows.sparkSession)}/streams/{uuid.uuid4().hex}"
    out = rows.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        run = out.outputMode("append").format("parquet").start(f"{at}/rows")
    elif mode == "complete":
        run = out.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
    else:
        run = out.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")).start()
    run.awaitTermination()
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no batch, so no files
        return spark.createDataFrame([], rows.schema)
    if mode != "update":
        return spark.read.schema(rows.schema).parquet(f"{at}/rows")
    kept = spark.read.schema(StructType([*rows.schema, StructField("batch", LongType())])).parquet(f"{at}/rows")
    newest = F.max_by(F.struct(*rows.columns), "batch")
    return kept.groupBy(*key).agg(newest.alias("r")).select("r.*")


def into_store(rows: DataFrame, store: Store, name: str, newest: Column, at: str | None = None) -> None:
    """Merges a stream into a table, batch by batch: late rows find their place, and a batch that is run again changes nothing."""
    at = at or f"{scratch(rows.sparkSession)}/streams/{uuid.uuid4().hex}"
    out = rows.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    out.foreachBatch(lambda df, _: store.merge(df, name, newest)).start().awaitTermination()
