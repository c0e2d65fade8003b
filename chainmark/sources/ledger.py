"""What has been done: commits, attempts and dead letters below one folder.

A task writes into a folder of its attempt and then commits one small file that
names it. Creating that file is exclusive, so of several attempts one counts;
readers only follow commits, so what a task left half-way is never seen. A task
that is committed is not run again: its result is read from the commit.
"""

from __future__ import annotations

import json
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Ledger:
    """Commits by key below ``root``, which driver and executors share. Keys are file names: letters, digits, ``=._-``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, kind: str, key: str) -> object:
        if not key or not all(c.isalnum() or c in "=._-" for c in key):
            raise ValueError(f"{key!r} is no key")
        return self._hadoop.Path(f"{self.root}/{kind}/{key}.json")

    def _read(self, path: object) -> dict | None:
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # its writer died; nothing was committed
            return None
        finally:
            stream.close()

    def _create(self, path: object, payload: dict) -> bool:
        """Writes the file unless it exists."""
        try:
            stream = self._fs.create(path, False)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or "already exists" in str(error).lower():
                return False
            raise
        stream.write(bytearray(json.dumps(payload, sort_keys=True).encode()))
        stream.close()
        return True

    def get(self, key: str) -> dict | None:
        return self._read(self._path("commits", key))

    def put(self, key: str, payload: dict) -> bool:
        """Commits, once; False if another attempt has."""
        path = self._path("commits", key)
        if self._fs.exists(path) and self._read(path) is None:
            self._fs.delete(path, False)
        return self._create(path, payload)

    def keys(self, prefix: str = "") -> list[str]:
        folder = self._hadoop.Path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(n.removesuffix(".json") for n in names if n.startswith(prefix) and n.endswith(".json"))

    def attempt(self, key: str) -> str:
        """A new folder that only this attempt writes."""
        return f"{self.root}/attempts/{key}/{uuid.uuid4().hex}"

    def dead_letters(self, key: str | None = None) -> list[dict]:
        folder = self._hadoop.Path(f"{self.root}/dead")
        found = [self._read(f.getPath()) for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((x for x in found if x and key in (None, x["key"])), key=lambda x: x["at"])

    def run_once(self, key: str, work: Callable[[str], dict | None], tries: int = 1) -> tuple[dict, bool]:
        """(result, whether it ran now). ``work`` gets its attempt's folder.

        A failure leaves a dead letter and no commit; the last one is raised. If
        another attempt commits first, its result counts and this one's is left.
        """
        if (done := self.get(key)) is not None:
            return done, False
        for left in reversed(range(tries)):
            folder = self.attempt(key)
            try:
                result = {"folder": folder, **(work(folder) or {})}
            except Exception as error:
                letter = {"key": key, "folder": folder, "error": f"{type(error).__name__}: {error}"[:2000], "trace": traceback.format_exc()[-4000:], "at": time.time()}
                self._create(self._path("dead", f"{key}-{uuid.uuid4().hex}"), letter)
                if not left:
                    raise
            else:
                won = self.put(key, result)
                return (result, True) if won else (self.get(key) or result, False)
        raise ValueError("no tries")

    def read(self, key: str) -> DataFrame:
        """The table that a committed attempt wrote."""
        done = self.get(key)
        if done is None:
            raise KeyError(f"{key} is not committed")
        return self.spark.read.parquet(done["folder"])


@dataclass(frozen=True)
class Capture:
    """A source's rows with how old they are: ``fresh``, or ``stale`` from the last good capture."""

    rows: DataFrame
    status: str
    taken: datetime
    age: timedelta

    def stamped(self, source: str) -> DataFrame:
        """Rows with source_status and source_age_minutes."""
        return self.rows.withColumns({f"{source}_status": F.lit(self.status), f"{source}_age_minutes": F.lit(int(self.age.total_seconds() // 60))})


class Captures:
    """Captures of one source; where a fetch fails, the newest good one serves for ``most``."""

    def __init__(self, ledger: Ledger, source: str, most: timedelta) -> None:
        self.ledger, self.source, self.most = ledger, source, most

    def _key(self, at: datetime) -> str:
        return f"{self.source}-{at:%Y%m%dT%H%M%S}"

    def last_good(self, now: datetime) -> datetime | None:
        keys = [k for k in self.ledger.keys(f"{self.source}-") if k <= self._key(now)]
        return datetime.strptime(keys[-1].rpartition("-")[2], "%Y%m%dT%H%M%S") if keys else None

    def take(self, fetch: Callable[[], DataFrame], now: datetime, complete: Callable[[DataFrame], bool] = lambda df: bool(df.head(1))) -> Capture:
        """Fetches once for ``now``; a failed or empty fetch falls back, and raises if all good captures are too old."""

        def work(folder: str) -> dict:
            fetch().write.parquet(folder)
            if not complete(self.ledger.spark.read.parquet(folder)):
                raise ValueError("the capture is empty")
            return {}

        now = now.replace(microsecond=0)
        try:
            self.ledger.run_once(self._key(now), work)
            return Capture(self.ledger.read(self._key(now)), "fresh", now, timedelta(0))
        except Exception as error:
            last = self.last_good(now)
            if last is None or now - last > self.most:
                raise RuntimeError(f"{self.source}: no capture within {self.most}") from error
            return Capture(self.ledger.read(self._key(last)), "stale", last, now - last)


def multiset(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, mark): a hash of each partition's rows that their order does not change, and repeats do.

    Two sums of independent row hashes: one mergeable aggregate, a row a partition.
    """
    # a map has no hash and no order; its entries, sorted, have
    plain = [F.array_sort(F.map_entries(c)) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in columns]
    one = lambda salt: F.sum(F.xxhash64(F.lit(salt), *plain).cast("decimal(20,0)"))
    sums = df.groupBy(*by).agg(F.count("*").alias("rows"), one(1).alias("a"), one(2).alias("b"))
    return sums.select(*by, "rows", F.concat_ws(":", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("mark"))


class Materialized:
    """A table that is computed partition by partition, and only where its rows or its specification have changed.

    A refresh compares each partition's multiset hash with the one it was last
    computed from; new results go into the refresh's own folder, and its commit
    names a table of (partition, mark, spec, content, folder). Readers follow the
    newest commit.
    """

    def __init__(self, ledger: Ledger, name: str, partition: list[str]) -> None:
        self.ledger, self.name, self.partition = ledger, name, partition

    def _versions(self) -> list[str]:
        return [k for k in self.ledger.keys(f"{self.name}-v") if self.ledger.get(k)]

    def state(self) -> DataFrame | None:
        versions = self._versions()
        return self.ledger.spark.read.parquet(f"{self.ledger.get(versions[-1])['folder']}/state") if versions else None

    def refresh(self, source: DataFrame, spec: str, compute: Callable[[DataFrame], DataFrame]) -> dict:
        """Counts of partitions computed, kept and removed, and of source rows read by ``compute``."""
        spark, by = self.ledger.spark, self.partition
        versions = self._versions()
        number = int(versions[-1].rpartition("v")[2]) + 1 if versions else 1

        def work(folder: str) -> dict:
            multiset(source, by, source.columns).withColumn("spec", F.lit(spec)).write.parquet(f"{folder}/marks")
            marks, before = spark.read.parquet(f"{folder}/marks"), self.state()
            same: list[Column] = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
            if before is None:
                changed, held = marks, None
            else:
                equal = [*same, F.col("m.mark") == F.col("s.mark"), F.col("m.spec") == F.col("s.spec")]
                changed = marks.alias("m").join(before.alias("s"), equal, "left_anti")
                held = before.alias("s").join(marks.alias("m"), equal, "left_semi")
            changed.write.parquet(f"{folder}/changed")
            changed = spark.read.parquet(f"{folder}/changed")
            some = source.alias("m").join(F.broadcast(changed.select(*by).alias("s")), same, "left_semi")  # one row a partition
            result = compute(some)
            result.write.partitionBy(*by).parquet(f"{folder}/rows")
            written = self._rows(f"{folder}/rows", result.schema)
            content = multiset(written, by, written.columns).select(*by, F.col("mark").alias("content"))
            state = changed.alias("m").join(content.alias("s"), same, "left").select(*[F.col(f"m.{c}").alias(c) for c in by], "m.rows", "m.mark", "m.spec", "s.content", F.lit(f"{folder}/rows").alias("folder"), F.lit(number).alias("version"))
            (state if held is None else state.unionByName(held)).write.parquet(f"{folder}/state")
            n = changed.agg(F.count("*"), F.sum("rows")).first()
            kept = 0 if held is None else held.count()
            return {"schema": result.schema.jsonValue(), "version": number, "computed": n[0], "rows_read": n[1] or 0, "kept": kept, "removed": 0 if before is None else before.alias("s").join(marks.alias("m"), same, "left_anti").count()}

        return self.ledger.run_once(f"{self.name}-v{number:06d}", work)[0]

    def _rows(self, folder: str, schema: StructType) -> DataFrame:
        return self.ledger.spark.read.schema(schema).parquet(folder).select(*schema.names)

    def read(self) -> DataFrame:
        """Rows of all partitions that the newest commit knows, from the folders it names."""
        state = self.state()
        if state is None:
            raise KeyError(f"{self.name} was never computed")
        schema, out = StructType.fromJson(self.ledger.get(self._versions()[-1])["schema"]), None
        for r in state.select("folder").distinct().orderBy("folder").collect():  # one row a refresh that still counts
            rows = self._rows(r.folder, schema)
            on = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.partition]
            some = rows.alias("m").join(F.broadcast(state.where(F.col("folder") == r.folder).alias("s")), on, "left_semi")
            out = some if out is None else out.unionByName(some)
        return out
