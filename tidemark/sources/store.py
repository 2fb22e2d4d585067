"""Rollup tiers and their coverage as Parquet tables.

A tier is partitioned by width and day, so a query reads only its own days of its own width. Writes are keyed: new
rows replace stored rows of the same (sensor, width, bucket), whatever is written twice stays single. Files hold whole
partitions, so a write lays the merged partitions down beside the table, once, and then swaps just these in by name.
Coverage is a log of marks and clears, appended to and replayed; after so many small files the log is rewritten as the
ranges it amounts to, without touching what others append meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import intervals
from tidemark.functions.granularity import Granularity
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import Schema

KEY = ["sensor_id", "granularity_id", "ts"]
#: The coverage log: what was marked or cleared, and when.
LOCK_SECONDS = 3600
LOG_FILES = 64  # small files before the log is rewritten
LOG = "sensor_id string, granularity_id string, start long, end long, covered boolean, at long"


def _type_of(column: str) -> str:
    return "long" if column == "count_agg_rows" else "double"


class KeyedTable:
    """A partitioned Parquet table with a key."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: list[str], partitions: list[str]):
        self.spark, self.path, self.ddl, self.key, self.partitions = spark, path, ddl, key, partitions

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path))

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(self.path)

    def _touched(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows.select(*self.partitions).distinct())  # days and widths of one write

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextmanager
    def _locked(self):
        """One writer at a time, whichever process it is in: a lock file beside the table. One that a crash has left is
        broken after ``LOCK_SECONDS``."""
        at, fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}__lock"), self._fs()

        def mine() -> bool:
            try:
                return fs.createNewFile(at)
            except Py4JJavaError as e:  # another was first
                if "AlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise

        while not mine():
            if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > LOCK_SECONDS:
                fs.delete(at, False)
            time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(at, False)

    def _swap(self, rows: DataFrame) -> None:
        """Put ``rows`` (which may derive from this table) in place of the partitions that they fall in. The old files of
        a partition are removed when the new ones stand, so a crash leaves one or the other, aside or in place."""
        new, old = (f"{self.path}__{kind}_{uuid.uuid4().hex}" for kind in ("new", "old"))
        rows.repartition(*self.partitions).write.partitionBy(*self.partitions).parquet(new)
        fs, at = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        depth = "/".join("*" for _ in self.partitions)
        for status in fs.globStatus(at(f"{new}/{depth}")):
            if not status.isDirectory():
                continue
            part = "/".join(status.getPath().toString().rsplit("/", len(self.partitions))[1:])
            target, kept = at(f"{self.path}/{part}"), at(f"{old}/{part}")
            if fs.exists(target):
                fs.mkdirs(kept.getParent())
                fs.rename(target, kept)
            fs.mkdirs(target.getParent())
            fs.rename(status.getPath(), target)
        for path in (new, old):
            fs.delete(at(path), True)
        self.spark.catalog.refreshByPath(self.path)

    def upsert(self, rows: DataFrame) -> None:
        rows = rows.select(*StructType.fromDDL(self.ddl).names).persist()  # read three times
        try:
            with self._locked():
                self._merge(rows)
        finally:
            rows.unpersist()

    def _merge(self, rows: DataFrame) -> None:
        if not self._exists():
            rows.repartition(*self.partitions).write.mode("append").partitionBy(*self.partitions).parquet(self.path)
        else:
            kept = self.read().join(self._touched(rows), self.partitions, "left_semi").join(rows, self.key, "left_anti")
            self._swap(rows.unionByName(kept))

    def delete(self, condition) -> None:
        """Rows that meet ``condition`` go; partitions left without rows are emptied too."""
        with self._locked():
            if self._exists():
                self._drop(condition)

    def _drop(self, condition) -> None:
        hit = self.read().where(condition)
        touched = [tuple(r) for r in hit.select(*self.partitions).distinct().collect()]  # partitions, not rows
        if not touched:
            return
        kept = self.read().join(self._touched(hit), self.partitions, "left_semi").where(~condition)
        left = {tuple(r) for r in kept.select(*self.partitions).distinct().collect()}
        if left:
            self._swap(kept)
        for gone in set(touched) - left:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(f"{p}={v}" for p, v in zip(self.partitions, gone))])), True)
        self.spark.catalog.refreshByPath(self.path)

    def truncate(self) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


class Tier:
    """One level of stored rollups of one schema, with the buckets it covers."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: Schema):
        self.spark, self.schema, self.name = spark, schema, name
        measures = ", ".join(f"`{c}` {_type_of(c)}" for c in schema.rollup_columns)
        self.rows = KeyedTable(spark, f"{root}/{name}/{schema.name}/rows", f"sensor_id string, ts timestamp, {measures}, granularity_id string, bucket_day date", KEY, ["granularity_id", "bucket_day"])
        self.log = f"{root}/{name}/{schema.name}/coverage"

    def write(self, rows: DataFrame) -> None:
        self.rows.upsert(rows.withColumn("bucket_day", F.to_date("ts")))

    def read(self, sensors: list[str], granularity: Granularity, wanted: TimeRange) -> DataFrame:
        lo, hi = F.timestamp_seconds(F.lit(wanted.start)), F.timestamp_seconds(F.lit(wanted.end))
        found = self.rows.read().where((F.col("granularity_id") == granularity.id) & F.col("bucket_day").between(F.to_date(lo), F.to_date(hi)))
        return found.where(F.col("sensor_id").isin(sensors) & (F.col("ts") >= lo) & (F.col("ts") < hi)).drop("bucket_day")

    def _changes(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.log)

    def coverage(self, sensors: list[str]) -> dict[tuple[str, str], list[TimeRange]]:
        """Covered ranges by (sensor, width): the changes of these sensors, replayed in their order."""
        rows = self._replayed(self._changes().where(F.col("sensor_id").isin(sensors))).collect()  # ranges of the asked sensors
        held: dict[tuple[str, str], list[TimeRange]] = {}
        for r in sorted(rows, key=lambda r: r["start"]):
            held.setdefault((r["sensor_id"], r["granularity_id"]), []).append(TimeRange(r["start"], r["end"]))
        return held

    @staticmethod
    def _replayed(changes: DataFrame) -> DataFrame:
        """The log's rows that remain, as marks: the ranges each sensor's changes amount to, replayed on the executors."""

        def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            now: list[TimeRange] = []
            for r in rows.sort_values(["at", "covered"]).itertuples():
                during = [TimeRange(int(r.start), int(r.end))]
                now = intervals.merge(now + during) if r.covered else intervals.subtract(now, during)
            return pd.DataFrame({"sensor_id": key[0], "granularity_id": key[1], "start": [r.start for r in now], "end": [r.end for r in now], "covered": True, "at": int(rows["at"].max())})

        return changes.groupBy("sensor_id", "granularity_id").applyInPandas(replay, LOG)

    def change_coverage(self, changes: Iterable[tuple[str, Granularity, TimeRange, bool]]) -> None:
        """Append marks (True) and clears (False); one small write, whatever their number."""
        at = time.time_ns()
        rows = [(s, g.id, r.start, r.end, covered, at) for s, g, r, covered in changes]
        if rows:
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.log)
            if len(self._log_files()) > LOG_FILES:
                self.compact_coverage()

    def _log_files(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().endswith(".parquet")] if fs.exists(path) else []

    def compact_coverage(self) -> None:
        """Rewrite the log's present files as the ranges they amount to, in one file added beside them; then they go.
        Files that others add meanwhile are neither read nor removed."""
        files = self._log_files()
        if not files:
            return
        self._replayed(self.spark.read.schema(LOG).parquet(*files)).coalesce(1).write.mode("append").parquet(self.log)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.log).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in files:
            fs.delete(path(f), False)
        self.spark.catalog.refreshByPath(self.log)

    def delete(self, sensors: list[str], granularity: Granularity, gone: TimeRange) -> None:
        lo, hi = F.timestamp_seconds(F.lit(gone.start)), F.timestamp_seconds(F.lit(gone.end))
        days = F.col("bucket_day").between(F.to_date(lo), F.to_date(hi))
        self.rows.delete((F.col("granularity_id") == granularity.id) & days & F.col("sensor_id").isin(sensors) & (F.col("ts") >= lo) & (F.col("ts") < hi))

    def truncate(self) -> None:
        self.rows.truncate()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def granularity_table(spark: SparkSession, granularities) -> DataFrame:
    """The widths as a table, in display order."""
    rows = [(g.display_limit, g.display_priority, g.fetch_seconds, g.id, g.seconds, g.parallel_queries, g.partitions, g.window) for g in granularities]
    names = "display_limit_seconds long, display_priority int, fetch_seconds long, granularity_id string, seconds long, parallel_queries int, partitions int, window_duration string"
    return spark.createDataFrame(rows, names).orderBy("display_priority")


def save_granularities(spark: SparkSession, granularities, path: str) -> None:
    granularity_table(spark, granularities).write.mode("overwrite").parquet(path)
