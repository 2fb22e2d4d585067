"""The running engine: follow a database's query log, warm what dashboards ask for, archive and expire what they asked.

The high-water mark is the time up to which the log was handled. It is kept in a small file beside the tiers and moves
only after a poll's queries were handled, so a crash hands them over again, which the tiers do not mind.
"""

from __future__ import annotations

import datetime
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.engine import Engine
from tidemark.sources import query_log, readings
from tidemark.sources.config import Config

log = logging.getLogger("tidemark.service")
UTC = datetime.timezone.utc


def jdbc_tables(spark: SparkSession, config: Config, driver: str | None = None) -> Callable[[str], DataFrame]:
    """Source tables by id, each over JDBC from the database that the configuration names for it. Partitions follow the
    configured number for the finest width; time and sensor filters reach the database."""
    partitions = max(1, min(config.granularities, key=lambda g: g.seconds).partitions)

    def read(table: str) -> DataFrame:
        spec = config.tables[table]
        if spec.database is None:
            raise ValueError(f"table {table} names no database")
        options = config.databases[spec.database].jdbc_options(driver)
        return readings.read_jdbc(spark, options, spec, config.origin, partitions)

    return read


class Service:
    """``read_log`` gives the log; polls and clean-ups come at the configured periods."""

    def __init__(self, engine: Engine, read_log: Callable[[], DataFrame], now: Callable[[], float] = time.time):
        self.engine, self.read_log, self.now = engine, read_log, now
        self.spark, settings = engine.spark, engine.config.settings
        self.poll_seconds = float(settings.get("queryPollingDurationInSeconds", 5))
        self.keep_seconds = float(settings.get("queryLogCleanupDurationInSeconds", 300))
        self.archives = bool(settings.get("storeVisualizationQueries", False))
        self.archive_path, self.mark_path = f"{engine.root}/asked", f"{engine.root}/high_water"

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def high_water(self) -> datetime.datetime | None:
        at, fs = self._path(self.mark_path)
        if not fs.exists(at):
            return None
        return datetime.datetime.fromisoformat(self.spark.read.text(self.mark_path).first()[0])

    def _move(self, to: datetime.datetime) -> None:
        self.spark.createDataFrame([(to.isoformat(),)], "value string").coalesce(1).write.mode("overwrite").text(self.mark_path)

    def poll(self) -> list[BaseException | None]:
        """Handle what was logged since the last poll; the first poll starts now. Returns an error or None per query."""
        until = datetime.datetime.fromtimestamp(self.now(), UTC)
        since = self.high_water()
        if since is None:
            self._move(until)
            return []
        asked = query_log.new_queries(self.read_log(), F.lit(since), F.lit(until)).orderBy("event_time").persist()
        try:
            errors = self.engine.warm_all([r["argument"] for r in asked.collect()])  # one poll's dashboard queries
            if self.archives and errors:
                query_log.archive(asked, self.archive_path)
        finally:
            asked.unpersist()
        self._move(until)
        return errors

    def clean(self) -> list[str]:
        """Expire the archive's days that are older than the retention."""
        return query_log.expire_archive(self.spark, self.archive_path, datetime.datetime.fromtimestamp(self.now() - self.keep_seconds, UTC).date())

    def run(self, polls: int | None = None) -> None:
        """Poll for ever, or so many times; a failing poll is logged and tried again at the next."""
        done, cleaned = 0, self.now()
        while polls is None or done < polls:
            started = self.now()
            try:
                self.poll()
                if self.now() - cleaned >= self.keep_seconds:
                    self.clean()
                    cleaned = self.now()
            except Exception:
                log.exception("poll failed")
            done += 1
            if polls is None or done < polls:
                time.sleep(max(0.0, self.poll_seconds - (self.now() - started)))
