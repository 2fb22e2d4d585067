"""The running engine against an embedded database: its log followed, its readings rolled up, its queries archived."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions.granularity import DEFAULTS
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import TEMPERATURE
from tidemark.plans.engine import Engine
from tidemark.plans.service import Service, jdbc_tables
from tidemark.sources import query_log, readings
from tidemark.sources.config import Config, Database, Route, Sensor, Table

DAY = 86_400
SQL = """SELECT '{"meta_data":"specified_granularity","specified_granularity":"1h"}' AS meta_data, temperature FROM temperature WHERE sensor_id = '%s' AND ts >= 0 AND ts < 7200"""


def test_service_follows_the_log(spark, tmp_path, monkeypatch):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    monkeypatch.setattr(Database, "jdbc_options", lambda self, driver=None: options)
    rows = spark.range(0, DAY, 60).select(F.lit("a").alias("sensor_id"), F.col("id").cast("double").alias("ts"), F.col("id").cast("double").alias("temperature"))
    readings.append_jdbc(rows, options | {"createTableColumnTypes": "sensor_id VARCHAR(30)"}, "METER")
    span = TimeRange(0, 10 * DAY)
    # An unquoted name is upper-cased by this database.
    tables = {"src": Table("src", "temperature", "METER", "d", "sensor_id", "ts")}
    sensors = {"a": Sensor("a", "temperature", (Route("src", span),))}
    settings = {"queryPollingDurationInSeconds": 0, "queryLogCleanupDurationInSeconds": 2 * DAY, "storeVisualizationQueries": True}
    config = Config(span, DEFAULTS, {"d": Database("d", "derby", "db", "h", 1)}, tables, sensors, settings).validated()
    clock = [5.0 * DAY]
    engine = Engine(spark, config, str(tmp_path / "tiers"), jdbc_tables(spark, config), now=lambda: clock[0])

    def say(when, sql, kind="Query"):
        at = datetime.datetime.fromtimestamp(when, datetime.timezone.utc)
        frame = spark.createDataFrame([(at, "h", sql, kind)], "event_time timestamp, user_host string, argument string, command_type string")
        readings.append_jdbc(frame, options | {"createTableColumnTypes": "user_host VARCHAR(99), argument VARCHAR(999), command_type VARCHAR(99)"}, "ASKED")

    say(1.0, SQL % "a")  # before the service starts
    service = Service(engine, lambda: query_log.read_jdbc_log(spark, options, "ASKED"), now=lambda: clock[0])
    assert service.poll() == [] and engine.missing({"a": [TimeRange(0, 7200)]}, TEMPERATURE, DEFAULTS[2])
    say(clock[0] + 10, SQL % "a")
    say(clock[0] + 11, "SELECT 1")
    say(clock[0] + 12, SQL % "nobody")
    clock[0] += 60
    errors = service.poll()
    assert errors == [None, None]  # an unknown sensor asks for nothing
    assert engine.missing({"a": [TimeRange(0, 7200)]}, TEMPERATURE, DEFAULTS[2]) == {}
    assert [r["count_agg_rows"] for r in engine.first_level(TEMPERATURE).read(["a"], DEFAULTS[2], span).collect()] == [60, 60]
    assert service.poll() == []  # the mark has moved
    assert spark.read.parquet(service.archive_path).count() == 2
    # Restarted, it goes on where it was; old days of the archive go.
    again = Service(engine, service.read_log, now=lambda: clock[0])
    assert again.high_water() == service.high_water()
    clock[0] += 3.5 * DAY
    say(clock[0] - 5, SQL % "a")
    again.run(polls=1)
    assert again.clean() == [f"day={datetime.datetime.fromtimestamp(5 * DAY, datetime.timezone.utc).date()}"] and spark.read.parquet(again.archive_path).count() == 1


def test_a_failing_poll_is_tried_again(spark, tmp_path):
    engine = Engine(spark, Config(TimeRange(0, DAY)), str(tmp_path), lambda table: None, now=lambda: 100.0)
    asked = []

    def read():
        asked.append(1)
        raise OSError("no log")

    service = Service(engine, read, now=lambda: 100.0)
    service.poll_seconds = 0
    service.run(polls=3)
    assert len(asked) == 2  # the first poll only sets the mark
