"""Registered queries over the driver's tables, each with its DuckDB twin.

``events`` stands in for readings that have unique times per sensor, ``lineitem`` for readings that repeat times and
hold zeros. Sums are rounded to four places on both sides, since the two engines add in different orders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import granularity as widths
from tidemark.functions.granularity import DEFAULTS, Granularity
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import POWER, TEMPERATURE, TEMPERATURE_HUMIDITY, Schema
from tidemark.operators import coverage, rollup, spatial
from tidemark.plans import engine as engines
from tidemark.plans import intent as intents
from tidemark.plans.planner import SECOND_LEVEL
from tidemark.sources import query_log, store
from tidemark.sources.config import Config, Route, Sensor, SensorGroup, Table
from tidemark.sources.readings import canonical, in_range, rename_vendor
from tidemark.sources.shared import shared_folder
from tidemark.streaming.rollup import rollup_stream

QUERIES = {}
ORACLE_SQL = {}
MINUTE, QUARTER, HOUR, DAY = DEFAULTS
WEEK = Granularity("1w", "1 week", 604_800, 36_600 * 86_400, 5)
START = 1_704_067_200  # 2024-01-01, where the events begin
SPAN = TimeRange(START, START + 40 * 86_400)

#: Measures derived from the driver's tables, in SQL that both engines read alike.
EVENT_POWER = {
    **{f"voltage_{k}": e for k, e in zip((1, 2, 3), ("value", "value - 50", "-value"))},
    **{f"current_{k}": f"value - {100 * k}" for k in (1, 2, 3)},
    **{f"power_{k}": e for k, e in zip((1, 2, 3), ("value - 250", "value", "value * 0"))},
    **{f"power_factor_{k}": e for k, e in zip((1, 2, 3), ("CASE WHEN event_type = 'view' THEN 0.0 ELSE value END", "value", "value * 0"))},
    "energy_consumed": "event_id",
}
LINE_POWER = {
    **{f"voltage_{k}": e for k, e in zip((1, 2, 3), ("l_quantity", "l_quantity - 25", "-l_quantity"))},
    **{f"current_{k}": e for k, e in zip((1, 2, 3), ("l_extendedprice", "l_extendedprice - 30000", "l_tax"))},
    **{f"power_{k}": e for k, e in zip((1, 2, 3), ("l_tax", "l_quantity", "l_discount"))},
    **{f"power_factor_{k}": e for k, e in zip((1, 2, 3), ("l_discount", "l_tax", "l_discount - 0.05"))},
    "energy_consumed": "l_orderkey * 10 + l_linenumber",
}
EVENT_CLIMATE = {"temperature": "value - 50", "humidity": "value", "battery_voltage": "-value"}
SOURCES = {"events": ("CAST({s} AS STRING)", "ts"), "lineitem": ("CAST({s} AS STRING)", "l_shipdate")}


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _readings(spark: SparkSession, sf_dir: str, table: str, sensor: str, schema: Schema, measures: dict[str, str], where: str = "true") -> DataFrame:
    ts = SOURCES[table][1]
    raw = _raw(spark, sf_dir, table).where(where).select(F.expr(f"CAST({sensor} AS STRING)").alias("sensor_id"), F.col(ts).alias("ts"), *(F.expr(measures[m]).alias(m) for m in schema.measures))
    return canonical(raw, schema)


def _readings_sql(table: str, sensor: str, schema: Schema, measures: dict[str, str], where: str = "true") -> str:
    ts = SOURCES[table][1]
    columns = ", ".join(f"CAST({measures[m]} AS DOUBLE) AS {m}" for m in schema.measures)
    return f"SELECT CAST({sensor} AS VARCHAR) AS sensor_id, {ts}::TIMESTAMP AS ts, {columns} FROM {table} WHERE {where}"


def _published(rows: DataFrame, schema: Schema) -> DataFrame:
    """Rollup rows as stored by the published tables: time in epoch seconds, sums rounded."""
    shown = [(F.round(c, 4) if c.startswith("sum_") else F.col(c)).alias(c) for c in schema.rollup_columns]
    return rows.select("sensor_id", F.col("ts").cast("double").alias("ts"), *shown, "granularity_id")


def _bucket_sql(g: Granularity) -> str:
    return f"time_bucket(INTERVAL '{g.window}', ts, TIMESTAMP '1970-01-01')"


def _source_sql(readings: str, schema: Schema, g: Granularity, last: str = "arg_max({c}, ts)", first: str = "arg_min({c}, ts)") -> str:
    """Rollup rows from readings, unrounded, with ``ts`` still a timestamp."""
    columns = []
    for m in schema.gauges:
        x = f"abs({m.name})" if m.magnitude else m.name
        columns += [f"sum({x}) AS sum_{m.name}", f"min({x}) AS min_{m.name}", f"max({x}) AS max_{m.name}"]
        if m.non_zero_min:
            columns.append(f"min(CASE WHEN {x} > 0 THEN {x} END) AS non_zero_min_{m.name}")
    if c := schema.counter:
        hi, lo = last.format(c=c), first.format(c=c)
        columns += [f"{hi} AS {c}", f"{hi} - {lo} AS slot_{c}", f"{lo} AS first_{c}", f"{hi} AS last_{c}"]
    return f"SELECT sensor_id, {_bucket_sql(g)} AS bucket, {', '.join(columns)}, count(*) AS count_agg_rows, '{g.id}' AS granularity_id FROM ({readings}) GROUP BY 1, 2"


def _rollup_sql(finer: str, schema: Schema, g: Granularity) -> str:
    columns = []
    for m in schema.gauges:
        columns += [f"sum(sum_{m.name}) AS sum_{m.name}", f"min(min_{m.name}) AS min_{m.name}", f"max(max_{m.name}) AS max_{m.name}"]
        if m.non_zero_min:
            columns.append(f"min(non_zero_min_{m.name}) AS non_zero_min_{m.name}")
    if c := schema.counter:
        columns += [f"arg_max({c}, ts) AS {c}", f"sum(slot_{c}) AS slot_{c}", f"arg_min(first_{c}, ts) AS first_{c}", f"arg_max(last_{c}, ts) AS last_{c}"]
    return f"SELECT sensor_id, {_bucket_sql(g)} AS bucket, {', '.join(columns)}, sum(count_agg_rows)::BIGINT AS count_agg_rows, '{g.id}' AS granularity_id FROM (SELECT *, bucket AS ts FROM ({finer})) GROUP BY 1, 2"


def _published_sql(rows: str, schema: Schema) -> str:
    shown = ", ".join(f"round({c}, 4) AS {c}" if c.startswith("sum_") else c for c in schema.rollup_columns)
    return f"SELECT sensor_id, epoch(bucket)::DOUBLE AS ts, {shown}, granularity_id FROM ({rows})"


def _view_sql(rows: str, schema: Schema) -> str:
    shown = ", ".join(f"round(sum_{of[4:]}, 4) / count_agg_rows AS {name}" if of.startswith("avg:") else f"{of} AS {name}" for name, of in schema.served)
    return f"SELECT granularity_id AS granularity, sensor_id, epoch(bucket)::DOUBLE AS ts, {shown} FROM ({rows})"


def _viewed(rows: DataFrame, schema: Schema) -> DataFrame:
    """Averages of rounded sums, which are the same numbers in both engines."""
    return rollup.serving_view(rows.withColumns({f"sum_{g.name}": F.round(f"sum_{g.name}", 4) for g in schema.gauges}), schema)


def query(sql: str):
    """Register a query with its oracle."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# Scans, projections and filters.

_CLICKS = f"event_type = 'click' AND epoch(ts) >= {START + 5 * 86_400} AND epoch(ts) < {START + 9 * 86_400}"


@query(f"SELECT event_id, event_type AS sensor_id, value FROM events WHERE {_CLICKS}")
def source_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_range(_raw(spark, sf_dir, "events"), ["click"], TimeRange(START + 5 * 86_400, START + 9 * 86_400), "event_type")
    return rows.select("event_id", F.col("event_type").alias("sensor_id"), "value")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS sensor_id, epoch(l_shipdate)::DOUBLE AS ts, l_quantity AS voltage_1, l_extendedprice AS power_1, l_discount AS power_factor_1 FROM lineitem")
def source_rename_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = _raw(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("new_sensor_id"), F.col("l_shipdate").cast("timestamp").cast("double").alias("TS"), F.col("l_quantity").alias("V1"), F.col("l_extendedprice").alias("W1"), F.col("l_discount").alias("PF1"))
    return rename_vendor(vendor)


@query("SELECT * FROM (VALUES (21600::BIGINT, 1, 0::BIGINT, '1m', 60::BIGINT, 1, 0, '1 minute'), (345600, 2, 0, '15m', 900, 1, 0, '15 minutes'), (2678400, 3, 0, '1h', 3600, 1, 0, '1 hour'), (316224000, 4, 0, '1d', 86400, 1, 0, '1 day')) AS t(display_limit_seconds, display_priority, fetch_seconds, granularity_id, seconds, parallel_queries, partitions, window_duration)")
def granularity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.granularity_table(spark, DEFAULTS)


_LOGGED = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'select ''{}'' as meta_data, ' ELSE '' END || coalesce(text, '') || CASE WHEN turn % 5 = 0 THEN ' ignore_cache' ELSE '' END AS argument, CASE WHEN turn % 2 = 0 THEN 'Query' ELSE 'Connect' END AS command_type FROM conversations"


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(argument, '\\n', ' ', 'g'), ' +', ' ', 'g') AS argument FROM ({_LOGGED}) WHERE command_type = 'Query' AND argument LIKE '%meta_data%' AND argument NOT LIKE '%ignore_cache%' AND argument NOT LIKE '%general_log%'")
def query_log_filter_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("turn") % 3 == 0, "select '{}' as meta_data, ").otherwise("")
    end = F.when(F.col("turn") % 5 == 0, " ignore_cache").otherwise("")
    log = _raw(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(start, F.coalesce("text", F.lit("")), end).alias("argument"), F.when(F.col("turn") % 2 == 0, "Query").otherwise("Connect").alias("command_type"))
    return log.where(query_log.is_dashboard_query(F.col("argument"), F.col("command_type"))).select("conv_id", "turn", query_log.normalised(F.col("argument")).alias("argument"))


# Rollups from readings, and from finer rollups.

_E_POWER = ("events", "user_id", POWER, EVENT_POWER)
_E_TEMP = ("events", "user_id", TEMPERATURE, EVENT_CLIMATE)
_E_CLIMATE = ("events", "event_type", TEMPERATURE_HUMIDITY, EVENT_CLIMATE)
_L_POWER = ("lineitem", "l_suppkey", POWER, LINE_POWER)
_TIES = {"last": "arg_max({c}, (ts, {c}))", "first": "arg_min({c}, (ts, {c}))"}


@query(_published_sql(_source_sql(_readings_sql(*_E_POWER), POWER, HOUR), POWER))
def rollup_source_power_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_readings(spark, sf_dir, *_E_POWER), POWER, HOUR), POWER)


@query(_published_sql(_source_sql(_readings_sql(*_L_POWER), POWER, WEEK, **_TIES), POWER))
def rollup_source_power_week_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_readings(spark, sf_dir, *_L_POWER), POWER, WEEK, unique_ts=False), POWER)


@query(_published_sql(_source_sql(_readings_sql(*_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE))
def rollup_source_temperature_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_readings(spark, sf_dir, *_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE)


@query(_published_sql(_source_sql(_readings_sql(*_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY))
def rollup_source_temphum_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_readings(spark, sf_dir, *_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY)


@query(_published_sql(_rollup_sql(_source_sql(_readings_sql(*_E_POWER), POWER, HOUR), POWER, DAY), POWER))
def rollup_from_rollup_power_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_rollup(rollup.from_source(_readings(spark, sf_dir, *_E_POWER), POWER, HOUR), POWER, DAY), POWER)


@query(f"SELECT a.sensor_id, a.ts, a.slot_energy_consumed FROM ({_published_sql(_source_sql(_readings_sql(*_E_POWER), POWER, DAY), POWER)}) a")
def rollup_exact_slots_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = rollup.from_source(_readings(spark, sf_dir, *_E_POWER), POWER, HOUR)
    return _published(rollup.from_rollup(fine, POWER, DAY, exact_slots=True), POWER).select("sensor_id", "ts", "slot_energy_consumed")


@query(_published_sql(_rollup_sql(_source_sql(_readings_sql(*_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE, DAY), TEMPERATURE))
def rollup_from_rollup_temperature_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_rollup(rollup.from_source(_readings(spark, sf_dir, *_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE, DAY), TEMPERATURE)


@query(_published_sql(_rollup_sql(_source_sql(_readings_sql(*_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY, WEEK), TEMPERATURE_HUMIDITY))
def rollup_from_rollup_temphum_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_rollup(rollup.from_source(_readings(spark, sf_dir, *_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY, WEEK), TEMPERATURE_HUMIDITY)


@query(_published_sql(_rollup_sql(_source_sql(_readings_sql(*_E_POWER), POWER, QUARTER), POWER, HOUR), POWER))
def rollup_two_stage_15m_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.two_stage(_readings(spark, sf_dir, *_E_POWER), POWER, QUARTER, HOUR)[1], POWER)


_LINE_WEEK = _source_sql(_readings_sql(*_L_POWER), POWER, WEEK, **_TIES)


@query(f"SELECT sensor_id, epoch(bucket)::DOUBLE AS ts, non_zero_min_power_factor_1, non_zero_min_power_factor_2, non_zero_min_power_factor_3 FROM ({_LINE_WEEK})")
def non_zero_min_pf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _published(rollup.from_source(_readings(spark, sf_dir, *_L_POWER), POWER, WEEK, unique_ts=False), POWER)
    return rows.select("sensor_id", "ts", *(f"non_zero_min_power_factor_{k}" for k in (1, 2, 3)))


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_readings(spark, sf_dir, *_E_POWER), POWER, DAY), POWER)


_COUNTED = _published_sql(_source_sql(_readings_sql(*_E_POWER), POWER, DAY), POWER)


@query(f"SELECT sensor_id, ts, energy_consumed FROM ({_COUNTED})")
def counter_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counter(spark, sf_dir).select("sensor_id", "ts", "energy_consumed")


@query(f"SELECT sensor_id, ts, slot_energy_consumed FROM ({_COUNTED})")
def counter_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counter(spark, sf_dir).select("sensor_id", "ts", "slot_energy_consumed")


# Serving views.


@query(_view_sql(_source_sql(_readings_sql(*_E_POWER), POWER, HOUR), POWER))
def view_power_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(rollup.from_source(_readings(spark, sf_dir, *_E_POWER), POWER, HOUR), POWER)


@query(_view_sql(_source_sql(_readings_sql(*_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE))
def view_temperature_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(rollup.from_source(_readings(spark, sf_dir, *_E_TEMP), TEMPERATURE, HOUR), TEMPERATURE)


@query(_view_sql(_source_sql(_readings_sql(*_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY))
def view_temphum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(rollup.from_source(_readings(spark, sf_dir, *_E_CLIMATE), TEMPERATURE_HUMIDITY, DAY), TEMPERATURE_HUMIDITY)


# Sensor groups.


def _spatial_sql(of: tuple, schema: Schema) -> str:
    columns = [f"sum(abs({m.name})) AS {m.name}" if m.magnitude else f"sum({m.name}) AS {m.name}" for m in schema.gauges]
    columns += [f"sum({schema.counter}) AS {schema.counter}"] if schema.counter else []
    return f"SELECT 'all' AS sensor_id, make_timestamp((1000000 * floor(epoch(ts)))::BIGINT) AS ts, {', '.join(columns)} FROM ({_readings_sql(*of)}) GROUP BY 2"


def _seconds_sql(of: tuple, schema: Schema) -> str:
    return f"SELECT sensor_id, epoch(ts)::DOUBLE AS ts, {', '.join(f'round({m}, 4) AS {m}' for m in schema.measures)} FROM ({_spatial_sql(of, schema)})"


def _spatial(spark: SparkSession, sf_dir: str, of: tuple, schema: Schema) -> DataFrame:
    return spatial.spatial_sum(_readings(spark, sf_dir, *of), schema, "all")


def _seconds(rows: DataFrame, schema: Schema) -> DataFrame:
    return rows.select("sensor_id", F.col("ts").cast("double").alias("ts"), *(F.round(m, 4).alias(m) for m in schema.measures))


@query(_seconds_sql(_L_POWER, POWER))
def spatial_sum_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(_spatial(spark, sf_dir, _L_POWER, POWER), POWER)


@query(_seconds_sql(_E_TEMP, TEMPERATURE))
def spatial_sum_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(_spatial(spark, sf_dir, _E_TEMP, TEMPERATURE), TEMPERATURE)


@query(_seconds_sql(_E_CLIMATE, TEMPERATURE_HUMIDITY))
def spatial_sum_temphum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(_spatial(spark, sf_dir, _E_CLIMATE, TEMPERATURE_HUMIDITY), TEMPERATURE_HUMIDITY)


@query(_published_sql(_source_sql(_spatial_sql(_E_POWER, POWER), POWER, HOUR), POWER))
def spatial_then_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(rollup.from_source(_spatial(spark, sf_dir, _E_POWER, POWER), POWER, HOUR), POWER)


# Coverage.

# Hours in which a user has an event, of all users: few enough for gaps everywhere.
_COVERED = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket FROM events"
_WANTED = TimeRange(START + 1800, SPAN.end - 1800)
_GRID = f"SELECT s.sensor_id, g.bucket FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id FROM events) s, generate_series({START}, {SPAN.end - 7200}, 3600) AS g(bucket)"


def _islands_sql(buckets: str) -> str:
    return f"SELECT sensor_id, '1h' AS granularity_id, min(bucket)::BIGINT AS start, (max(bucket) + 3600)::BIGINT AS \"end\" FROM (SELECT *, bucket - 3600 * row_number() OVER (PARTITION BY sensor_id ORDER BY bucket) AS run FROM ({buckets})) GROUP BY sensor_id, run"


def _covered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hour = (F.floor(F.col("ts").cast("timestamp").cast("double") / 3600) * 3600).cast("long")
    rows = _raw(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sensor_id"), hour.alias("bucket")).distinct()
    return coverage.from_buckets(rows, HOUR), rows.select("sensor_id").distinct()


@query(_islands_sql(f"{_GRID} EXCEPT SELECT sensor_id, bucket FROM ({_COVERED})"))
def coverage_missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing(*_covered(spark, sf_dir), HOUR, _WANTED)


@query(_islands_sql(f"{_GRID} INTERSECT SELECT sensor_id, bucket FROM ({_COVERED})"))
def coverage_present_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.present(*_covered(spark, sf_dir), HOUR, _WANTED)


_MARKED = TimeRange(START + 3 * 86_400, START + 5 * 86_400)


@query(_islands_sql(f"SELECT * FROM ({_GRID} EXCEPT SELECT sensor_id, bucket FROM ({_COVERED})) WHERE bucket < {_MARKED.start} OR bucket >= {_MARKED.end}"))
def coverage_mark_then_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sensors = _covered(spark, sf_dir)
    return coverage.missing(coverage.mark(rows, sensors, HOUR, [_MARKED]), sensors, HOUR, _WANTED)


@query(_islands_sql(f"SELECT * FROM ({_COVERED}) WHERE bucket < {_MARKED.start} OR bucket >= {_MARKED.end}"))
def coverage_clear_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sensors = _covered(spark, sf_dir)
    return coverage.clear(rows, sensors, HOUR, _MARKED)


@query(f"SELECT s.sensor_id, EXISTS (SELECT 1 FROM ({_COVERED}) c WHERE c.sensor_id = s.sensor_id AND c.bucket >= {START} AND c.bucket < {START + 7200}) AS held FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sensor_id FROM events) s")
def coverage_any_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether anything of two hours is held, sensor by sensor."""
    rows, sensors = _covered(spark, sf_dir)
    held = coverage.present(rows, sensors, HOUR, TimeRange(START, START + 7200)).select("sensor_id", F.lit(True).alias("held")).distinct()
    return sensors.join(held, "sensor_id", "left").select("sensor_id", F.coalesce("held", F.lit(False)).alias("held"))


_ROUTES = [("a", "t1", 0, 7200), ("a", "t2", 7200, 14_400), ("b", "t3", 0, 100_000)]
_ASKED = [("a", 0, 7200), ("a", 3600, 10_800), ("b", 99_000, 200_000), ("c", 0, 10)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" for v in r) + ")" for r in rows)


@query(f'SELECT r.sensor_id, r.table_id, greatest(r.s, w.s) AS start, least(r.e, w.e) AS "end" FROM (VALUES {_values(_ROUTES)}) r(sensor_id, table_id, s, e) JOIN (VALUES {_values(_ASKED)}) w(sensor_id, s, e) ON r.sensor_id = w.sensor_id AND r.s < w.e AND w.s < r.e')
def interval_intersection_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame(_ROUTES, "sensor_id string, table_id string, start long, end long")
    return coverage.route(routes, spark.createDataFrame(_ASKED, "sensor_id string, start long, end long"))


# Interval algebra and choice of width, on the driver.

_NEW = [TimeRange(0, 100), TimeRange(200, 300), TimeRange(400, 500), TimeRange(600, 700), TimeRange(800, 900), TimeRange(1000, 1100)]
_RUNNING = [TimeRange(150, 180), TimeRange(250, 320), TimeRange(420, 440), TimeRange(590, 710), TimeRange(790, 850), TimeRange(1200, 1300)]


def _points(ranges: list[TimeRange]) -> str:
    return " UNION ".join(f"SELECT unnest(range({r.start}, {r.end})) AS x" for r in ranges)


@query(f'SELECT min(x)::BIGINT AS start, (max(x) + 1)::BIGINT AS "end" FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS run FROM (({_points(_NEW)}) EXCEPT ({_points(_RUNNING)}))) GROUP BY run')
def inflight_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = engines.InFlight()
    registry.claim("s", "1h", _RUNNING)
    return spark.createDataFrame([(r.start, r.end) for r in registry.claim("s", "1h", _NEW)], "start long, end long")


_LENGTHS = [60, 21_600, 21_601, 345_601, 2_678_401, 400_000_000]
_WIDTH_VALUES = _values([(g.id, g.seconds, g.display_limit, g.display_priority) for g in DEFAULTS])


@query(f"WITH g AS (SELECT * FROM (VALUES {_WIDTH_VALUES}) t(id, seconds, lim, pri)) SELECT n AS length, coalesce((SELECT id FROM g WHERE n <= lim ORDER BY pri LIMIT 1), (SELECT id FROM g ORDER BY pri DESC LIMIT 1)) AS granularity_id FROM (SELECT unnest({_LENGTHS})::BIGINT AS n)")
def granularity_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, widths.eligible(DEFAULTS, [TimeRange(0, n)]).id) for n in _LENGTHS], "length long, granularity_id string")


@query(f"WITH g AS (SELECT * FROM (VALUES {_WIDTH_VALUES}) t(id, seconds, lim, pri)) SELECT a.id AS granularity_id, (SELECT b.id FROM g b WHERE b.seconds < a.seconds ORDER BY b.seconds DESC LIMIT 1) AS smaller FROM g a")
def granularity_next_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g.id, s.id if (s := widths.next_smaller(DEFAULTS, g)) else None) for g in DEFAULTS]
    return spark.createDataFrame(rows, "granularity_id string, smaller string")


# Intent.

_STATEMENTS = [
    ("plain", "SELECT 'x' AS meta_data, power FROM power WHERE sensor_id = 'p1' AND ts >= 1000 AND ts < 2000"),
    ("in", """SELECT '{"meta_data":"specified_granularity","specified_granularity":"1h"}' AS meta_data, power FROM power WHERE sensor_id IN ('p1', 'p2', 'nobody') AND ts BETWEEN 1000 AND 1999 ORDER BY ts"""),
    ("or", "SELECT power FROM power WHERE (sensor_id = 'p1' AND 1000 <= ts AND ts < 2000) OR (sensor_id = 'p2' AND ts > 4999 AND ts < 6000 + 500)"),
    ("not", "SELECT power FROM power WHERE NOT (sensor_id <> 'p2') AND NOT (ts < 3000) AND ts <= 3999"),
    ("clean", """SELECT '{"meta_data":"clean_cache","specified_granularity":"%"}' AS meta_data, power FROM power WHERE sensor_id = 'p2' AND ts >= 0 AND ts < 3600"""),
]
_EXPECTED = [
    ("plain", "p1", 1000, 2000, "from_cache", ""), ("in", "p1", 1000, 2000, "specified_granularity", "1h"), ("in", "p2", 1000, 2000, "specified_granularity", "1h"),
    ("or", "p1", 1000, 2000, "from_cache", ""), ("or", "p2", 5000, 6500, "from_cache", ""), ("not", "p2", 3000, 4000, "from_cache", ""), ("clean", "p2", 0, 3600, "clean_cache", "%"),
]


@query(f'SELECT * FROM (VALUES {_values(_EXPECTED)}) t(name, sensor_id, start, "end", mode, granularity_id)')
def intent_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, sql in _STATEMENTS:
        found = intents.extract(spark, sql, {"p1": "power", "p2": "power", "t1": "temperature"}, TimeRange(0, 10_000), 9_000)
        rows += [(name, s, r.start, r.end, found.mode, found.granularity or "") for s, ranges in found.ranges.items() for r in ranges]
    return spark.createDataFrame(rows, "name string, sensor_id string, start long, end long, mode string, granularity_id string")


# Tiers and the engine. The law of reading through is the oracle: whatever the tiers hold, the answer is the direct one.

KINDS = ("click", "error", "purchase", "signup", "view")
WINDOW = SPAN
_DIRECT = _readings_sql("events", "event_type", TEMPERATURE, EVENT_CLIMATE, f"epoch(ts) >= {WINDOW.start} AND epoch(ts) < {WINDOW.end}")


def _engine(spark: SparkSession, sf_dir: str) -> engines.Engine:
    base = shared_folder(spark)
    source, split = Route("readings", SPAN), START + 10 * 86_400
    second = (Route("sl_a", TimeRange(SPAN.start, split)), Route("sl_b", TimeRange(split, SPAN.end)))
    names = [r[0] for r in _raw(spark, sf_dir, "events").select("event_type").distinct().collect()]  # event types, a handful
    sensors = {n: Sensor(n, "temperature", (source,), second) for n in names}
    sensors["everything"] = SensorGroup("everything", "temperature", (), second, tuple(sorted(names)))
    tables = {t: Table(t, "temperature", t) for t in ("readings", "sl_a", "sl_b")}

    def read(table: str) -> DataFrame:
        return _raw(spark, sf_dir, "events").select(F.col("event_type").alias("sensor_id"), "ts", F.expr(EVENT_CLIMATE["temperature"]).alias("temperature"))

    return engines.Engine(spark, Config(SPAN, DEFAULTS, {}, tables, sensors).validated(), f"{base}/tiers-{uuid.uuid4().hex}", read, now=lambda: SPAN.end)


def _ask(engine: engines.Engine, width: str, wanted: TimeRange, *, groups: bool = False) -> intents.QueryIntent:
    names = [s.id for s in engine.config.sensors.values() if isinstance(s, SensorGroup) == groups]
    return intents.QueryIntent("temperature", {n: [wanted] for n in names}, intents.SPECIFIED, width)


_DIRECT_DAY = _published_sql(_source_sql(_DIRECT, TEMPERATURE, DAY), TEMPERATURE)
_DIRECT_HOUR = _published_sql(_source_sql(_DIRECT, TEMPERATURE, HOUR), TEMPERATURE)


@query(_DIRECT_HOUR)
def tier_copy_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level lost, the second level still holds the width asked for: its rows are taken as they are."""
    engine = _engine(spark, sf_dir)
    engine.warm(_ask(engine, "1h", WINDOW))
    engine.first_level(TEMPERATURE).truncate()
    engine.read_table = None  # the source must not be needed
    return _published(engine.query(_ask(engine, "1h", WINDOW)), TEMPERATURE)


@query(_DIRECT_DAY)
def tier_fill_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from hours where the second level has whole days of them, from readings elsewhere, some days held already."""
    engine = _engine(spark, sf_dir)
    engine.warm(_ask(engine, "1h", TimeRange(START + 2 * 86_400 + 7200, START + 8 * 86_400 + 3600)))
    engine.warm(_ask(engine, "1d", TimeRange(START + 15 * 86_400, START + 17 * 86_400)))
    return _published(engine.query(_ask(engine, "1d", WINDOW)), TEMPERATURE)


@query(_DIRECT_HOUR)
def cache_invalidate_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.warm(_ask(engine, "1h", WINDOW))
    sql = f"""SELECT '{{"meta_data":"clean_cache","specified_granularity":"%"}}' AS meta_data, temperature FROM temperature WHERE ts >= {START + 5400} AND ts < {START + 90_000}"""
    engine.query(sql)
    return _published(engine.query(_ask(engine, "1h", WINDOW)), TEMPERATURE)


_PER_SENSOR = f"SELECT * FROM ({_DIRECT}) WHERE sensor_id = 'click' AND epoch(ts) < {START + 3600}", f"SELECT * FROM ({_DIRECT}) WHERE sensor_id = 'view'"


@query(" UNION ALL ".join(_published_sql(_source_sql(of, TEMPERATURE, g), TEMPERATURE) for of, g in zip(_PER_SENSOR, (MINUTE, DAY))))
def engine_width_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of one sensor and all days of another, no width named: each at its own."""
    asked = intents.QueryIntent("temperature", {"view": [WINDOW], "click": [TimeRange(START, START + 3600)]}, intents.FROM_CACHE, None)
    return _published(_engine(spark, sf_dir).query(asked), TEMPERATURE)


@query(_published_sql(_source_sql(f"SELECT * FROM ({_DIRECT}) WHERE sensor_id <> 'click'", TEMPERATURE, DAY), TEMPERATURE))
def engine_failure_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor's source cannot be read: the others are answered."""
    engine = _engine(spark, sf_dir)
    read, click = engine.read_table, engine.config.sensors["click"]
    engine.config.tables["broken"] = Table("broken", "temperature", "broken")
    engine.config.sensors["click"] = Sensor("click", "temperature", (Route("broken", SPAN),), click.second_level)
    engine.read_table = lambda table: spark.read.parquet(f"{sf_dir}/no such table") if table == "broken" else read(table)
    return _published(engine.query(_ask(engine, "1d", WINDOW)), TEMPERATURE)


_GROUP_SECONDS = f"SELECT 'everything' AS sensor_id, make_timestamp((1000000 * floor(epoch(ts)))::BIGINT) AS ts, sum(temperature) AS temperature FROM ({_DIRECT}) GROUP BY 2"


@query(_published_sql(_rollup_sql(_source_sql(_GROUP_SECONDS, TEMPERATURE, QUARTER), TEMPERATURE, HOUR), TEMPERATURE))
def engine_group_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    return _published(engine.query(_ask(engine, "1h", WINDOW, groups=True)), TEMPERATURE)


@query(_view_sql(_source_sql(_DIRECT.replace("WHERE", "WHERE event_type IN ('click', 'view') AND"), TEMPERATURE, HOUR), TEMPERATURE))
def engine_dashboard_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From SQL text to served averages."""
    sql = f"""SELECT '{{"meta_data":"specified_granularity","specified_granularity":"1h"}}' AS meta_data, temperature FROM temperature WHERE sensor_id IN ('click', 'view') AND ts >= {WINDOW.start} AND ts < {WINDOW.end}"""
    return _viewed(_engine(spark, sf_dir).query(sql), TEMPERATURE)


@query(f"SELECT sensor_id, start, \"end\", '{SECOND_LEVEL}' AS kind FROM (SELECT 'x' AS sensor_id, 86400::BIGINT AS start, 172800::BIGINT AS \"end\")")
def plan_whole_buckets_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that cover part of a day are not reused for it."""
    from tidemark.plans.planner import second_level_pieces

    held = {"1h": [TimeRange(80_000 // 3600 * 3600, 200_000 // 3600 * 3600)]}
    pieces, _ = second_level_pieces("x", [Route("sl", TimeRange(0, 10**6))], [TimeRange(0, 3 * 86_400)], DAY, DEFAULTS, lambda t, s, g: held.get(g.id, []))
    return spark.createDataFrame([("x", p.during.start, p.during.end, p.kind) for p in pieces], "sensor_id string, start long, end long, kind string")


# Streaming (an addition): the same rollup, record by record.


@query(_published_sql(_source_sql(_readings_sql("events", "event_type", TEMPERATURE, EVENT_CLIMATE), TEMPERATURE, HOUR), TEMPERATURE))
def stream_rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = _raw(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    readings = canonical(stream.select(F.col("event_type").alias("sensor_id"), "ts", F.expr(EVENT_CLIMATE["temperature"]).alias("temperature")), TEMPERATURE)
    name = f"stream_{uuid.uuid4().hex}"
    running = rollup_stream(readings, TEMPERATURE, HOUR).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return _published(spark.table(name), TEMPERATURE)
