from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.granularity import DEFAULTS, Granularity, eligible, next_smaller, resolve
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import POWER, TEMPERATURE, TEMPERATURE_HUMIDITY, schema
from tidemark.operators import rollup, spatial
from tidemark.sources.readings import canonical, in_range, rename_vendor

MINUTE, QUARTER, HOUR, DAY = DEFAULTS


def power(spark, rows):
    """(sensor, epoch, value for every gauge, counter)"""
    raw = spark.createDataFrame(rows, "sensor_id string, ts double, x double, energy_consumed double")
    return canonical(raw.select("sensor_id", "ts", *(F.col("x").alias(g.name) for g in POWER.gauges), "energy_consumed"), POWER)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.withColumn("ts", F.col("ts").cast("double")).collect())


READINGS = [("a", 0.0, -2.0, 10.0), ("a", 900.5, 0.0, 11.0), ("a", 3599.999, 4.0, 13.0), ("a", 3600.0, None, 20.0), ("a", 7200.0, 0.0, 5.0), ("b", 10.0, 1.0, 1.0)]


def test_source_rollup(spark):
    out = rollup.from_source(power(spark, READINGS), POWER, HOUR)
    got = rows_of(out, "sensor_id", "ts", "sum_power_1", "min_power_1", "max_power_1", "energy_consumed", "slot_energy_consumed", "count_agg_rows")
    assert got == [("a", 0.0, 6.0, 0.0, 4.0, 13.0, 3.0, 3), ("a", 3600.0, None, None, None, 20.0, 0.0, 1), ("a", 7200.0, 0.0, 0.0, 0.0, 5.0, 0.0, 1), ("b", 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1)]
    assert rows_of(out, "sensor_id", "ts", "non_zero_min_power_factor_2") == [("a", 0.0, 2.0), ("a", 3600.0, None), ("a", 7200.0, None), ("b", 0.0, 1.0)]
    assert out.columns == ["sensor_id", "ts", *POWER.rollup_columns, "granularity_id"]


@pytest.mark.parametrize("of", [POWER, TEMPERATURE, TEMPERATURE_HUMIDITY], ids=lambda s: s.name)
def test_rolling_up_in_two_steps_is_rolling_up_at_once(spark, of):
    raw = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 3).alias("sensor_id"), (F.col("id") * 977 % 90_000).cast("double").alias("ts"), *((F.col("id") * (i + 3) % 41 - 20).cast("double").alias(m) for i, m in enumerate(of.measures)))
    readings = canonical(raw, of)
    once, (_, twice) = rollup.from_source(readings, of, DAY), rollup.two_stage(readings, of, HOUR, DAY)
    slot = f"slot_{of.counter}"
    same = [c for c in once.columns if c != slot]
    assert sorted(map(str, once.select(same).collect())) == sorted(map(str, twice.select(same).collect()))
    if of.counter:
        exact = rollup.from_rollup(rollup.from_source(readings, of, HOUR), of, DAY, exact_slots=True)
        assert sorted(map(str, once.select("sensor_id", "ts", slot).collect())) == sorted(map(str, exact.select("sensor_id", "ts", slot).collect()))


def test_slots_of_slots_leave_out_what_passed_between(spark):
    fine = rollup.from_source(power(spark, READINGS), POWER, HOUR)
    day = rows_of(rollup.from_rollup(fine, POWER, DAY), "sensor_id", "slot_energy_consumed")
    exact = rows_of(rollup.from_rollup(fine, POWER, DAY, exact_slots=True), "sensor_id", "slot_energy_consumed")
    assert day == [("a", 3.0), ("b", 0.0)] and exact == [("a", -5.0), ("b", 0.0)]


def test_repeated_times_take_the_greater_counter(spark):
    out = rollup.from_source(power(spark, [("a", 0.0, 1.0, 3.0), ("a", 0.0, 1.0, 9.0), ("a", 0.0, 1.0, 5.0)]), POWER, HOUR, unique_ts=False)
    assert rows_of(out, "energy_consumed", "slot_energy_consumed") == [(9.0, 6.0)]


def test_unique_times_stay_on_the_hash_aggregate(spark):
    plan = rollup.from_source(power(spark, READINGS), POWER, HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_offset_moves_the_buckets(spark):
    out = rollup.from_source(power(spark, [("a", 1800.0, 1.0, 1.0), ("a", 5399.0, 1.0, 1.0), ("a", 5400.0, 1.0, 1.0)]), POWER, HOUR, offset=1800)
    assert rows_of(out, "ts", "count_agg_rows") == [(1800.0, 2), (5400.0, 1)]


def test_views(spark):
    view = rollup.serving_view(rollup.from_source(power(spark, READINGS), POWER, HOUR), POWER)
    assert view.columns == ["granularity", "sensor_id", "ts", "energy_consumed", "slot_energy_consumed", "max_power", "min_power", "power", "voltage", "current", "agg_row_count"]
    assert rows_of(view, "sensor_id", "ts", "power")[0] == ("a", 0.0, 2.0)
    climate = spark.createDataFrame([("a", 0.0, 10.0, None, 3.0), ("a", 1.0, 20.0, 4.0, 3.0)], "sensor_id string, ts double, temperature double, humidity double, battery_voltage double")
    view = rollup.serving_view(rollup.from_source(canonical(climate, TEMPERATURE_HUMIDITY), TEMPERATURE_HUMIDITY, HOUR), TEMPERATURE_HUMIDITY)
    assert rows_of(view, "temperature", "humidity", "battery_voltage", "min_temperature") == [(15.0, 2.0, 3.0, 10.0)]  # a null lowers the average


def test_spatial_sum_unites_sources_of_different_width(spark):
    wide = power(spark, [("a", 5.2, -1.0, 1.0)]).withColumn("frequency", F.lit(50.0))
    narrow = power(spark, [("b", 5.9, 2.0, 4.0), ("b", 6.0, 7.0, 5.0)])
    out = spatial.spatial_sum(spatial.union_members([wide, narrow], POWER), POWER, "both")
    assert rows_of(out, "sensor_id", "ts", "power_1", "energy_consumed") == [("both", 5.0, 3.0, 5.0), ("both", 6.0, 7.0, 5.0)]
    with pytest.raises(ValueError):
        spatial.spatial_sum(narrow, POWER, "both", "median")


def test_widths():
    assert eligible(DEFAULTS, [TimeRange(0, 6 * 3600)]).id == "1m"
    assert eligible(DEFAULTS, [TimeRange(0, 6 * 3600), TimeRange(10**6, 10**6 + 1)]).id == "15m"
    assert eligible(DEFAULTS, [TimeRange(0, 10**10)]).id == "1d"
    assert next_smaller(DEFAULTS, HOUR) == QUARTER and next_smaller(DEFAULTS, MINUTE) is None
    assert resolve(DEFAULTS, "1H", []) == HOUR and resolve(DEFAULTS, "other", [TimeRange(0, 60)]) == MINUTE
    with pytest.raises(ValueError):
        schema("pressure")
    with pytest.raises(ValueError):
        rollup.two_stage(None, POWER, Granularity("7m", "7 minutes", 420, 1, 1), HOUR)


def test_source_adapters(spark):
    raw = spark.createDataFrame([("old", "new", 1.5, 230.0)], "sensor_id string, new_sensor_id string, TS double, V1 double")
    assert rename_vendor(raw).columns == ["sensor_id", "ts", "voltage_1"]
    assert rename_vendor(raw).first()["sensor_id"] == "new"
    zoneless = spark.sql("SELECT 'a' AS sensor_id, TIMESTAMP_NTZ '2024-01-01 00:30:00.25' AS ts, 1.0D AS temperature")
    assert canonical(zoneless, TEMPERATURE).select(F.col("ts").cast("double")).first()[0] == datetime(2024, 1, 1, 0, 30, 0, 250_000, tzinfo=timezone.utc).timestamp()
    held = in_range(zoneless, ["a"], TimeRange(1_704_069_000, 1_704_069_001))
    assert held.count() == 1 and in_range(zoneless, ["a"], TimeRange(1_704_069_001, 1_704_070_000)).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT 'a' AS sensor_id, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS ts, 1.0D AS temperature, 'x' AS other").write.parquet(str(tmp_path / "t"))
    rows = in_range(spark.read.parquet(str(tmp_path / "t")), ["a"], TimeRange(0, 2 * 10**9))
    plan = rollup.from_source(canonical(rows, TEMPERATURE), TEMPERATURE, HOUR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "other" not in plan.split("ReadSchema")[1]
