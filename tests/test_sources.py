from pyspark.sql import functions as F

from tidemark.functions.granularity import DEFAULTS
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import TEMPERATURE
from tidemark.sources import query_log, readings, store
from tidemark.sources.config import Table
from tidemark.streaming.rollup import follow_log, into_tier, rollup_stream


def test_jdbc_round_trip(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.lit("a").alias("SENSOR_ID"), F.col("id").cast("double").alias("TS"), F.col("id").cast("double").alias("TEMPERATURE"))
    readings.append_jdbc(rows, options | {"createTableColumnTypes": "SENSOR_ID VARCHAR(30)"}, "METER")  # the default is not comparable
    readings.append_jdbc(rows.limit(0), options, "METER")
    back = readings.read_jdbc(spark, options, Table("m", "temperature", "METER", None, "SENSOR_ID", "TS"), TimeRange(0, 100), 4)
    assert back.rdd.getNumPartitions() == 4
    held = readings.in_range(back, ["a"], TimeRange(10, 20), "SENSOR_ID", "TS")
    assert "PushedFilters" in held._jdf.queryExecution().executedPlan().toString()
    assert readings.canonical(held, TEMPERATURE, "SENSOR_ID", "TS").count() == 10


def test_query_log(spark):
    log = spark.createDataFrame(
        [(1, "select\n 'x'  as meta_data", "Query"), (2, "select meta_data ignore_cache", "Query"), (3, "meta_data from general_log", "Query"), (4, "meta_data", "Connect"), (5, None, "Query"), (6, "meta_data", "Query")],
        "event_time int, argument string, command_type string",
    ).withColumn("user_host", F.lit("h"))
    found = query_log.new_queries(log, F.lit(0), F.lit(6)).collect()
    assert [(r["event_time"], r["argument"]) for r in found] == [(1, "select 'x' as meta_data")]
    assert query_log.expire(log, F.lit(5)).count() == 2


def tier(spark, path):
    return store.Tier(spark, str(path), "t", TEMPERATURE)


def rollups(spark, rows):
    return spark.createDataFrame(rows, "sensor_id string, t long, v double").select("sensor_id", F.timestamp_seconds("t").alias("ts"), *(F.col("v").alias(f"{a}_temperature") for a in ("sum", "min", "max")), F.lit(1).cast("long").alias("count_agg_rows"), F.lit("1h").alias("granularity_id"))


def held(t):
    return sorted((r["sensor_id"], r["ts"].timestamp(), r["sum_temperature"]) for r in t.rows.read().collect())


def test_writes_are_keyed_and_keep_other_rows_of_the_day(spark, tmp_path):
    t = tier(spark, tmp_path)
    assert held(t) == []
    t.write(rollups(spark, [("a", 0, 1.0), ("b", 0, 2.0), ("a", 86_400, 3.0)]))
    t.write(rollups(spark, [("a", 0, 9.0), ("a", 3600, 4.0)]))
    t.write(rollups(spark, [("a", 0, 9.0), ("a", 3600, 4.0)]))
    assert [(s, v) for s, _, v in held(t)] == [("a", 9.0), ("a", 4.0), ("a", 3.0), ("b", 2.0)]
    t.delete(["a"], DEFAULTS[2], TimeRange(0, 90_000))
    assert [(s, v) for s, _, v in held(t)] == [("b", 2.0)]
    t.truncate()
    assert held(t) == []


def test_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    import threading

    # Two stores of one path, as two processes have them; each keeps the other's rows of the same day.
    first, second = tier(spark, tmp_path), tier(spark, tmp_path)
    first.write(rollups(spark, [("z", 0, 0.0)]))
    writers = [threading.Thread(target=t.write, args=(rollups(spark, [(name, 3600 * k, 1.0)]),)) for k, (t, name) in enumerate([(first, "a"), (second, "b"), (first, "c"), (second, "d")])]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [s for s, _, _ in held(first)] == ["a", "b", "c", "d", "z"]
    # A lock that a crash left is broken in time.
    monkeypatch.setattr(store, "LOCK_SECONDS", 0)
    (tmp_path / "t" / TEMPERATURE.name / "rows__lock").touch()
    second.delete(["a"], DEFAULTS[2], TimeRange(0, 90_000))
    assert [s for s, _, _ in held(first)] == ["b", "c", "d", "z"]


def test_stream_into_tier_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.lit("a").alias("sensor_id"), F.timestamp_seconds(F.col("id") * 90).alias("ts"), F.col("id").cast("double").alias("temperature"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    t = tier(spark, tmp_path / "tiers")
    into_tier(rollup_stream(stream, TEMPERATURE, DEFAULTS[2]), t, str(tmp_path / "cp"), DEFAULTS[2]).awaitTermination()
    assert sum(v for _, _, v in held(t)) == sum(range(200)) and len(held(t)) == 5 and t.coverage(["a"]) == {}


def test_closed_windows_of_a_stream_are_covered(spark, tmp_path):
    rows = spark.range(200).select(F.lit("a").alias("sensor_id"), F.timestamp_seconds(F.col("id") * 90).alias("ts"), F.col("id").cast("double").alias("temperature"))
    rows.write.parquet(str(tmp_path / "in"))
    t, stream = tier(spark, tmp_path / "tiers"), spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run closes what the first run's watermark allows, and repeats nothing
        into_tier(rollup_stream(stream, TEMPERATURE, DEFAULTS[2]), t, str(tmp_path / "cp"), DEFAULTS[2], ["a", "b"], 0).awaitTermination()
    last = max(at for _, at, _ in held(t))
    assert t.coverage(["a"]) == {("a", "1h"): [TimeRange(0, int(last) + 3600)]} and t.coverage(["b"])["b", "1h"] == t.coverage(["a"])["a", "1h"]
    assert len(held(t)) == last // 3600 + 1 < 5


def test_following_the_log(spark, tmp_path):
    log = spark.createDataFrame([("select 'x' as meta_data", "Query"), ("other", "Query")], "argument string, command_type string")
    log.write.parquet(str(tmp_path / "log"))
    seen = []
    follow_log(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), seen.extend, str(tmp_path / "cp")).awaitTermination()
    assert seen == ["select 'x' as meta_data"]


def test_granularity_table(spark, tmp_path):
    store.save_granularities(spark, DEFAULTS, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
