import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions.granularity import DEFAULTS
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import TEMPERATURE
from tidemark.operators import coverage
from tidemark.plans.engine import Engine, InFlight
from tidemark.plans.intent import CLEAN, SPECIFIED, QueryIntent
from tidemark.plans.planner import second_level_pieces, source_pieces
from tidemark.sources import config
from tidemark.sources.config import Config, ConfigError, Route, Sensor, SensorGroup, Table

MINUTE, QUARTER, HOUR, DAY = DEFAULTS
SPAN = TimeRange(0, 10 * 86_400)
SPLIT = 43_200


@pytest.fixture
def engine(spark, tmp_path):
    raw = spark.range(0, 3 * 86_400, 600).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sensor_id"), F.col("id").cast("double").alias("ts"), (F.col("id") % 977).cast("double").alias("temperature"))
    reads = []

    def read(table):
        reads.append(table)
        return raw

    routes = (Route("r1", TimeRange(0, SPLIT)), Route("r2", TimeRange(SPLIT, 3 * 86_400)))
    second = (Route("sl", SPAN),)
    sensors = {s: Sensor(s, "temperature", routes, second) for s in ("a", "b")} | {"g": SensorGroup("g", "temperature", (), second, ("a", "b"))}
    tables = {t: Table(t, "temperature", t) for t in ("r1", "r2", "sl")}
    made = Engine(spark, Config(SPAN, DEFAULTS, {}, tables, sensors).validated(), str(tmp_path / "tiers"), read, now=lambda: 4 * 86_400)
    made.reads = reads
    return made


def ask(width, *ranges, sensors=("a",), mode=SPECIFIED):
    return QueryIntent("temperature", {s: [TimeRange(*r) for r in ranges] for s in sensors}, mode, width)


def answer(df):
    return sorted((r["sensor_id"], r["ts"], r["sum_temperature"], r["count_agg_rows"]) for r in df.withColumn("ts", F.col("ts").cast("long")).collect())


def direct(lo, hi, width=3600, factor=1, sensor="a"):
    out = {}
    for t in range(0, 3 * 86_400, 600):
        if lo <= t < hi:
            s, n = out.get(t // width * width, (0, 0))
            out[t // width * width] = (s + factor * (t % 977), n + 1)
    return [(sensor, t, float(s), n) for t, (s, n) in sorted(out.items())]


def test_answers_are_direct_whatever_the_tiers_hold(engine):
    assert answer(engine.query(ask("1h", (7200, 90_000)))) == direct(7200, 90_000)  # empty tiers, two routes
    n = len(engine.reads)
    assert answer(engine.query(ask("1h", (7200, 90_000)))) == direct(7200, 90_000)  # all held
    assert len(engine.reads) == n
    assert answer(engine.query(ask("1h", (0, 100_000)))) == direct(0, 97_200)  # partly held; the open hour stays out
    assert answer(engine.query(ask("1d", (0, 2 * 86_400)))) == direct(0, 2 * 86_400, 86_400)  # first day from hours
    stored = engine.first_level(TEMPERATURE).rows.read()
    assert stored.count() == stored.select("sensor_id", "granularity_id", "ts").distinct().count()


def test_finer_rows_that_cover_part_of_a_bucket_are_not_reused(engine):
    engine.warm(ask("15m", (36_000 + 1200, 36_000 + 2400 + 600)))
    assert answer(engine.query(ask("1h", (36_000, 39_600)))) == direct(36_000, 39_600)


def test_group_sums_members_first(engine):
    got = answer(engine.query(ask("1h", (0, 7200), sensors=("g",))))
    assert got == [("g", t, s, n) for _, t, s, n in direct(0, 7200, factor=2)]


def test_invalidation_takes_rows_and_coverage_together(engine):
    engine.warm(ask("1h", (0, 14_400)))
    engine.query(ask("%", (5400, 9000), mode=CLEAN))
    held = engine.first_level(TEMPERATURE).coverage(["a"])["a", "1h"]
    assert held == [TimeRange(0, 3600), TimeRange(10_800, 14_400)]
    assert [t for _, t, _, _ in answer(engine.first_level(TEMPERATURE).read(["a"], HOUR, SPAN))] == [0, 10_800]
    assert answer(engine.query(ask("1h", (0, 14_400)))) == direct(0, 14_400)
    engine.first_level(TEMPERATURE).compact_coverage()
    assert engine.missing({"a": [TimeRange(0, 14_400)]}, TEMPERATURE, HOUR) == {}


def test_unrouted_ranges_are_not_marked_and_empty_routed_ones_are(engine):
    engine.query(ask("1h", (3 * 86_400 - 3600, 3 * 86_400 + 7200)))
    assert engine.missing({"a": [TimeRange(3 * 86_400 - 3600, 3 * 86_400 + 7200)]}, TEMPERATURE, HOUR) == {"a": [TimeRange(3 * 86_400, 3 * 86_400 + 7200)]}


def test_a_failure_leaves_nothing_covered_and_nothing_claimed(engine):
    read, engine.read_table = engine.read_table, None
    assert isinstance(engine.warm(ask("1h", (0, 7200)))["a"], TypeError)
    with pytest.raises(TypeError):
        engine.query(ask("1h", (0, 7200)))
    assert engine.in_flight.snapshot() == {}
    engine.read_table = read
    assert answer(engine.query(ask("1h", (0, 7200)))) == direct(0, 7200)


def test_the_log_is_rewritten_without_loss(engine, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "LOG_FILES", 3)
    tier = engine.first_level(TEMPERATURE)
    for k in range(10):
        tier.change_coverage([("a", HOUR, TimeRange(k * 3600, (k + 1) * 3600), True), ("b", HOUR, TimeRange(0, 36_000), True)])
        tier.change_coverage([("b", HOUR, TimeRange(k * 3600, (k + 1) * 3600), False)])
    assert tier.coverage(["a"]) == {("a", "1h"): [TimeRange(0, 36_000)]}
    assert tier.coverage(["b"]) == {("b", "1h"): [TimeRange(0, 32_400)]} and len(tier._log_files()) <= 4


def test_many_at_once(engine):
    sql = "SELECT '{\"meta_data\":\"specified_granularity\",\"specified_granularity\":\"1h\"}' AS meta_data, temperature FROM temperature WHERE sensor_id = 'a' AND ts >= 0 AND ts < 7200"
    errors = engine.warm_all([sql, sql, "SELECT 1"])
    assert errors[:2] == [None, None] and errors[2] is not None
    assert answer(engine.first_level(TEMPERATURE).read(["a"], HOUR, SPAN)) == direct(0, 7200)


def test_in_flight_ranges_are_claimed_once_per_width():
    held = InFlight()
    first = held.claim("a", "1h", [TimeRange(0, 10)])
    assert held.claim("a", "1h", [TimeRange(5, 20)]) == [TimeRange(10, 20)]
    assert held.claim("a", "1d", [TimeRange(5, 20)]) == [TimeRange(5, 20)]
    done = threading.Event()
    waiting = threading.Thread(target=lambda: (held.wait("a", "1h", [TimeRange(0, 10)]), done.set()))
    waiting.start()
    assert not done.wait(0.05)
    held.release("a", "1h", first)
    assert done.wait(2)
    waiting.join()


def test_planner():
    held = {"1h": [TimeRange(0, 90_000)], "1d": []}
    pieces, rest = second_level_pieces("a", [Route("sl", TimeRange(0, 10**6))], [TimeRange(0, 2 * 86_400)], DAY, DEFAULTS, lambda t, s, g: held.get(g.id, []))
    assert [(p.granularity.id, p.during) for p in pieces] == [("1h", TimeRange(0, 86_400))] and rest == [TimeRange(86_400, 2 * 86_400)]
    routes = (Route("x", TimeRange(0, 7200)), Route("y", TimeRange(7200, 14_400)))
    conf = Config(SPAN, DEFAULTS, {}, {t: Table(t, "temperature", t) for t in "xy"}, {"a": Sensor("a", "temperature", routes)})
    assert [(p.tables, p.during) for p in source_pieces(conf, "a", [TimeRange(0, 20_000)], HOUR)] == [(("x",), TimeRange(0, 7200)), (("y",), TimeRange(7200, 14_400))]


def test_coverage_against_sets(spark):
    sensors = spark.createDataFrame([("a",), ("b",)], "sensor_id string")
    held = spark.createDataFrame([("a", "1h", b * 3600, (b + 1) * 3600) for b in (0, 1, 4)] + [("a", "1h", 0, 3600), ("a", "1d", 0, 86_400)], coverage.COLUMNS)
    wanted = TimeRange(1800, 6 * 3600 + 1)

    def found(df):
        return sorted((r["sensor_id"], r["start"] // 3600, r["end"] // 3600) for r in df.collect())

    assert found(coverage.missing(held, sensors, HOUR, wanted)) == [("a", 2, 4), ("a", 5, 6), ("b", 0, 6)]
    assert found(coverage.present(held, sensors, HOUR, wanted)) == [("a", 0, 2), ("a", 4, 5)]
    marked = coverage.mark(held, sensors, HOUR, [TimeRange(7200, 14_400)])
    assert found(coverage.missing(marked, sensors, HOUR, wanted)) == [("a", 5, 6), ("b", 0, 2), ("b", 4, 6)]
    assert found(coverage.present(coverage.clear(held, sensors, HOUR, TimeRange(0, 3600)), sensors, HOUR, wanted)) == [("a", 1, 2), ("a", 4, 5)]
    assert coverage.any_present(held, sensors, HOUR, wanted) and not coverage.any_present(held, sensors, HOUR, TimeRange(7200, 14_400))


RAW = {
    "bitmapStartTime": "01/01/2024", "bitmapEndTime": "2025-01-01T00:00:00Z",
    "granularities": [{"granularityId": "1h", "windowDuration": "1 hour", "displayLimitInSeconds": 1000, "inTermsOfSeconds": 3600, "displayPriority": 1}],
    "databases": [{"databaseId": "d", "databaseType": "derby", "databaseName": "x", "host": "localhost", "port": 1}],
    "flCacheTables": [{"tableId": "fl", "databaseId": "d", "schemaType": "power", "tableName": "power_cache"}],
    "sourceTables": [{"tableId": "src", "databaseId": "d", "schemaType": "power", "tableName": "meter", "tsColumnName": "TS"}],
    "sensors": [{"sensorId": "a", "flCacheTableId": "fl", "sourceTableIds": [{"tableId": "src", "startTime": "01/01/2024", "endTime": "01/02/2024"}]}],
    "sensorGroups": [{"sensorId": "g", "flCacheTableId": "fl", "spatialAggFunction": "SUM", "sensors": ["a"]}],
}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(RAW))
    read = config.load(str(tmp_path / "c.json"))
    assert read.origin.start == 1_704_067_200 and read.granularities[0].seconds == 3600
    assert read.sensors["g"].members == ("a",) and read.tables["src"].ts_column == "TS"
    assert read.databases["d"].jdbc_options()["url"] == "jdbc:derby://localhost:1/x"
    for broken in (
        {"sensorGroups": [RAW["sensorGroups"][0] | {"sensors": []}]},
        {"sensorGroups": [RAW["sensorGroups"][0] | {"sensors": ["nobody"]}]},
        {"sourceTables": [RAW["sourceTables"][0] | {"schemaType": "temperature"}]},
        {"flCacheTables": [RAW["flCacheTables"][0] | {"schemaType": "noise"}]},
        {"databases": []},
    ):
        with pytest.raises(ConfigError):
            config.parse(RAW | broken)
