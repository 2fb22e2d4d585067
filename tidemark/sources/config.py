"""Configuration: databases, tables, sensors, groups and widths, from JSON, checked on load."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from tidemark.functions.granularity import DEFAULTS, Granularity
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import REGISTRY


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Database:
    id: str
    kind: str
    name: str
    host: str
    port: int
    user: str = ""
    password: str = field(default="", repr=False)

    def jdbc_options(self, driver: str | None = None) -> dict[str, str]:
        options = {"url": f"jdbc:{self.kind}://{self.host}:{self.port}/{self.name}", "user": self.user, "password": self.password}
        return options | ({"driver": driver} if driver else {})


@dataclass(frozen=True)
class Table:
    id: str
    schema: str
    name: str
    database: str | None = None
    sensor_column: str = "sensor_id"
    ts_column: str = "ts"


@dataclass(frozen=True)
class Route:
    """A table that serves a sensor for a range of time."""

    table: str
    during: TimeRange


@dataclass(frozen=True)
class Sensor:
    id: str
    schema: str
    sources: tuple[Route, ...] = ()
    second_level: tuple[Route, ...] = ()


@dataclass(frozen=True)
class SensorGroup(Sensor):
    """A virtual sensor: the spatial aggregate of its members' readings."""

    members: tuple[str, ...] = ()
    function: str = "sum"


@dataclass(frozen=True)
class Config:
    origin: TimeRange
    granularities: tuple[Granularity, ...] = DEFAULTS
    databases: dict[str, Database] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    sensors: dict[str, Sensor] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)

    def validated(self) -> Config:
        for s in self.sensors.values():
            _need(s.schema in REGISTRY, f"{s.id}: unknown schema {s.schema!r}")
            for route in (*s.sources, *s.second_level):
                _need(route.table in self.tables, f"{s.id}: unknown table {route.table!r}")
                _need(self.tables[route.table].schema == s.schema, f"{s.id}: table {route.table} has another schema")
            if isinstance(s, SensorGroup):
                _need(bool(s.members), f"{s.id}: a group needs members")
                for m in s.members:
                    _need(m in self.sensors and not isinstance(self.sensors[m], SensorGroup), f"{s.id}: unknown member {m!r}")
                    _need(self.sensors[m].schema == s.schema, f"{s.id}: member {m} has another schema")
        _need(bool(self.granularities), "no granularity")
        return self


def _need(holds: bool, otherwise: str) -> None:
    if not holds:
        raise ConfigError(otherwise)


def epoch(text: str | int | float) -> int:
    """Epoch seconds of a number, an ISO-8601 date or time (UTC if it names no zone), or ``dd/MM/yyyy``."""
    if isinstance(text, (int, float)):
        return int(text)
    try:
        when = datetime.fromisoformat(text)
    except ValueError:
        when = datetime.strptime(text, "%d/%m/%Y")
    return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())


def _routes(items: list[dict]) -> tuple[Route, ...]:
    return tuple(Route(r["tableId"], TimeRange(epoch(r["startTime"]), epoch(r["endTime"]))) for r in items)


def parse(raw: dict) -> Config:
    databases = {d["databaseId"]: Database(d["databaseId"], d["databaseType"], d["databaseName"], d["host"], int(d["port"]), d.get("username", ""), d.get("password", "")) for d in raw.get("databases", [])}
    tables = {
        t["tableId"]: Table(t["tableId"], t["schemaType"], t["tableName"], t.get("databaseId"), t.get("sensorIdColumnName", "sensor_id"), t.get("tsColumnName", "ts"))
        for part in ("flCacheTables", "slCacheTables", "sourceTables")
        for t in raw.get(part, [])
    }
    for t in tables.values():
        _need(t.database is None or t.database in databases, f"{t.id}: unknown database {t.database!r}")
    widths = tuple(
        Granularity(g["granularityId"], g["windowDuration"], int(g["inTermsOfSeconds"]), int(g["displayLimitInSeconds"]), int(g["displayPriority"]), int(g.get("fetchIntervalAtOnceInSeconds", 0)), int(g.get("numPartitionsForEachInterval", 0)), int(g.get("numParallelQuery", 1)))
        for g in raw.get("granularities", [])
    )

    def schema_of(item: dict) -> str:
        _need(item["flCacheTableId"] in tables, f"{item['sensorId']}: unknown table {item['flCacheTableId']!r}")
        return tables[item["flCacheTableId"]].schema

    sensors: dict[str, Sensor] = {}
    for s in raw.get("sensors", []):
        sensors[s["sensorId"]] = Sensor(s["sensorId"], schema_of(s), _routes(s.get("sourceTableIds", [])), _routes(s.get("slCacheTableIds", [])))
    for g in raw.get("sensorGroups", []):
        sensors[g["sensorId"]] = SensorGroup(g["sensorId"], schema_of(g), (), _routes(g.get("slCacheTableIds", [])), tuple(g["sensors"]), g.get("spatialAggFunction", "sum"))
    known = ("queryLogCleanupDurationInSeconds", "queryPollingDurationInSeconds", "logFilePath", "schedulerAllocationFile", "appName", "reportError", "debug", "stopSparkLogging", "storeVisualizationQueries")
    settings = {k: raw[k] for k in known if k in raw}
    return Config(TimeRange(epoch(raw["bitmapStartTime"]), epoch(raw["bitmapEndTime"])), widths or DEFAULTS, databases, tables, sensors, settings).validated()


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))
