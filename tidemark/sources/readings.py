"""Source adapters: any table of readings as canonical ``sensor_id, ts (timestamp), measures``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import Schema
from tidemark.sources.config import Database, Table

#: Vendor columns of power meters and the names they take.
VENDOR_COLUMNS = {
    "V1": "voltage_1", "V2": "voltage_2", "V3": "voltage_3",
    "A1": "current_1", "A2": "current_2", "A3": "current_3",
    "W1": "power_1", "W2": "power_2", "W3": "power_3",
    "PF1": "power_factor_1", "PF2": "power_factor_2", "PF3": "power_factor_3",
    "F": "frequency", "FwdWh": "energy_consumed", "new_sensor_id": "sensor_id", "TS": "ts",
}


def rename_vendor(raw: DataFrame) -> DataFrame:
    """A vendor table under canonical names; other columns keep theirs. Where a table has both an old and a new sensor
    id, the new one is taken."""
    drop = {"sensor_id"} if "new_sensor_id" in raw.columns else set()
    return raw.select(*(F.col(c).alias(VENDOR_COLUMNS.get(c, c)) for c in raw.columns if c not in drop))


def as_timestamp(column: Column, kind: T.DataType) -> Column:
    """Epoch numbers, dates and zoneless times (read as UTC under a UTC session) as timestamps."""
    return F.timestamp_micros((column * 1_000_000).cast("long")) if isinstance(kind, T.NumericType) else column.cast("timestamp")


def canonical(raw: DataFrame, schema: Schema, sensor_column: str = "sensor_id", ts_column: str = "ts") -> DataFrame:
    ts = as_timestamp(F.col(ts_column), raw.schema[ts_column].dataType)
    return raw.select(F.col(sensor_column).cast("string").alias("sensor_id"), ts.alias("ts"), *(F.col(m).cast("double").alias(m) for m in schema.measures))


def _literal(epoch_seconds: int, kind: T.DataType) -> Column:
    """A bound in the column's own type, so that the filter reaches the scan."""
    if isinstance(kind, T.NumericType):
        return F.lit(epoch_seconds).cast(kind)
    return F.timestamp_seconds(F.lit(epoch_seconds)).cast(kind)


def in_range(raw: DataFrame, sensors: list[str], wanted: TimeRange, sensor_column: str = "sensor_id", ts_column: str = "ts") -> DataFrame:
    """Rows of some sensors with ``start <= ts < end``."""
    kind = raw.schema[ts_column].dataType
    ts = F.col(ts_column)
    return raw.where(F.col(sensor_column).isin(sensors) & (ts >= _literal(wanted.start, kind)) & (ts < _literal(wanted.end, kind)))


def read_jdbc(spark: SparkSession, database: Database | dict[str, str], table: Table, wanted: TimeRange, partitions: int) -> DataFrame:
    """A source table over JDBC, its reading split by strides of the time column (bounds set strides, not filters)."""
    options = database.jdbc_options() if isinstance(database, Database) else dict(database)
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table.name)
    if partitions > 1:
        reader = reader.options(partitionColumn=table.ts_column, lowerBound=wanted.start, upperBound=wanted.end, numPartitions=partitions)
    return reader.load()


def append_jdbc(rows: DataFrame, options: dict[str, str], table: str) -> None:
    rows.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()
