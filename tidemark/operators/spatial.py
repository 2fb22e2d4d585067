"""A group of sensors as one virtual sensor: readings that fall in the same second are summed across members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schemas import Schema


def union_members(frames: list[DataFrame], schema: Schema) -> DataFrame:
    """Readings of several sources as one table, by name: sources with further columns unite with those without."""
    if not frames:
        raise ValueError("a group needs at least one source")
    canonical = [f.select("sensor_id", "ts", *schema.measures) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), canonical)


def spatial_sum(readings: DataFrame, schema: Schema, group_id: str, function: str = "sum") -> DataFrame:
    """Per second, the sum over members of each measure (magnitudes where the schema says so). Members sampled in
    different seconds are not combined."""
    if function.lower() != "sum":
        raise ValueError(f"unsupported spatial function {function!r}; only sum is known")
    aggs = [F.sum(F.abs(g.name) if g.magnitude else F.col(g.name)).alias(g.name) for g in schema.gauges]
    if schema.counter:
        aggs.append(F.sum(schema.counter).alias(schema.counter))
    second = F.date_trunc("second", "ts").alias("ts")
    return readings.groupBy(second).agg(*aggs).select(F.lit(group_id).alias("sensor_id"), "ts", *schema.measures)
