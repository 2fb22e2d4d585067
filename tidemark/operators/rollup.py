"""Tumbling rollups from readings and from finer rollups, and the serving views.

One shuffle each, on (sensor, bucket), with map-side partial aggregation; every expression stays in generated code.
Canonical readings have ``sensor_id``, ``ts`` (timestamp) and the schema's measures. A rollup row has ``sensor_id``,
``ts`` (bucket start), the schema's rollup columns and ``granularity_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.granularity import Granularity
from tidemark.functions.schemas import Schema


def bucket(ts: Column, granularity: Granularity, offset: int = 0) -> Column:
    """Start of the tumbling window that holds ``ts``; windows count from the UTC epoch, moved by ``offset`` seconds."""
    start = f"{offset} seconds" if offset else None
    return F.window(ts, granularity.window, None, start)


def _finish(grouped: DataFrame, schema: Schema, granularity: Granularity) -> DataFrame:
    return grouped.select("sensor_id", F.col("bucket.start").alias("ts"), *schema.rollup_columns, F.lit(granularity.id).alias("granularity_id"))


def _extremes(counter: str, highest: str, lowest: str) -> list[Column]:
    """A counter's last and first value by time."""
    last, first = F.max_by(highest, "ts"), F.min_by(lowest, "ts")
    return [last.alias(counter), (last - first).alias(f"slot_{counter}"), first.alias(f"first_{counter}"), last.alias(f"last_{counter}")]


def from_source(readings: DataFrame, schema: Schema, granularity: Granularity, offset: int = 0, unique_ts: bool = True) -> DataFrame:
    """Roll readings up. Counters take the reading with the latest time; where times repeat within a sensor set
    ``unique_ts=False`` and the greater counter of the last time wins, the lesser of the first. That takes two more,
    narrow, aggregations of the counter alone (by time, then by bucket) instead of one that sorts whole readings."""
    aggs: list[Column] = []
    for g in schema.gauges:
        x = F.abs(g.name) if g.magnitude else F.col(g.name)
        aggs += [F.sum(x).alias(f"sum_{g.name}"), F.min(x).alias(f"min_{g.name}"), F.max(x).alias(f"max_{g.name}")]
        if g.non_zero_min:
            aggs.append(F.min(F.when(x > 0, x)).alias(f"non_zero_min_{g.name}"))
    aggs.append(F.count(F.lit(1)).alias("count_agg_rows"))
    window = bucket(F.col("ts"), granularity, offset).alias("bucket")
    if not schema.counter or unique_ts:
        counted = _extremes(schema.counter, schema.counter, schema.counter) if schema.counter else []
        return _finish(readings.groupBy("sensor_id", window).agg(*aggs, *counted), schema, granularity)
    by_time = readings.groupBy("sensor_id", window, "ts").agg(F.max(schema.counter).alias("highest"), F.min(schema.counter).alias("lowest"))
    counted = by_time.groupBy("sensor_id", "bucket").agg(*_extremes(schema.counter, "highest", "lowest"))
    # Both sides are dealt by the same keys already; sensors and buckets that are null are rows like others.
    gauges = readings.groupBy("sensor_id", window).agg(*aggs)
    met = gauges.join(counted.withColumnsRenamed({"sensor_id": "of_sensor", "bucket": "of_bucket"}), F.col("sensor_id").eqNullSafe(F.col("of_sensor")) & F.col("bucket").eqNullSafe(F.col("of_bucket")))
    return _finish(met, schema, granularity)


def from_rollup(rows: DataFrame, schema: Schema, granularity: Granularity, offset: int = 0, exact_slots: bool = False) -> DataFrame:
    """Roll finer rollup rows up. A counter's slot is the sum of the finer slots, which leaves out what passed between
    them; ``exact_slots`` takes last minus first over the whole bucket instead, whatever the path."""
    aggs: list[Column] = []
    for g in schema.gauges:
        aggs += [F.sum(f"sum_{g.name}").alias(f"sum_{g.name}"), F.min(f"min_{g.name}").alias(f"min_{g.name}"), F.max(f"max_{g.name}").alias(f"max_{g.name}")]
        if g.non_zero_min:
            aggs.append(F.min(f"non_zero_min_{g.name}").alias(f"non_zero_min_{g.name}"))
    if schema.counter:
        last, first = F.max_by(f"last_{schema.counter}", "ts"), F.min_by(f"first_{schema.counter}", "ts")
        slot = last - first if exact_slots else F.sum(f"slot_{schema.counter}")
        aggs += [F.max_by(schema.counter, "ts").alias(schema.counter), slot.alias(f"slot_{schema.counter}"), first.alias(f"first_{schema.counter}"), last.alias(f"last_{schema.counter}")]
    aggs.append(F.sum("count_agg_rows").alias("count_agg_rows"))
    return _finish(rows.groupBy("sensor_id", bucket(F.col("ts"), granularity, offset).alias("bucket")).agg(*aggs), schema, granularity)


def two_stage(readings: DataFrame, schema: Schema, finer: Granularity, granularity: Granularity, offset: int = 0, unique_ts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Readings to ``finer`` and on to ``granularity`` on one lineage: (finer rows, required rows)."""
    if granularity.seconds % finer.seconds:
        raise ValueError(f"{granularity.id} is not a whole number of {finer.id}")
    fine = from_source(readings, schema, finer, offset, unique_ts)
    return fine, from_rollup(fine, schema, granularity, offset)


def serving_view(rows: DataFrame, schema: Schema) -> DataFrame:
    """What dashboards read: averages are sums over row counts, so null readings lower them."""
    shown = [(F.try_divide(F.col(f"sum_{of[4:]}"), F.col("count_agg_rows")) if of.startswith("avg:") else F.col(of)).alias(name) for name, of in schema.served]
    return rows.select(F.col("granularity_id").alias("granularity"), "sensor_id", F.col("ts").cast("double").alias("ts"), *shown)
