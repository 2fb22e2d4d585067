"""Which ranges of which sensor a tier holds.

Coverage rows are ``sensor_id, granularity_id, start, end`` in epoch seconds, half-open and on bucket edges; they may
overlap and repeat. Everything works on the ends of ranges, in one window per sensor and width, so the cost follows
the number of ranges and never the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.granularity import Granularity
from tidemark.functions.intervals import TimeRange, align_in, align_out

COLUMNS = "sensor_id string, granularity_id string, start long, end long"
KEY = ["sensor_id", "granularity_id"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def from_buckets(buckets: DataFrame, granularity: Granularity) -> DataFrame:
    """Coverage of single buckets ``sensor_id, bucket`` (its start in epoch seconds)."""
    return buckets.select("sensor_id", F.lit(granularity.id).alias("granularity_id"), F.col("bucket").alias("start"), (F.col("bucket") + granularity.seconds).alias("end"))


def _reached(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``before``, how far the earlier ones of the same sensor and width reach (null for the first)."""
    earlier = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.where(F.col("start") < F.col("end")).withColumn("before", F.max("end").over(earlier))


def merged(coverage: DataFrame) -> DataFrame:
    """Maximal ranges that cover the same seconds."""
    opens = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    upto = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = _reached(coverage).withColumn("island", F.sum(opens).over(upto))
    return islands.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _within(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, wanted: TimeRange) -> DataFrame:
    """The parts of the sensors' coverage at one width inside ``wanted``."""
    own = coverage.where(F.col("granularity_id") == granularity.id).join(sensors.select("sensor_id").distinct(), "sensor_id", "left_semi")
    start, end = F.greatest("start", F.lit(wanted.start)).alias("start"), F.least("end", F.lit(wanted.end)).alias("end")
    return own.select(*KEY, start, end).where(F.col("start") < F.col("end"))


def missing(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, wanted: TimeRange, offset: int = 0) -> DataFrame:
    """Maximal uncovered ranges inside ``wanted`` (ends moved down to bucket edges)."""
    r = align_in(wanted, granularity.seconds, offset)
    if not r:
        return empty(sensors.sparkSession)
    # A range of no length at each end bounds the first gap and the last.
    ends = sensors.select("sensor_id").distinct().select("sensor_id", F.lit(granularity.id).alias("granularity_id"), F.explode(F.array(F.lit(r.start).cast("long"), F.lit(r.end).cast("long"))).alias("start"))
    all_ranges = _within(coverage, sensors, granularity, r).unionByName(ends.withColumn("end", F.col("start")))
    earlier = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = all_ranges.withColumn("before", F.max("end").over(earlier)).where(F.col("start") > F.col("before"))
    return gaps.select(*KEY, F.col("before").alias("start"), F.col("start").alias("end"))


def present(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, wanted: TimeRange, offset: int = 0) -> DataFrame:
    """Maximal covered ranges inside ``wanted`` (ends moved down to bucket edges)."""
    r = align_in(wanted, granularity.seconds, offset)
    return merged(_within(coverage, sensors, granularity, r)) if r else empty(sensors.sparkSession)


def any_present(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, wanted: TimeRange, offset: int = 0) -> bool:
    r = align_in(wanted, granularity.seconds, offset)
    return bool(r) and not _within(coverage, sensors, granularity, r).isEmpty()


def mark(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, ranges: list[TimeRange], offset: int = 0) -> DataFrame:
    """Coverage with the ranges (ends moved down to bucket edges) added."""
    whole = [a for r in ranges if (a := align_in(r, granularity.seconds, offset))]
    if not whole:
        return coverage
    added = F.explode(F.array(*(F.struct(F.lit(r.start).cast("long").alias("start"), F.lit(r.end).cast("long").alias("end")) for r in whole)))
    rows = sensors.select("sensor_id").distinct().select("sensor_id", F.lit(granularity.id).alias("granularity_id"), added.alias("r"))
    return merged(coverage.unionByName(rows.select(*KEY, "r.start", "r.end")))


def clear(coverage: DataFrame, sensors: DataFrame, granularity: Granularity, gone: TimeRange, offset: int = 0) -> DataFrame:
    """Coverage without any bucket that the range touches: what each range has before it and after it."""
    r = align_out(gone, granularity.seconds, offset)
    named = sensors.select("sensor_id", F.lit(True).alias("named")).distinct()
    rows = coverage.join(named, "sensor_id", "left")
    hit = F.coalesce("named", F.lit(False)) & (F.col("granularity_id") == granularity.id) & (F.col("start") < r.end) & (F.col("end") > r.start)
    own = F.struct("start", "end")
    left = F.struct(F.col("start"), F.least("end", F.lit(r.start)).alias("end"))
    right = F.struct(F.greatest("start", F.lit(r.end)).alias("start"), F.col("end"))
    parts = rows.select(*KEY, F.explode(F.when(hit, F.array(left, right)).otherwise(F.array(own))).alias("r"))
    return merged(parts.select(*KEY, "r.start", "r.end"))


def route(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Time-routed tables that serve part of a wanted range: ``sensor_id, table_id, start, end`` of each strict overlap."""
    r, w = routes.alias("r"), wanted.alias("w")
    on = (F.col("r.sensor_id") == F.col("w.sensor_id")) & (F.col("r.start") < F.col("w.end")) & (F.col("w.start") < F.col("r.end"))
    return r.join(w, on).select("r.sensor_id", "r.table_id", F.greatest("r.start", "w.start").alias("start"), F.least("r.end", "w.end").alias("end"))
