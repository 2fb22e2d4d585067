"""Continuous rollups (an addition): a stream of readings into a tier, late readings within the watermark included."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.granularity import Granularity
from tidemark.functions.intervals import TimeRange, ceil_to
from tidemark.functions.schemas import Schema
from tidemark.operators.rollup import from_source
from tidemark.sources.store import Tier


def rollup_stream(readings: DataFrame, schema: Schema, granularity: Granularity, lateness: str = "10 minutes", unique_ts: bool = True) -> DataFrame:
    """Windowed rollup of canonical streaming readings."""
    return from_source(readings.withWatermark("ts", lateness), schema, granularity, unique_ts=unique_ts)


def into_tier(rolled: DataFrame, tier: Tier, checkpoint: str, granularity: Granularity, sensors: Sequence[str] = (), since: int | None = None) -> StreamingQuery:
    """Keyed upserts batch by batch: a batch that is run again replaces its own rows.

    Without ``since`` every change is written and nothing is marked as covered, since late readings may still come. With
    it only windows that the watermark has closed are written, and from ``since`` up to the last of them the tier is
    marked as covered for ``sensors``, so the engine reads what the stream has stored and never the source again.
    """

    def write(batch: DataFrame, _: int) -> None:
        tier.write(batch)
        if since is None:
            return
        end = batch.agg(F.max(F.unix_timestamp("ts"))).first()[0]
        if end is not None:
            tier.change_coverage((s, granularity, TimeRange(ceil_to(since, granularity.seconds), end + granularity.seconds), True) for s in sensors)

    writer = rolled.writeStream.outputMode("update" if since is None else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def follow_log(log: DataFrame, handle: Callable[[list[str]], object], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of dashboard queries to ``handle`` (e.g. ``Engine.warm_all``). The checkpoint is the
    high-water mark: a batch whose handling fails is handed over again."""
    from tidemark.sources.query_log import is_dashboard_query, normalised

    asked = log.where(is_dashboard_query(F.col("argument"), F.col("command_type"))).select(normalised(F.col("argument")).alias("argument"))
    writer = asked.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: handle([r["argument"] for r in batch.collect()]) and None).start()
