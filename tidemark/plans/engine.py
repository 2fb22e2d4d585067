"""Read-through engine: answer a query from the coarsest tier that has it, fill what is missing, return a DataFrame."""

from __future__ import annotations

import logging
import threading
import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import granularity as widths
from tidemark.functions import intervals
from tidemark.functions.granularity import Granularity
from tidemark.functions.intervals import TimeRange
from tidemark.functions.schemas import Schema, schema
from tidemark.operators import rollup, spatial
from tidemark.plans import intent as intents
from tidemark.plans import planner
from tidemark.plans.intent import QueryIntent
from tidemark.plans.planner import Piece
from tidemark.sources.config import Config, Route, SensorGroup
from tidemark.sources.readings import canonical, in_range
from tidemark.sources.store import Tier


log = logging.getLogger("tidemark.engine")


class InFlight:
    """Ranges being filled, by (sensor, width): a second query for them waits instead of filling them again."""

    def __init__(self):
        self._changed = threading.Condition()
        self._held: dict[tuple[str, str], list[TimeRange]] = defaultdict(list)

    def claim(self, sensor: str, width: str, wanted: list[TimeRange]) -> list[TimeRange]:
        """What of ``wanted`` nobody fills yet; it is now the caller's to fill and release."""
        with self._changed:
            own = intervals.subtract(wanted, self._held[sensor, width])
            self._held[sensor, width] = intervals.merge([*self._held[sensor, width], *own])
            return own

    def release(self, sensor: str, width: str, own: list[TimeRange]) -> None:
        with self._changed:
            self._held[sensor, width] = intervals.subtract(self._held[sensor, width], own)
            self._changed.notify_all()

    def wait(self, sensor: str, width: str, wanted: list[TimeRange]) -> None:
        with self._changed:
            self._changed.wait_for(lambda: not intervals.intersect(self._held[sensor, width], wanted))

    def snapshot(self) -> dict[tuple[str, str], list[TimeRange]]:
        with self._changed:
            return {k: list(v) for k, v in self._held.items() if v}


@dataclass(frozen=True)
class Job:
    """A piece, with what else must agree for sensors to be filled together."""

    piece: Piece
    group: str
    routes: tuple[Route, ...]


class Engine:
    """``read_table`` gives a source table's raw rows by table id. ``unique_ts`` tells that no sensor has two readings
    of one time, which keeps counters on the hash aggregate."""

    def __init__(self, spark: SparkSession, config: Config, root: str, read_table: Callable[[str], DataFrame], now: Callable[[], float] = time.time, offset: int = 0, unique_ts: bool = True):
        self.spark, self.config, self.root, self.read_table, self.now = spark, config, root, read_table, now
        self.offset, self.unique_ts = offset, unique_ts
        self.in_flight = InFlight()
        self._commit = threading.RLock()
        self._tiers: dict[tuple[str, str], Tier] = {}

    def tier(self, name: str, of: Schema) -> Tier:
        return self._tiers.setdefault((name, of.name), Tier(self.spark, self.root, name, of))

    def first_level(self, of: Schema) -> Tier:
        return self.tier("first_level", of)

    def parse(self, sql: str) -> QueryIntent:
        known = {s.id: s.schema for s in self.config.sensors.values()}
        return intents.extract(self.spark, sql, known, self.config.origin, int(self.now()))

    def query(self, asked: str | QueryIntent) -> DataFrame:
        """Rollup rows of the asked sensors and ranges, each sensor at its own resolved width; missing ones are filled
        first. A sensor that cannot be filled is logged and gives what is stored; if none can, its error is raised."""
        wanted = self.parse(asked) if isinstance(asked, str) else asked
        of = schema(wanted.schema)
        if wanted.mode == intents.CLEAN:
            self.invalidate(wanted)
            return self.first_level(of).rows.read().drop("bucket_day").limit(0)
        failed = self.warm(wanted)
        if failed and len(failed) == len(wanted.ranges):
            raise next(iter(failed.values()))
        parts = defaultdict(list)
        for g, sensors in self.by_width(wanted).items():
            for sensor, ranges in sensors.items():
                for r in self._whole(ranges, g):
                    parts[g, r].append(sensor)
        if not parts:
            return self.first_level(of).rows.read().drop("bucket_day").limit(0)
        ordered = sorted(parts.items(), key=lambda p: (p[0][0].seconds, p[0][1]))
        return reduce(lambda a, b: a.unionByName(b), [self.first_level(of).read(sensors, g, r) for (g, r), sensors in ordered])

    def view(self, asked: str | QueryIntent) -> DataFrame:
        """The serving view of a query's rows."""
        wanted = self.parse(asked) if isinstance(asked, str) else asked
        return rollup.serving_view(self.query(wanted), schema(wanted.schema))

    def by_width(self, wanted: QueryIntent) -> dict[Granularity, dict[str, list[TimeRange]]]:
        """The asked sensors and ranges by width: the specified one, or each sensor's own by the length of its ranges."""
        specified = wanted.granularity if wanted.mode == intents.SPECIFIED else None
        out: dict[Granularity, dict[str, list[TimeRange]]] = defaultdict(dict)
        for sensor, ranges in wanted.ranges.items():
            out[widths.resolve(self.config.granularities, specified, ranges)][sensor] = ranges
        return out

    def _whole(self, ranges: list[TimeRange], g: Granularity) -> list[TimeRange]:
        """Whole buckets, the open one left out, inside the configured span."""
        span = TimeRange(self.config.origin.start, max(self.config.origin.start, min(self.config.origin.end, int(self.now()))))
        inside = intervals.intersect(ranges, [span])
        return intervals.merge(a for r in inside if (a := intervals.align_in(r, g.seconds, self.offset)))

    def missing(self, sensors: dict[str, list[TimeRange]], of: Schema, g: Granularity) -> dict[str, list[TimeRange]]:
        """What the first level lacks, by sensor; one look at the coverage for all of them."""
        held = self.first_level(of).coverage(list(sensors))
        gaps = {s: intervals.subtract(self._whole(ranges, g), held.get((s, g.id), [])) for s, ranges in sensors.items()}
        return {s: r for s, r in gaps.items() if r}

    def warm(self, wanted: QueryIntent) -> dict[str, Exception]:
        """Fill what the first level lacks; returns the sensors that could not be filled. Sensors whose gaps have one
        shape are filled by one job; if filling fails, each job is tried alone, so that one that cannot be read does not
        stop the others."""
        of, failed = schema(wanted.schema), {}
        for g, sensors in self.by_width(wanted).items():
            gaps = self.missing(sensors, of, g)
            claimed = {s: own for s, r in gaps.items() if (own := self.in_flight.claim(s, g.id, r))}
            try:
                if claimed and (still := self.missing(claimed, of, g)):  # another query may have filled some before the claim
                    failed |= self._fill_apart(of, g, self._jobs(of, g, still))
            finally:
                for sensor, own in claimed.items():
                    self.in_flight.release(sensor, g.id, own)
            for sensor, ranges in gaps.items():
                self.in_flight.wait(sensor, g.id, ranges)
        return failed

    def _fill_apart(self, of: Schema, g: Granularity, jobs: dict[Job, list[str]]) -> dict[str, Exception]:
        try:
            self._fill(of, g, jobs)
            return {}
        except Exception as e:
            if sum(map(len, jobs.values())) == 1:
                log.exception("fill of %s failed", next(iter(jobs.values())))
                return {s: e for sensors in jobs.values() for s in sensors}
        # Jobs first, then the sensors of a job that fails.
        apart = [{job: sensors} for job, sensors in jobs.items()] if len(jobs) > 1 else [{job: [s]} for job, sensors in jobs.items() for s in sensors]
        failed: dict[str, Exception] = {}
        for part in apart:
            failed |= self._fill_apart(of, g, part)
        return failed

    def _jobs(self, of: Schema, g: Granularity, gaps: dict[str, list[TimeRange]]) -> dict[Job, list[str]]:
        tables = {r.table for s in gaps for r in self.config.sensors[s].second_level}
        held = {t: self.tier(t, of).coverage(list(gaps)) for t in sorted(tables)}
        jobs: dict[Job, list[str]] = defaultdict(list)
        for sensor, ranges in gaps.items():
            spec = self.config.sensors[sensor]
            for piece in planner.plan(self.config, sensor, ranges, g, lambda t, s, w: held[t].get((s, w.id), []), self.offset):
                jobs[Job(piece, sensor if isinstance(spec, SensorGroup) else "", spec.second_level)].append(sensor)
        return jobs

    def _fill(self, of: Schema, g: Granularity, jobs: dict[Job, list[str]]) -> None:
        """Rows first, coverage after: a failure leaves rows no coverage speaks of, which the retry replaces. Each
        table is written once, from frames that stay until the last write."""
        finer = widths.next_smaller(self.config.granularities, g)
        finer = finer if finer and planner.usable(finer, g) else None
        rows: dict[Tier, list[DataFrame]] = defaultdict(list)
        marks: dict[Tier, list[tuple[str, Granularity, TimeRange, bool]]] = defaultdict(list)
        kept: list[DataFrame] = []

        def keep(frame: DataFrame) -> DataFrame:
            kept.append(frame.persist())
            return frame

        def add(tier: Tier, width: Granularity, during: TimeRange, sensors: list[str], frame: DataFrame) -> None:
            lo, hi = F.timestamp_seconds(F.lit(during.start)), F.timestamp_seconds(F.lit(during.end))
            rows[tier].append(frame.where((F.col("ts") >= lo) & (F.col("ts") < hi)))
            marks[tier] += [(s, width, during, True) for s in sensors]

        try:
            for job, sensors in jobs.items():
                piece, fine = job.piece, None
                log.info("fill %s %s of %d sensors from %s %s at %s", of.name, piece.during, len(sensors), piece.kind, piece.tables, piece.granularity.id)
                if piece.kind == planner.SECOND_LEVEL:
                    made = self.tier(piece.tables[0], of).read(sensors, piece.granularity, piece.during)
                    made = made if piece.granularity.id == g.id else keep(rollup.from_rollup(made, of, g, self.offset))
                else:
                    readings, unique = self._readings(of, piece, sensors, job.group), self._unique(job.group)
                    if finer:
                        fine = keep(rollup.from_source(readings, of, finer, self.offset, unique))
                        made = keep(rollup.from_rollup(fine, of, g, self.offset))
                    else:
                        made = keep(rollup.from_source(readings, of, g, self.offset, unique))
                add(self.first_level(of), g, piece.during, sensors, made)
                if piece.kind == planner.SECOND_LEVEL and piece.granularity.id == g.id:
                    continue  # the second level has these rows
                for route in job.routes:
                    for r in intervals.intersect([piece.during], [route.during]):
                        for width, frame in ((g, made), (finer, fine)):
                            if frame is not None and (w := intervals.align_within(r, width.seconds, self.offset)):
                                add(self.tier(route.table, of), width, w, sensors, frame)
            with self._commit:
                for tier, frames in rows.items():
                    tier.write(reduce(lambda a, b: a.unionByName(b), frames))
                for tier, changes in marks.items():
                    tier.change_coverage(changes)
        finally:
            for frame in kept:
                frame.unpersist()

    def _unique(self, group: str) -> bool:
        return self.unique_ts or bool(group)  # a group has one row a second

    def _readings(self, of: Schema, piece: Piece, sensors: list[str], group: str) -> DataFrame:
        """Canonical readings behind a piece: each table once, for its own sensors and routed times."""
        owners = list(self.config.sensors[group].members) if group else sensors
        frames = []
        for table in piece.tables:
            spec = self.config.tables[table]
            by_time: dict[TimeRange, list[str]] = defaultdict(list)
            for s in owners:
                for route in self.config.sensors[s].sources:
                    if route.table == table and (during := piece.during.intersect(route.during)):
                        by_time[during].append(s)
            for during, names in sorted(by_time.items()):
                frames.append(canonical(in_range(self.read_table(table), names, during, spec.sensor_column, spec.ts_column), of, spec.sensor_column, spec.ts_column))
        if not frames:
            empty = ", ".join(["sensor_id string", "ts timestamp", *(f"`{m}` double" for m in of.measures)])
            frames = [self.spark.createDataFrame([], empty)]
        together = spatial.union_members(frames, of)
        return spatial.spatial_sum(together, of, group, self.config.sensors[group].function) if group else together

    def invalidate(self, wanted: QueryIntent) -> None:
        """Drop rows and coverage of the asked ranges in both levels, at one width or, if none is named, at all. The
        same whole buckets go from both, every bucket that the range touches."""
        of = schema(wanted.schema)
        named = widths.by_id(self.config.granularities, wanted.granularity)
        shapes: dict[tuple, list[str]] = defaultdict(list)
        for sensor, ranges in wanted.ranges.items():
            shapes[tuple(ranges), self.config.sensors[sensor].second_level].append(sensor)
        with self._commit:
            for (ranges, routes), sensors in shapes.items():
                log.info("invalidate %s: %d sensors, %d ranges, width %s", of.name, len(sensors), len(ranges), named.id if named else "any")
                for tier in (self.first_level(of), *(self.tier(r.table, of) for r in routes)):
                    gone = [(g, r) for g in ([named] if named else self.config.granularities) for r in intervals.merge(intervals.align_out(r, g.seconds, self.offset) for r in ranges)]
                    tier.change_coverage((s, g, r, False) for s in sensors for g, r in gone)
                    for g, r in gone:
                        tier.delete(sensors, g, r)

    def reset(self) -> None:
        """Drop everything stored."""
        with self._commit:
            for s in self.config.sensors.values():
                of = schema(s.schema)
                for tier in (self.first_level(of), *(self.tier(r.table, of) for r in s.second_level)):
                    tier.truncate()

    @contextmanager
    def labelled(self, pool: str, label: str):
        """Run jobs in a scheduler pool under a description."""
        sc = self.spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", pool)
        sc.setJobDescription(label)
        try:
            yield
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.setJobDescription(None)

    def warm_all(self, queries: list[str], slots: int | None = None) -> list[BaseException | None]:
        """Warm many queries at once, each in the fair pool of its width and slot; a failed one does not stop the
        others, and its error comes back in its place."""
        from pyspark import inheritable_thread_target

        errors: list[BaseException | None] = [None] * len(queries)
        taken: dict[str, int] = defaultdict(int)

        def run(i: int, wanted: QueryIntent, pool: str) -> None:
            try:
                with self.labelled(pool, f"warm {wanted.schema}"):
                    failed = self.invalidate(wanted) if wanted.mode == intents.CLEAN else self.warm(wanted)
                    errors[i] = next(iter(failed.values()), None) if failed else None
            except Exception as e:
                log.exception("query %d failed", i)
                errors[i] = e

        threads = []
        for i, sql in enumerate(queries):
            try:
                wanted = self.parse(sql)
            except intents.IntentError as e:
                errors[i] = e
                continue
            g = max(self.by_width(wanted) or self.config.granularities, key=lambda g: g.seconds)
            slot, taken[g.id] = taken[g.id] % (slots or g.parallel_queries), taken[g.id] + 1
            threads.append(threading.Thread(target=inheritable_thread_target(self.spark)(lambda i=i, w=wanted, p=f"{g.id}-{slot}": run(i, w, p))))
            threads[-1].start()
        for t in threads:
            t.join()
        return errors
