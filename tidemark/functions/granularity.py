"""Bucket widths and how one is chosen for a query."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from tidemark.functions.intervals import TimeRange, total_seconds


@dataclass(frozen=True)
class Granularity:
    id: str
    window: str  # a Spark interval, e.g. "15 minutes"
    seconds: int
    display_limit: int  # seconds a chart at this width shows at most
    display_priority: int
    fetch_seconds: int = 0
    partitions: int = 0
    parallel_queries: int = 1


#: Widths used where no configuration gives others.
DEFAULTS = (
    Granularity("1m", "1 minute", 60, 6 * 3600, 1),
    Granularity("15m", "15 minutes", 900, 4 * 86400, 2),
    Granularity("1h", "1 hour", 3600, 31 * 86400, 3),
    Granularity("1d", "1 day", 86400, 3660 * 86400, 4),
)


def eligible(known: Sequence[Granularity], ranges: Iterable[TimeRange]) -> Granularity:
    """The first by display priority whose limit holds the ranges' total length, else the last."""
    total = total_seconds(ranges)
    by_priority = sorted(known, key=lambda g: g.display_priority)
    return next((g for g in by_priority if total <= g.display_limit), by_priority[-1])


def next_smaller(known: Sequence[Granularity], of: Granularity) -> Granularity | None:
    """The widest that is narrower than ``of``."""
    smaller = [g for g in known if g.seconds < of.seconds]
    return max(smaller, key=lambda g: g.seconds) if smaller else None


def by_id(known: Sequence[Granularity], wanted: str | None) -> Granularity | None:
    return next((g for g in known if wanted is not None and g.id.lower() == wanted.lower()), None)


def resolve(known: Sequence[Granularity], wanted: str | None, ranges: Iterable[TimeRange]) -> Granularity:
    """The one asked for, or an eligible one where none is asked for or its id is unknown."""
    return by_id(known, wanted) or eligible(known, ranges)
