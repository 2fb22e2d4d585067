"""Half-open ranges of epoch seconds and the algebra of sorted, disjoint sets of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True, order=True)
class TimeRange:
    """``[start, end)`` in whole epoch seconds."""

    start: int
    end: int

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError(f"range ends before it starts: {self.start} > {self.end}")

    @property
    def seconds(self) -> int:
        return self.end - self.start

    def __bool__(self) -> bool:
        return self.end > self.start

    def overlaps(self, other: TimeRange) -> bool:
        """Strict: ranges that only touch share nothing."""
        return self.start < other.end and other.start < self.end

    def intersect(self, other: TimeRange) -> TimeRange | None:
        return TimeRange(max(self.start, other.start), min(self.end, other.end)) if self.overlaps(other) else None


def floor_to(t: int, width: int, offset: int = 0) -> int:
    return t - (t - offset) % width


def ceil_to(t: int, width: int, offset: int = 0) -> int:
    return -floor_to(-t, width, -offset)


def align_in(r: TimeRange, width: int, offset: int = 0) -> TimeRange:
    """Both ends moved down to a bucket edge: the last, partial bucket is left out."""
    return TimeRange(floor_to(r.start, width, offset), floor_to(r.end, width, offset))


def align_out(r: TimeRange, width: int, offset: int = 0) -> TimeRange:
    """The smallest range of whole buckets around ``r``; an aligned range is itself."""
    return TimeRange(floor_to(r.start, width, offset), ceil_to(r.end, width, offset))


def align_within(r: TimeRange, width: int, offset: int = 0) -> TimeRange | None:
    """The whole buckets inside ``r``, if any."""
    start, end = ceil_to(r.start, width, offset), floor_to(r.end, width, offset)
    return TimeRange(start, end) if start < end else None


def merge(ranges: Iterable[TimeRange]) -> list[TimeRange]:
    """Sorted, disjoint ranges that cover the same seconds; touching ones are joined, empty ones dropped."""
    out: list[TimeRange] = []
    for r in sorted(r for r in ranges if r):
        if out and r.start <= out[-1].end:
            out[-1] = TimeRange(out[-1].start, max(out[-1].end, r.end))
        else:
            out.append(r)
    return out


def subtract(ranges: Iterable[TimeRange], taken: Iterable[TimeRange]) -> list[TimeRange]:
    """What ``ranges`` cover and ``taken`` does not."""
    holes = merge(taken)
    out: list[TimeRange] = []
    for r in merge(ranges):
        at = r.start
        for h in holes:
            if h.end <= at:
                continue
            if h.start >= r.end:
                break
            if h.start > at:
                out.append(TimeRange(at, h.start))
            at = max(at, h.end)
        if at < r.end:
            out.append(TimeRange(at, r.end))
    return out


def intersect(a: Iterable[TimeRange], b: Iterable[TimeRange]) -> list[TimeRange]:
    left, right, out = merge(a), merge(b), []
    i = j = 0
    while i < len(left) and j < len(right):
        if common := left[i].intersect(right[j]):
            out.append(common)
        if left[i].end < right[j].end:
            i += 1
        else:
            j += 1
    return out


def total_seconds(ranges: Iterable[TimeRange]) -> int:
    return sum(r.seconds for r in ranges)
